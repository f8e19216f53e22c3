"""Index rows stored in blocks of document ids, with a log of the changes that wait to be merged into them.

Rows lie under path/data/v=N/<facet_id=F/>block=B, changes under path/log/v=N. A merge writes its changes to the log; a block is written anew only when the changes
that wait for it come to half its rows, so that merges cost in proportion to changes, however many batches they come in. Version N's manifest (path/manifest/N) says which version of
each block is current, its rows and how many changes wait: those of later versions, which a read merges. A pointer file written last makes N the newest:
readers see all of a merge or nothing, and a job that dies between leaves files that nothing names. The pointer also
says which streaming query and batch it was, so that a batch that runs again is passed over.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import unsorted

#: Documents ids of a block. At 10^10 documents and some ten facets there are some 10^5 blocks.
BLOCK = 1 << 20
#: Most touched blocks that are named to the scan as partitions; beyond it the join alone selects them.
_NAMED = 10_000


class BlockStore:
    """``log``: the schema of changes, which ``_merged`` puts into rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...] = (), block: int = BLOCK, log: str = ""):
        self.spark, self.path, self.size = spark, path.rstrip("/"), block
        self.columns = [f.split()[0] for f in schema.split(", ")]
        self.schema, self.by = f"{schema}, v long, block long", [*by, "block"]
        self.log = f"{log or schema}, block long, v long"

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> int | None:
        folder, fs = self._at("pointer")
        if not fs.exists(folder):
            return None
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=None)

    def written_by(self) -> dict:
        """query and batch of the newest version ({} if it wasn't a stream's)."""
        path, fs = self._at(f"pointer/{self.newest()}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def _point(self, number: int, note: dict) -> None:
        path, fs = self._at(f"pointer/{number}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()

    def _blocks(self, number: int | None = None) -> DataFrame:
        """The partition columns of each block, v, n (its rows) and pending (changes that wait for it); of a block that is empty too. Blocks of older stores have no n."""
        kept = [f"{c} {'long' if c == 'block' else 'int'}" for c in self.by]
        rows = self.spark.read.schema(", ".join([*kept, "v long, n long, pending long"])).parquet(f"{self.path}/manifest/{self.newest() if number is None else number}")
        return rows.withColumn("pending", F.coalesce("pending", F.lit(0).cast("long")))

    def manifest(self, number: int | None = None) -> DataFrame:
        """The partition columns and v of each current block that has rows."""
        return self._blocks(number).where("n IS NULL OR n > 0").select(*self.by, "v")

    def _blocked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.floor(F.col("doc_id") / self.size).cast("long"))

    def _write(self, rows: DataFrame, number: int) -> DataFrame:
        """Rows as version number of their blocks, which are returned with their numbers of rows."""
        path = f"{self.path}/data/v={number}"
        with unsorted(rows.sparkSession):
            rows.repartition(*self.by).write.mode("overwrite").option("parquet.block.size", 32 << 20).partitionBy(*self.by).parquet(path)
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data").where(F.col("v") == number)
        return written.groupBy(*self.by, "v").agg(F.count("*").alias("n")).withColumn("pending", F.lit(0).cast("long"))

    def _publish(self, blocks: DataFrame, number: int, note: dict | None) -> None:
        blocks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._point(number, note or {})

    def write(self, rows: DataFrame, number: int = 0, note: dict | None = None) -> None:
        """All rows anew, as version number."""
        self._publish(self._write(self._blocked(rows.select(*self.columns)), number), number, note)

    def _named(self, blocks: DataFrame, rows: DataFrame) -> DataFrame:
        few = blocks.limit(_NAMED + 1).collect()
        if len(few) > _NAMED:
            return rows
        named = F.lit(False)
        groups: dict[tuple, list[int]] = {}
        for r in few:
            groups.setdefault(tuple(r[c] for c in self.by[:-1]), []).append(r["block"])
        for key, numbers in groups.items():
            here = F.col("block").isin(numbers)
            for c, x in zip(self.by, key, strict=False):
                here = here & (F.col(c) == x)
            named = named | here
        return rows.where(named)

    def _current(self, blocks: DataFrame, number: int, some: bool) -> DataFrame:
        """The rows that blocks (of a manifest; only ``some`` of them) have at a version: as stored, or merged with the changes that wait for them."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        rows = self._named(blocks, rows) if some else rows
        waiting = blocks.where("pending > 0")
        still = rows.join(blocks.where("pending = 0"), [*self.by, "v"], "left_semi").select(*self.columns)
        if waiting.isEmpty():
            return still
        base = rows.join(waiting, [*self.by, "v"], "left_semi").select(*self.columns)
        log = self.spark.read.schema(self.log).parquet(f"{self.path}/log").where(F.col("v") <= number)
        log = log.join(waiting.select(*self.by, F.col("v").alias("since")), self.by).where("v > since").drop("since", "block")
        return still.unionByName(self._merged(base, log).select(*self.columns))

    def _merged(self, base: DataFrame, log: DataFrame) -> DataFrame:
        """Rows with changes (and v, their version) merged."""
        raise NotImplementedError

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        number = self.newest()
        return self._current(self._blocks(number), number, False)

    def append(self, changes: DataFrame, note: dict | None = None) -> int:
        """The next version, with changes in the log or, where they have come to half a block's rows, merged into it; returns its number."""
        before = self.newest()
        number = before + 1
        self._blocked(changes).write.mode("overwrite").parquet(f"{self.path}/log/v={number}")
        more = self.spark.read.schema(self.log).parquet(f"{self.path}/log").where(F.col("v") == number).groupBy(*self.by).agg(F.count("*").alias("more"))
        zero = F.lit(0).cast("long")
        blocks = self._blocks(before).join(more, self.by, "full")
        blocks = blocks.select(*self.by, F.coalesce("v", F.lit(-1).cast("long")).alias("v"), F.coalesce("n", zero).alias("n"), (F.coalesce("pending", zero) + F.coalesce("more", zero)).alias("pending"))
        folder = f"{self.path}/touched/{number}"
        blocks.coalesce(1).write.mode("overwrite").parquet(folder)
        blocks = self.spark.read.parquet(folder)
        due = blocks.where("pending > 0 AND 2 * pending >= n")
        if not due.isEmpty():
            new = self._write(self._blocked(self._current(due, number, True)), number)
            empty = due.join(new, self.by, "left_anti").select(*self.by, F.lit(number).cast("long").alias("v"), zero.alias("n"), zero.alias("pending"))
            blocks = blocks.where("NOT (pending > 0 AND 2 * pending >= n)").unionByName(new).unionByName(empty)
        self._publish(blocks, number, note)
        return number

    def vacuum(self) -> list[int]:
        """Delete versions of which the newest manifest uses nothing; the newest two stay, for readers at work."""
        blocks, newest = self._blocks(), self.newest()
        used = {r["v"] for r in blocks.select("v").distinct().collect()}
        since = blocks.where("pending > 0").agg(F.min("v")).first()[0]  # the log is needed from there on
        gone = []
        for name, needed in (("data", lambda v: v in used), ("log", lambda v: since is not None and v > since)):
            folder, fs = self._at(name)
            for s in fs.listStatus(folder) if fs.exists(folder) else ():
                v = int(s.getPath().getName().split("=")[1])
                if not needed(v) and v < newest - 1:
                    fs.delete(s.getPath(), True)
                    gone.append(v)
        return sorted(set(gone))


def once(store: BlockStore, query: str | None, batch: int) -> dict | None:
    """The note for a streaming batch, or None if it is in the store already. Another query's store isn't gone on with: its changes would be taken twice or lost."""
    last = store.written_by()
    if last.get("query") not in (None, query):
        raise RuntimeError(f"the store was last written by streaming query {last['query']}, not {query}: go on with that query's checkpoint, or write the store anew")
    return None if last and last["batch"] >= batch else {"query": query, "batch": batch}
