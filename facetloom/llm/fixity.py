"""Merkle fixity audit of WARC replicas.

A replica's records are hashed (SHA-256 over header and payload). The first replica's manifest gives every record its place: a file, and there
the byte offset at which it begins. The second replica's records are looked up in that manifest by file and record id, so a record that is lost,
added, longer or shorter there moves none of its neighbours. A record that the manifest doesn't have stands at the offset of the one before it.

Within a file, ordered offset ranges make a tree: the records of one offset, ranges of 2^18, 2^22 and 2^26 bytes, the root; a node's hash covers
its children's offsets and hashes in order. Both replicas' trees are written once, level by level. The roots are compared first; of every further
level only the children of nodes that differ are read (files whose roots agree are skipped by the file statistics of the stored level), down to the
records. Payloads are hashed where they are read and not moved; what is shuffled is a record's id, length and hash.

Defined cases: a record with a null url or payload is hashed as one with an empty one. A record without an id is known by its hash alone: a changed
one counts as one missing and one extra; such records are spread over files of negative numbers. Several records under one id and identical repeated
records are compared as a bag: identical ones are one row with a number of copies, so a record repeated any number of times costs no more than
one. A record whose contents are the same but whose copies are fewer is missing, more are extra. Empty replicas have no roots; against
a full one all records are missing or extra. Columns other than those named are not read, so they can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_checked

#: Bits of offset below which a node of each level lies, from the leaves up.
LEVELS = (18, 22, 26, 63)
#: Ids of a file.
PER_FILE = 4096
#: Files over which records without an id are spread, in bits.
_SPREAD = 20
#: Most differing files that are named to the scan, to skip row groups; beyond it the join alone selects.
_NAMED = 1000


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """A response record's text."""
    payload = F.coalesce(payload, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, payload, F.lit("\r\n\r\n"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """file, id, who (the hash of a record without an id, else null), length, hash and copies of the records of a replica."""
    whole = record(F.col(page_id), F.col(url), F.col(payload))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.octet_length(whole).cast("long").alias("length"), F.unhex(F.sha2(whole, 256)).alias("hash"))
    lone = -1 - F.xxhash64("hash").bitwiseAND(F.lit((1 << _SPREAD) - 1))
    rows = rows.select(F.coalesce(F.floor(F.col("id") / PER_FILE), lone).cast("long").alias("file"), "id", F.when(F.col("id").isNull(), F.col("hash")).alias("who"), "length", "hash")
    return rows.groupBy("file", "id", "who", "length", "hash").agg(F.count("*").alias("copies"))


def manifest(rows: DataFrame) -> DataFrame:
    """file, id, who and the offset at of each record id of a replica, in order of id, then hash."""
    before = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "hash", "length").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long"))
    return placed.groupBy("file", "id", "who").agg(F.min("at").alias("at"))


def _placed(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (0: a, 1: b), file, at (where a's manifest has the record, or the one before it), and the records' columns, of both replicas."""
    own = Window.partitionBy("file", "id", "who")
    upto = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), F.col("who").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    places = manifest(a).select("file", "id", "who", F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("long").alias("copies"), F.lit(-1).alias("side"), "at")
    rows = both.withColumn("at", F.lit(None).cast("long")).unionByName(places)
    rows = rows.withColumn("here", F.max("at").over(own)).withColumn("at", F.coalesce("here", F.max("at").over(upto), F.lit(0)))
    return rows.where("side >= 0").select("side", "file", "at", "id", "who", "length", "hash", "copies")


def _level(df: DataFrame) -> DataFrame:
    """Stored sorted by file, so that a read of a few files skips the rest."""
    return cut(df.repartition("file").sortWithinPartitions("file"))


def _digest(parts: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.array_sort(parts), ","), 256))


def tree(placed: DataFrame) -> list[DataFrame]:
    """Levels from the offsets up to the roots, each with side, file, at (the first offset that belongs to the node) and hash, written once."""
    leaf = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "length", "copies", F.hex("hash"))
    out = [_level(placed.groupBy("side", "file", "at").agg(_digest(F.collect_list(leaf)).alias("hash")))]
    for bits in LEVELS:
        up = F.shiftleft(F.shiftright("at", bits), bits).alias("up")
        child = F.concat_ws(":", F.lpad(F.hex("at"), 16, "0"), F.hex("hash"))
        out.append(_level(out[-1].groupBy("side", "file", up).agg(_digest(F.collect_list(child)).alias("hash")).withColumnRenamed("up", "at")))
    return out


def _under(level: DataFrame, wrong: DataFrame, by: Column) -> DataFrame:
    """The rows of a level that lie under the nodes in wrong (file, up)."""
    files = [r[0] for r in wrong.select("file").distinct().limit(_NAMED + 1).collect()]
    if len(files) <= _NAMED:
        level = level.where(F.col("file").isin(files))
    return join_checked(level.withColumn("up", by), wrong, ["file", "up"], "left_semi").drop("up")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, offset, page_id, status (corrupt, missing, extra: in b as against a) of the record ids in which replicas differ; a and b are ``records``."""
    placed = _level(_placed(cut(a), cut(b)))
    levels = tree(placed)
    wrong = None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        if wrong is not None:
            bits = LEVELS[depth]
            level = _under(level, wrong, F.shiftleft(F.shiftright("at", bits), bits))
        side = lambda n: F.max(F.when(F.col("side") == n, F.col("hash")))
        met = level.groupBy("file", "at").agg(side(0).alias("x"), side(1).alias("y")).where(~F.col("x").eqNullSafe(F.col("y")))
        wrong = cut(met.select("file", F.col("at").alias("up")))
    rows = _under(placed, wrong, F.col("at"))
    bag = lambda n, *c: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct(*c))))
    met = rows.groupBy("file", "id", "who").agg(
        F.min("at").alias("offset"), *[bag(n, *c).alias(f"{x}{n}") for n in (0, 1) for x, c in (("all", ("length", "hash", "copies")), ("kinds", ("length", "hash")))], *[F.sum(F.when(F.col("side") == n, F.col("copies")).otherwise(0)).alias(f"n{n}") for n in (0, 1)]
    )
    same = F.col("kinds0") == F.col("kinds1")
    status = F.when(F.col("n1") == 0, "missing").when(F.col("n0") == 0, "extra").when(same & (F.col("n1") < F.col("n0")), "missing").when(same & (F.col("n1") > F.col("n0")), "extra").otherwise("corrupt")
    return met.where(F.col("all0") != F.col("all1")).select("file", "offset", F.col("id").alias("page_id"), status.alias("status"))
