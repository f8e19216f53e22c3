"""The facet index: (facet_id, facet_name, facet_value, doc_id), one row for each value of each document.

Built in one narrow pass: every scalar and array facet of a row is put in one array and exploded, so no facet costs a scan of its own and
nothing is shuffled (keys being unique, a document can't repeat a value). Only joined facets shuffle. ``write`` stores it partitioned by
facet, so that a filter on a facet prunes to its files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import unsorted
from .defs import Facet

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Bytes of a stored index's row groups: one is read by one task, so they bound what a task of a filter holds.
GROUP = 4 << 20
#: Files that a task which stores an index keeps open at most, one for each facet, and bytes of row groups in all of them; rows of further facets are sorted (and spilled).
FILES, OPEN = 256, 256 << 20


def long_form(df: DataFrame, key: str, facets: Iterable[Facet]) -> DataFrame:
    """Index rows of df; null values are left out."""
    facets = list(facets)
    kind = df.schema[key].dataType
    if not isinstance(kind, INTEGRAL):
        raise TypeError(f"key {key} must be of an integral type, not {kind.simpleString()}")
    own = [f for f in facets if f.joined is None]
    parts = []
    if own:
        pair = lambda f, v: F.struct(F.lit(f.id).alias("facet_id"), F.lit(f.name).alias("facet_name"), v.alias("facet_value"))
        single = [pair(f, f.value()) for f in own if not f.multi]
        spread = lambda f: F.transform(F.coalesce(f.value(), F.array().cast("array<string>")), lambda v: pair(f, v))
        arrays = ([F.array(*single)] if single else []) + [spread(f) for f in own if f.multi]
        rows = df.select(F.col(key).cast("long").alias("doc_id"), F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("f"))
        parts.append(rows.select("f.facet_id", "f.facet_name", "f.facet_value", "doc_id"))
    for f in facets:
        if f.joined is not None:
            rows = df.select(F.col(key).cast("long").alias("doc_id")).join(f.joined.select(F.col("doc_id").cast("long").alias("doc_id"), "facet_value"), "doc_id").distinct()
            parts.append(rows.select(F.lit(f.id).alias("facet_id"), F.lit(f.name).alias("facet_name"), "facet_value", "doc_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("facet_value").isNotNull())


class FacetIndex:
    """``live``: rows is what docs give now, so a few facets can be had by reading their columns only; else rows is pruned by facet."""

    def __init__(self, rows: DataFrame, facets: list[Facet], key: str, table: str = "", docs: DataFrame | None = None, live: bool = False):
        self.rows, self.facets, self.key, self.table, self.docs, self.live = rows, facets, key, table, docs, live

    @classmethod
    def build(cls, df: DataFrame, key: str, facets: list[Facet], table: str = "") -> FacetIndex:
        names = [f.name for f in facets]
        if len(set(names)) < len(names):
            raise ValueError("facet names must differ")
        facets = [f.numbered(i) for i, f in enumerate(facets, 1)]
        return cls(long_form(df, key, facets), facets, key, table, df, True)

    @classmethod
    def from_columns(cls, df: DataFrame, key: str = "id", columns: list[str] | None = None, content: str | None = None, table: str = "") -> FacetIndex:
        """Plain and boolean facets for the columns given, or for every string, boolean and small integer column but key, content and bookkeeping ones."""
        from . import defs

        skip = {key, content, "content", "metadata", "created_at", "updated_at"}
        kinds = (T.StringType, T.BooleanType, T.IntegerType, T.ShortType)
        columns = columns or [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, kinds)]
        return cls.build(df, key, [defs.plain(c) for c in columns], table)

    def facet(self, name: str) -> Facet:
        for f in self.facets:
            if f.name == name:
                return f
        raise KeyError(f"no facet {name}")

    def of(self, *names: str) -> DataFrame:
        """Rows of the facets named."""
        if self.live and names:
            return long_form(self.docs, self.key, [self.facet(n) for n in names])
        return self.rows.where(F.col("facet_id").isin(*[self.facet(n).id for n in names]))

    def add(self, facets: list[Facet], df: DataFrame | None = None) -> FacetIndex:
        """With more facets, numbered on."""
        last = max((f.id for f in self.facets), default=0)
        new = [f.numbered(last + i) for i, f in enumerate(facets, 1)]
        if {f.name for f in new} & {f.name for f in self.facets}:
            raise ValueError("facet names must differ")
        rows = long_form(self.docs if df is None else df, self.key, new)
        return FacetIndex(self.rows.unionByName(rows), [*self.facets, *new], self.key, self.table, self.docs, self.live and df in (None, self.docs))

    def drop(self, names: list[str]) -> tuple[FacetIndex, list[str]]:
        """Without the facets named, and the names that there were; unknown names are ignored."""
        gone = [f for f in self.facets if f.name in names]
        rows = self.rows.where(~F.col("facet_id").isin(*[f.id for f in gone])) if gone else self.rows
        return FacetIndex(rows, [f for f in self.facets if f not in gone], self.key, self.table, self.docs, self.live), [f.name for f in gone]

    def refresh(self, df: DataFrame, names: list[str] | None = None) -> FacetIndex:
        """Rebuilt from df, wholly or for the facets named."""
        some = [f for f in self.facets if names is None or f.name in names]
        rows = long_form(df, self.key, some)
        if names is not None:
            rows = rows.unionByName(self.rows.where(~F.col("facet_id").isin(*[f.id for f in some])))
        return FacetIndex(rows, self.facets, self.key, self.table, df, names is None)

    def write(self, path: str) -> FacetIndex:
        """Store the index by facet, without sorting by it, and go on from the stored one."""
        files = min(len(self.facets) + 1, FILES)  # Spark sorts as soon as so many are open
        with unsorted(self.rows.sparkSession, files):
            self.rows.write.partitionBy("facet_id").option("parquet.block.size", min(GROUP, OPEN // files)).mode("overwrite").parquet(path)
        return FacetIndex(self.rows.sparkSession.read.schema(self.rows.schema).parquet(path).select(*self.rows.columns), self.facets, self.key, self.table, self.docs)

    def cardinality(self) -> DataFrame:
        """facet_id, facet_name, facet_value and the number of documents."""
        return self.rows.groupBy("facet_id", "facet_name", "facet_value").agg(F.count("*").alias("cardinality"))

    def packed(self) -> DataFrame:
        """facet_id, facet_value, chunk, postings (a bitmap of the chunk's ids) and their number; ids are not negative."""
        rows = self.rows.select("facet_id", "facet_value", F.expr("bitmap_bucket_number(doc_id)").alias("chunk"), F.expr("bitmap_bit_position(doc_id)").alias("bit"))
        return rows.groupBy("facet_id", "facet_value", "chunk").agg(F.expr("bitmap_construct_agg(bit)").alias("postings")).withColumn("cardinality", F.expr("bitmap_count(postings)"))

    def cardinality_of(self, name: str, value: str | None = None) -> int:
        rows = self.of(name)
        return (rows if value is None else rows.where(F.col("facet_value") == value)).count()


def chunk_bits(rows: int) -> int:
    """The width of id chunks that suits a table of so many rows (informational: results never depend on it)."""
    return 16 if rows < 100_000 else 18 if rows < 1_000_000 else 20 if rows < 10_000_000 else 22


def read_index(spark: SparkSession, path: str, facets: list[Facet], key: str, table: str = "") -> FacetIndex:
    """A stored index; facets without a number are numbered in order."""
    schema = "facet_name string, facet_value string, doc_id long, facet_id int"
    facets = [f if f.id else f.numbered(i) for i, f in enumerate(facets, 1)]
    return FacetIndex(spark.read.schema(schema).parquet(path).select("facet_id", "facet_name", "facet_value", "doc_id"), facets, key, table)
