"""Filters by facet values, giving sets of documents as one-column DataFrames (doc_id); and the algebra of such sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import FacetIndex

Filters = dict | list | str | None


def normalised(filters: Filters, comma_or: bool = False) -> list[tuple[str, list[str]]]:
    """(facet, values) pairs in order. Dicts map a facet to a value or a list of values; lists have pairs or {facet_name, value}; strings are JSON of either."""
    if isinstance(filters, str):
        filters = json.loads(filters) if filters.strip() else None
    if not filters:
        return []
    items = filters.items() if isinstance(filters, dict) else [(f["facet_name"], f.get("value", f.get("facet_value"))) if isinstance(f, dict) else f for f in filters]
    out = []
    for name, value in items:
        values = value if isinstance(value, (list, tuple)) else [value]
        values = [str(v).lower() if isinstance(v, bool) else str(v) for v in values if v is not None]
        if comma_or:
            values = [part for v in values for part in v.split(",")]
        if values:
            out.append((name, values))
    return out


def documents(index: FacetIndex, filters: Filters, match_all: bool = False, comma_or: bool = False) -> DataFrame | None:
    """The documents that match: any of a facet's values, for every facet (with match_all every single value). None if there is no filter.

    One pass over the rows of the facets asked for and one shuffle whatever their number: each condition is a bit, and a document needs all.
    An unknown facet matches nothing.
    """
    pairs = normalised(filters, comma_or)
    if not pairs:
        return None
    known = {f.name: f.id for f in index.facets}
    wanted: dict[tuple, set[str]] = {}
    for name, values in pairs:
        for v in values:
            wanted.setdefault((name, v) if match_all else (name,), set()).add(v)
    if any(k[0] not in known for k in wanted):
        return index.rows.where(F.lit(False)).select("doc_id")
    where = F.lit(False)
    words = [F.lit(0).cast("long")] * -(-len(wanted) // 63)  # each condition is a bit of one of these
    for i, ((name, *_), values) in enumerate(wanted.items()):
        here = (F.col("facet_id") == known[name]) & F.col("facet_value").isin(*sorted(values))
        where = where | here
        words[i // 63] = words[i // 63].bitwiseOR(F.when(here, F.lit(1 << i % 63).cast("long")).otherwise(F.lit(0).cast("long")))
    met = [F.bit_or(w).alias(f"met{i}") for i, w in enumerate(words)]
    all_met = F.lit(True)
    for i in range(len(words)):
        all_met = all_met & (F.col(f"met{i}") == (1 << min(63, len(wanted) - 63 * i)) - 1)
    return index.of(*sorted({k[0] for k in wanted})).where(where).groupBy("doc_id").agg(*met).where(all_met).select("doc_id")


def page(docs: DataFrame | None, limit: int = 100, offset: int = 0) -> DataFrame | None:
    """Ascending ids from an offset on; limit 0 takes all."""
    if docs is None:
        return None
    docs = docs.orderBy("doc_id").offset(offset)
    return docs.limit(limit) if limit else docs


def with_value(index: FacetIndex, facet: str, value: str | bool) -> DataFrame:
    value = str(value).lower() if isinstance(value, bool) else value
    return index.of(facet).where(F.col("facet_value") == value).select("doc_id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def one_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """In exactly one of two sets, by one shuffle."""
    return a.select("doc_id", F.lit(1).alias("s")).union(b.select("doc_id", F.lit(2).alias("s"))).groupBy("doc_id").agg(F.bit_or("s").alias("s")).where("s <> 3").select("doc_id")


def contains(docs: DataFrame, doc_id: int) -> bool:
    return not docs.where(F.col("doc_id") == doc_id).isEmpty()


def equal(a: DataFrame, b: DataFrame) -> bool:
    return one_of(a, b).isEmpty()


def pack(docs: DataFrame) -> DataFrame:
    """chunk, bits: the set as one bitmap for each chunk of ids."""
    return docs.select(F.expr("bitmap_bucket_number(doc_id)").alias("chunk"), F.expr("bitmap_bit_position(doc_id)").alias("p")).groupBy("chunk").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))


def packed_all(sets: list[DataFrame]) -> DataFrame:
    """Intersection of packed sets; a chunk that any of them lacks is empty."""
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.expr("bitmap_and_agg(bits)").alias("bits")).where(F.col("n") == len(sets)).drop("n")


def packed_any(sets: list[DataFrame]) -> DataFrame:
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def unpack(packed: DataFrame) -> DataFrame:
    """The ids of a packed set."""
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("bits")), lambda i: F.conv(F.hex(F.substring(F.col("bits"), i, F.lit(1))), 16, 10).cast("int")))
    rows = packed.select("chunk", byte.alias("at", "byte")).where("byte <> 0").select("chunk", "at", "byte", F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("i"))
    rows = rows.where(F.expr("(byte >> i) & 1") == 1)
    return rows.select(((F.col("chunk") - 1) * 32768 + F.col("at") * 8 + F.col("i") + 1).cast("long").alias("doc_id"))
