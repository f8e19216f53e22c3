"""Facet counts: facet_name, facet_value, cardinality, facet_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import l2_distance
from .filters import Filters, documents, normalised
from .index import FacetIndex

COLUMNS = ("facet_name", "facet_value", "cardinality", "facet_id")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("facet_id", "facet_name", "facet_value").agg(F.count("*").alias("cardinality")).select(*COLUMNS)


def within(index: FacetIndex, docs: DataFrame | None, names: list[str] | None = None) -> DataFrame:
    """Index rows of the documents (all if None) and facets named."""
    rows = index.rows if names is None else index.of(*names)
    return rows if docs is None else rows.join(docs, "doc_id", "left_semi")


def top_values(index: FacetIndex, n: int = 5, facets: list[str] | None = None) -> DataFrame:
    """The n most frequent values of each facet, with ties."""
    order = Window.partitionBy("facet_id").orderBy(F.desc("cardinality"))
    return counted(within(index, None, facets)).withColumn("r", F.rank().over(order)).where(F.col("r") <= n).select(*COLUMNS)


def top_counts(index: FacetIndex, docs: DataFrame | None = None, n: int = 5, facets: list[str] | None = None) -> DataFrame:
    """At most n values of each facet among the documents; equal counts go by value."""
    order = Window.partitionBy("facet_id").orderBy(F.desc("cardinality"), "facet_value")
    return counted(within(index, docs, facets)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select(*COLUMNS)


def facet_counts(index: FacetIndex, facet: str, docs: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Counts of one facet among the documents."""
    return counted(within(index, docs, [facet])).orderBy(F.desc("cardinality"), "facet_value").limit(limit)


def boolean_counts(index: FacetIndex, facet: str, docs: DataFrame | None = None) -> DataFrame:
    """facet_id, true_count, false_count, total_count."""
    true = F.count_if(F.col("facet_value") == "true")
    return within(index, docs, [facet]).agg(F.lit(index.facet(facet).id).alias("facet_id"), true.alias("true_count"), F.count_if(F.col("facet_value") == "false").alias("false_count"), F.count("*").alias("total_count"))


def drill_down(index: FacetIndex, filters: Filters = None, match_all: bool = False) -> DataFrame:
    """Counts under a filter of every facet that the filter doesn't name."""
    named = {name for name, _ in normalised(filters)}
    rest = [f.name for f in index.facets if f.name not in named]
    return counted(within(index, documents(index, filters, match_all), rest))


def as_json(counts: DataFrame) -> DataFrame:
    """One row: facets, a JSON list of {facet_name, facet_id, values} in order of facet and count."""
    values = F.sort_array(F.collect_list(F.struct((-F.col("cardinality")).alias("k"), F.col("facet_value").alias("value"), F.col("cardinality").alias("count"))))
    groups = counts.groupBy("facet_id", "facet_name").agg(F.transform(values, lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))).alias("values"))
    return groups.agg(F.to_json(F.sort_array(F.collect_list(F.struct("facet_id", "facet_name", "values")))).alias("facets"))


def nearest(vectors: DataFrame, id_column: str, vector_column: str, query, limit: int = 1000) -> DataFrame:
    """doc_id and distance of the documents nearest to a query vector (a Column); ties go by id."""
    rows = vectors.select(F.col(id_column).cast("long").alias("doc_id"), l2_distance(F.col(vector_column), query).alias("distance")).where(F.col("distance").isNotNull())
    return rows.orderBy("distance", "doc_id").limit(limit)


def counts_near(index: FacetIndex, facet: str, near: DataFrame, docs: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Counts of one facet among the nearest documents, and a set of documents if given."""
    near = near.select("doc_id")
    return facet_counts(index, facet, near if docs is None else near.join(docs, "doc_id", "left_semi"), limit)
