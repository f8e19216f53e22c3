"""Reading base tables and one-call set-up."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators.defs import Facet
from ..operators.index import FacetIndex
from ..operators.text import TextIndex


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """parquet, csv (header, quoted), tsv (header, \\N for null), json or a table's name, by the path's ending unless told."""
    kind = kind or (path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "table")
    if kind == "table":
        return spark.table(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if kind == "tsv":
        return reader.option("header", True).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
    return reader.format(kind).load(path)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SQL source over DataFrames given by name."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def set_up(df: DataFrame, key: str, facets: list[Facet] | None = None, content: str | None = None, analyzer: str = "simple", table: str = "", path: str | None = None) -> tuple[FacetIndex, TextIndex | None]:
    """Facet index (of facets inferred from the schema if none are given) and, with a content column, text index; stored under path if given."""
    index = FacetIndex.build(df, key, facets, table) if facets else FacetIndex.from_columns(df, key, content=content, table=table)
    text = TextIndex.build(df, key, content, analyzer) if content else None
    if path:
        index = index.write(f"{path}/facets")
        text = text.write(f"{path}/text") if text else None
    return index, text


def load(df: DataFrame, key: str, path: str, facets: list[Facet] | None = None, content: str | None = None, analyzer: str = "simple", table: str = "") -> tuple[FacetIndex, TextIndex | None, DataFrame]:
    """``set_up`` under a path, phase by phase, with a report: phase, row_count, elapsed_ms."""
    phases, began = [], time.time()

    def ended(phase: str, rows: int) -> None:
        nonlocal began
        phases.append((phase, rows, (time.time() - began) * 1000))
        began = time.time()

    index, text = set_up(df, key, facets, content, analyzer, table)
    ended("define", len(index.facets))
    index = index.write(f"{path}/facets")
    ended("facets", index.rows.count())
    if text:
        text = text.write(f"{path}/text")
        ended("text", text.numbers()[0])
    return index, text, df.sparkSession.createDataFrame(phases, "phase string, row_count long, elapsed_ms double")
