"""What an index is made of, as DataFrames and plain dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from . import hierarchy
from .defs import ui_component
from .index import FacetIndex
from .text import TextIndex


def facet_list(index: FacetIndex, spark: SparkSession) -> DataFrame:
    """facet_id, facet_name, facet_type, base_column, is_multi, supports_delta, parent."""
    rows = [(f.id, f.name, f.kind, f.column, f.multi, f.takes_deltas, f.parent) for f in index.facets]
    return spark.createDataFrame(rows, "facet_id int, facet_name string, facet_type string, base_column string, is_multi boolean, supports_delta boolean, parent string")


def facet_names(index: FacetIndex) -> list[str]:
    return [f.name for f in index.facets]


def facet_types(index: FacetIndex) -> dict[str, str]:
    return {f.name: f.kind for f in index.facets}


def for_ui(index: FacetIndex) -> list[dict]:
    return [{"facet_name": f.name, "facet_type": f.kind, "is_multi": f.multi, "ui_component": ui_component(f, index.facets)} for f in index.facets]


def describe(index: FacetIndex, text: TextIndex | None = None) -> dict:
    return {"table": index.table, "key": index.key, "language": text.analyzer.name if text else None, "has_text": text is not None, "has_delta": any(f.takes_deltas for f in index.facets), "facet_count": len(index.facets)}


def describe_all(tables: list[tuple[FacetIndex, TextIndex | None]]) -> list[dict]:
    return [describe(i, t) for i, t in tables]


def introspect(index: FacetIndex) -> dict:
    found = hierarchy.shape(index)
    links = [{"parent": f.parent, "child": f.name} for f in index.facets if f.parent]
    return {"table": index.table, "facets": for_ui(index), "hierarchy": {"roots": found["roots"], "regular_facets": found["regular"], "relationships": links}, "facet_count": len(index.facets)}


def version(spark: SparkSession) -> dict[str, str]:
    return {"version": __version__, "spark": spark.version}
