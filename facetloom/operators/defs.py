"""Facet definitions: what each kind of facet reads from a row, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_number


@dataclass(frozen=True)
class Facet:
    """A facet: ``value`` gives a row's string, or its array of strings if ``multi``; a joined facet has a DataFrame instead."""

    name: str
    kind: str
    value: Callable[[], Column] | None = None
    column: str | None = None
    multi: bool = False
    parent: str | None = None
    params: dict = field(default_factory=dict)
    joined: DataFrame | None = None
    id: int = 0

    @property
    def takes_deltas(self) -> bool:
        return self.joined is None

    def numbered(self, number: int) -> Facet:
        return replace(self, id=number)


def plain(column: str, name: str | None = None, parent: str | None = None) -> Facet:
    return Facet(name or column, "plain", lambda: F.col(column).cast("string"), column, parent=parent)


def datetrunc(column: str, precision: str, name: str | None = None) -> Facet:
    return Facet(name or column, "datetrunc", lambda: F.date_trunc(precision, F.col(column)).cast("string"), column, params={"precision": precision})


def bucket(column: str, thresholds: list, name: str | None = None) -> Facet:
    """0 below the first threshold, then the number of thresholds reached."""
    return Facet(name or column, "bucket", lambda: bucket_number(F.col(column), thresholds).cast("string"), column, params={"buckets": ",".join(map(str, thresholds))})


def array(column: str | Column, name: str) -> Facet:
    """One value for each distinct element; null and empty arrays have none."""
    source = (lambda: F.col(column)) if isinstance(column, str) else (lambda: column)
    return Facet(name, "array", lambda: F.array_distinct(source().cast("array<string>")), column if isinstance(column, str) else None, True)


def boolean(column: str | Column, name: str) -> Facet:
    """'true' or 'false'; null counts as 'false'."""
    source = (lambda: F.col(column)) if isinstance(column, str) else (lambda: column)
    return Facet(name, "boolean", lambda: F.when(source(), "true").otherwise("false"), column if isinstance(column, str) else None)


def rating(column: str, name: str | None = None) -> Facet:
    return Facet(name or column, "rating", lambda: F.col(column).cast("string"), column)


def joined(other: DataFrame, key: str, value: str, name: str) -> Facet:
    """Values that another table has for a row's key (already joined to it): ``other`` has columns key and value. Takes no deltas."""
    return Facet(name, "joined_plain", None, value, True, joined=other.select(F.col(key).alias("doc_id"), F.col(value).cast("string").alias("facet_value")))


def function(make: Callable[[], Column], name: str, parent: str | None = None) -> Facet:
    """Any scalar expression over the row."""
    return Facet(name, "function", lambda: make().cast("string"), parent=parent)


def function_array(make: Callable[[], Column], name: str) -> Facet:
    """Any array expression over the row."""
    return Facet(name, "function_array", lambda: F.array_distinct(make().cast("array<string>")), multi=True)


UI = {"boolean": "checkbox", "bucket": "range", "datetrunc": "datepicker", "rating": "rating"}


def ui_component(facet: Facet, facets: list[Facet]) -> str:
    """What a user interface should show for the facet."""
    if facet.parent or any(f.parent == facet.name for f in facets):
        return "tree"
    return UI.get(facet.kind) or ("multiselect" if facet.multi else "dropdown")
