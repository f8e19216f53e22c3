"""Keeping an index current from row changes.

Changes are a DataFrame with ``op`` (insert, update, delete) and structs ``old`` and ``new`` of the table's columns. Each change adds 1 for
every facet value of the new row and takes 1 for every one of the old; sums of 0 are nothing. Sums are associative, so batches and streams share
this code and need no state beyond the index.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .defs import Facet
from ..sources.folders import work_dir
from .index import FacetIndex, long_form

KEYS = ("facet_id", "facet_name", "facet_value", "doc_id")


def of_changes(changes: DataFrame, key: str, facets: list[Facet]) -> DataFrame:
    """Signed index rows (facet_id, facet_name, facet_value, doc_id, delta) of changes, not yet netted. Joined facets take none."""
    facets = [f for f in facets if f.takes_deltas]
    wrong = F.assert_true((F.col("op") != "update") | F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}")), "an update must not change the key")
    changes = changes.where(wrong.isNull())
    new = long_form(changes.where("op IN ('insert', 'update')").select("new.*"), key, facets).withColumn("delta", F.lit(1))
    old = long_form(changes.where("op IN ('delete', 'update')").select("old.*"), key, facets).withColumn("delta", F.lit(-1))
    return new.unionByName(old)


def net(deltas: DataFrame) -> DataFrame:
    """Sums by facet value and document, without those of 0."""
    return deltas.groupBy(*KEYS).agg(F.sum("delta").cast("int").alias("delta")).where("delta <> 0")


def merged(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    """Index rows with deltas merged: by one shuffle of both, a row is there if it is added, or was there and isn't taken."""
    was = rows.select(*KEYS, F.lit(1).alias("was"), F.lit(0).alias("delta"))
    both = was.unionByName(deltas.select(*KEYS, F.lit(0).alias("was"), "delta"))
    return both.groupBy(*KEYS).agg(F.max("was").alias("was"), F.sum("delta").alias("delta")).where("delta > 0 OR (was = 1 AND delta = 0)").select(*KEYS)


def apply(index: FacetIndex, deltas: DataFrame) -> FacetIndex:
    """The index with deltas merged, whole; ``streaming.merge.Store`` rewrites only what they touch."""
    return FacetIndex(merged(index.rows, deltas), index.facets, index.key, index.table, index.docs)


def apply_joined(index: FacetIndex, df: DataFrame) -> FacetIndex:
    """Joined facets are rebuilt from the changed table."""
    names = [f.name for f in index.facets if not f.takes_deltas]
    return index.refresh(df, names) if names else index


def status(pending: DataFrame) -> DataFrame:
    """table, delta_count, recommendation and alert_level from a DataFrame of (table, delta_count)."""
    n = F.col("delta_count")
    return pending.withColumn("recommendation", F.when(n == 0, "nothing to merge").when(n < 1000, "merge when convenient").when(n < 10_000, "merge soon").when(n < 100_000, "merge now").otherwise("merge at once")).withColumn(
        "alert_level", F.when(n == 0, "ok").when(n < 10_000, "info").when(n < 100_000, "warning").otherwise("critical")
    )


def stored(index: FacetIndex) -> FacetIndex:
    """The index written in the shared folder, and read from there."""
    return index.write(work_dir(index.rows.sparkSession))


@dataclass
class Maintained:
    """An index with its pending deltas and a history of merges; reads merge what is pending first.

    ``store`` makes a merged index permanent (by default a table in the shared folder); what fails, fails there, before anything here has changed.
    """

    index: FacetIndex
    pending: DataFrame | None = None
    store: Callable[[FacetIndex], FacetIndex] = stored
    history: list[dict] = field(default_factory=list)

    def change(self, changes: DataFrame) -> None:
        deltas = of_changes(changes, self.index.key, self.index.facets)
        self.pending = deltas if self.pending is None else self.pending.unionByName(deltas)

    def count(self) -> int:
        return 0 if self.pending is None else net(self.pending).count()

    def merge(self) -> int:
        """Merge; raises on failure, leaving index and deltas as they were. Either way the history has a row."""
        began, n = time.time(), 0
        entry = {"table": self.index.table, "delta_count": 0, "rows_merged": 0, "status": "success", "error_message": None}
        try:
            n = entry["delta_count"] = self.count()
            if n:
                self.index = self.store(apply(self.index, net(self.pending)))
                entry["rows_merged"] = n
            self.pending = None
        except Exception as e:
            entry |= {"status": "error", "error_message": str(e)}
            raise
        finally:
            self.history.append(entry | {"elapsed_ms": (time.time() - began) * 1000})
        return n

    def merge_if(self, least: int = 1000) -> dict:
        """Merge once enough is pending."""
        n = self.count()
        return {"merged": n >= least and self.merge() >= 0, "delta_count": n}

    def current(self) -> FacetIndex:
        if self.pending is not None:
            self.merge()
        return self.index


def merge_all(tables: list[Maintained]) -> list[dict]:
    """Merge each table; one's failure doesn't keep others from it."""
    out = []
    for t in tables:
        try:
            out.append({"table": t.index.table, "rows_merged": t.merge(), "status": "success"})
        except Exception as e:  # noqa: BLE001
            out.append({"table": t.index.table, "rows_merged": 0, "status": f"error: {e}"})
    return out
