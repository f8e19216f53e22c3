"""One object for a faceted table: facets, text, pending changes, all under the names an application would look for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import counts, filters, hierarchy, introspect, search
from .operators.defs import Facet
from .operators.deltas import Maintained, status
from .operators.index import FacetIndex
from .operators.text import ANALYZERS, TextIndex


class FacetedTable:
    """``df`` with an index of facets and, with a content column, one of text. Every read sees the changes made before it."""

    def __init__(self, df: DataFrame, key: str, facets: list[Facet] | None = None, content: str | None = None, language: str = "simple", name: str = "", store: Callable[[FacetIndex], FacetIndex] | None = None):
        self.df, self.key, self.content, self.name = df, key, content, name
        index = FacetIndex.build(df, key, facets, name) if facets else FacetIndex.from_columns(df, key, content=content, table=name)
        self.maintained = Maintained(store(index), store=store) if store else Maintained(index)
        self.text = TextIndex.build(df, key, content, language) if content else None

    @property
    def index(self) -> FacetIndex:
        return self.maintained.current()

    # facets

    def add_facet(self, *facets: Facet) -> list[int]:
        before = len(self.index.facets)
        self.maintained.index = self.index.add(list(facets), self.df)
        return [f.id for f in self.maintained.index.facets[before:]]

    def drop_facet(self, *names: str) -> list[str]:
        self.maintained.index, gone = self.index.drop(list(names))
        return gone

    def refresh(self, df: DataFrame | None = None) -> None:
        """Rebuild everything and forget pending changes."""
        self.df = self.df if df is None else df
        self.maintained.index, self.maintained.pending = self.maintained.index.refresh(self.df), None
        self.rebuild_text()

    def filter_documents(self, wanted: filters.Filters, match_all: bool = False) -> DataFrame | None:
        return filters.documents(self.index, wanted, match_all)

    def top_values(self, n: int = 5, facets: list[str] | None = None) -> DataFrame:
        return counts.top_values(self.index, n, facets)

    def count_results(self, wanted: filters.Filters = None) -> DataFrame:
        return counts.drill_down(self.index, wanted)

    def facet_counts(self, facet: str, wanted: filters.Filters = None, limit: int = 10) -> DataFrame:
        return counts.facet_counts(self.index, facet, filters.documents(self.index, wanted), limit)

    def hierarchical_facets(self, n: int = 5, wanted: filters.Filters = None) -> DataFrame:
        return hierarchy.facets_json(self.index, n, filters.documents(self.index, wanted))

    # changes

    def change(self, changes: DataFrame) -> None:
        """Row changes (op, old, new), one for a key: facets take them as deltas, text is replaced document by document."""
        self.maintained.change(changes)
        touched = changes.select(F.coalesce(f"old.{self.key}", f"new.{self.key}").alias(self.key))
        self.df = self.df.join(touched, self.key, "left_anti").select(*self.df.columns).unionByName(changes.where("op <> 'delete'").select("new.*"))
        if self.text is not None:
            gone = changes.where("op = 'delete'").select(F.col(f"old.{self.key}").cast("long").alias("doc_id"))
            here = changes.where("op <> 'delete'").select("new.*")
            self.text = self.text.delete(gone).upsert(here, self.key, self.content)

    def merge_deltas(self, least: int = 0) -> int:
        return self.maintained.merge() if self.maintained.count() >= least else 0

    def delta_status(self) -> DataFrame:
        return status(self.df.sparkSession.createDataFrame([(self.name, self.maintained.count())], "table string, delta_count long"))

    # text

    def index_documents(self, df: DataFrame) -> None:
        self.text = self.text.upsert(df, self.key, self.content)

    def delete_documents(self, docs: DataFrame) -> None:
        """docs has doc_id."""
        self.text = self.text.delete(docs)

    def rebuild_text(self, language: str | None = None) -> None:
        if self.text is not None:
            self.text = TextIndex.build(self.df, self.key, self.content, ANALYZERS[language] if language else self.text.analyzer)

    def bm25_search(self, query: str | None, **how) -> DataFrame:
        return search.search(self.text, query, **how)

    def bm25_score(self, query: str, doc_id: int) -> float:
        return search.score(self.text, query, doc_id)

    def text_statistics(self) -> DataFrame:
        return self.text.collection_stats()

    def search(self, query: str | None, wanted: filters.Filters = None, vectors: DataFrame | None = None, query_vector: Column | None = None, **how) -> search.Found:
        """Ranked page, total and facet counts."""
        docs = self.df.select(F.col(self.key).cast("long").alias("doc_id"))
        return search.search_documents(docs, self.text, query, self.index, wanted, vectors, query_vector, **how)

    def introspect(self) -> dict:
        return introspect.introspect(self.index) | introspect.describe(self.index, self.text)
