"""BM25 ranking, term expansion, and search combined with facets and vectors.

A term's weight is ln((N + 1) / (df + 0.5)), a score idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)). Query terms are pushed into
the scan of the postings, whose rows carry their document's length; document frequencies come from the table of terms and statistics are two numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cosine_distance, trigrams
from . import counts
from .filters import Filters, documents
from .index import FacetIndex
from .text import TextIndex, query_terms

K1, B = 1.2, 0.75
#: Terms of an expansion that are pushed into the postings' scan and whose frequencies are broadcast; more of them meet the postings in a shuffle.
MOST_PUSHED = 1000


def idf(df: Column, n: Column | float) -> Column:
    return F.log((F.lit(0.0) + n + 1) / (df + 0.5))


def weight(tf: Column, df: Column, length: Column, n: float, mean: float, k1: float = K1, b: float = B) -> Column:
    mean = mean if mean > 0 else 1.0
    return idf(df, n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _postings(index: TextIndex, terms: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Postings of terms (term, df, times), with df and times; of the documents in docs only, if given."""
    few = terms.limit(MOST_PUSHED + 1).collect()
    if len(few) <= MOST_PUSHED:
        session = index.rows.sparkSession
        rows = index.postings.where(F.col("term").isin(*[r["term"] for r in few])) if few else index.postings.where(F.lit(False))
        rows = rows.join(F.broadcast(session.createDataFrame([(r["term"], r["df"], r["times"]) for r in few], "term string, df long, times long")), "term")
    else:
        rows = index.postings.join(terms, "term")
    return rows if docs is None else rows.join(docs, "doc_id", "left_semi")


def asked(index: TextIndex, terms: dict[str, int]) -> DataFrame:
    """term, df, times of those of the terms that the index has."""
    times = index.rows.sparkSession.createDataFrame(sorted(terms.items()), "term string, times long")
    found = index.terms()
    return (found.where(F.col("term").isin(*sorted(terms))) if terms else found.where(F.lit(False))).join(F.broadcast(times), "term").select("term", "df", "times")


def scores(index: TextIndex, terms: dict[str, int] | DataFrame, docs: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score for every document with any of the terms, which are given with their weights in the query or as term, df, times."""
    n, mean = index.numbers()
    rows = _postings(index, terms if isinstance(terms, DataFrame) else asked(index, terms), docs)
    each = F.col("times") * weight(F.col("tf"), F.col("df"), F.col("doc_length"), n, mean, k1, b)
    return rows.groupBy("doc_id").agg(F.sum(each).alias("score"))


def like(index: TextIndex, query: str, prefix: bool = False, fuzzy: bool = False, threshold: float = 0.3) -> DataFrame:
    """term, df, asked, similarity: the index terms that a query's terms stand for; fuzzy goes before prefix, and without either terms stand for themselves.

    A prefix is a range of the terms. A fuzzy term meets the terms that share a trigram with it, and those alone: similarity is the shared trigrams over all of both.
    """
    session = index.rows.sparkSession
    words = sorted(query_terms(index, query))
    given = F.broadcast(session.createDataFrame([(w,) for w in words], "asked string"))  # as many rows as the query has terms
    if fuzzy:
        own = session.createDataFrame([(w,) for w in words], "asked string").select("asked", trigrams(F.col("asked")).alias("g"))
        own = own.select("asked", F.size("g").alias("m"), F.explode("g").alias("gram"))
        grams = sorted({f"  {w.lower()} "[i : i + 3] for w in words for i in range(len(w) + 1)})
        met = index.grams().where(F.col("gram").isin(*grams) if grams else F.lit(False)).join(F.broadcast(own), "gram").groupBy("term", "n", "asked", "m").agg(F.count("*").alias("shared"))
        met = met.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= max(0.3, threshold))
        return met.join(index.terms(), "term").select("term", "df", "asked", "similarity")
    found = index.terms()
    if prefix:
        starts = F.lit(False)
        for w in words:
            starts = starts | F.startswith("term", F.lit(w))
        met = found.where(starts).join(given, F.startswith("term", "asked"))
    else:
        met = found.where(F.col("term").isin(*words) if words else F.lit(False)).join(given, F.col("term") == F.col("asked"))
    return met.select("term", "df", "asked", F.lit(1.0).alias("similarity"))


def expanded(index: TextIndex, query: str, prefix: bool = False, fuzzy: bool = False, threshold: float = 0.3) -> DataFrame:
    """term, df, times (1) of the distinct index terms of ``like``; they stay a DataFrame, as a short prefix may stand for very many."""
    return like(index, query, prefix, fuzzy, threshold).groupBy("term", "df").agg(F.lit(1).cast("long").alias("times"))


def _terms(index: TextIndex, query: str | None, prefix: bool, fuzzy: bool, threshold: float) -> dict[str, int] | DataFrame:
    return expanded(index, query or "", prefix, fuzzy, threshold) if prefix or fuzzy else query_terms(index, query)


def search(index: TextIndex, query: str | None, prefix: bool = False, fuzzy: bool = False, threshold: float = 0.3, k1: float = K1, b: float = B, limit: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, score of the best documents (limit 0: all); each expanded term is scored as a term of its own. Equal scores (to 6 digits) go by id."""
    found = scores(index, _terms(index, query, prefix, fuzzy, threshold), docs, k1, b)
    found = found.where("score > 0").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return found.limit(limit) if limit else found


def score(index: TextIndex, query: str, doc_id: int, k1: float = K1, b: float = B) -> float:
    """One document's score; a term counts as often as the query has it, and a document without any scores 0."""
    one = index.lengths.where(F.col("doc_id") == doc_id).select("doc_id")
    row = scores(index, query_terms(index, query, repeats=True), one, k1, b).first()
    return row["score"] if row else 0.0


def matches(index: TextIndex, query: str, prefix: bool = False, fuzzy: bool = False, threshold: float = 0.3) -> DataFrame | None:
    """doc_id of the documents with any of the terms; None if the query has no term."""
    terms = query_terms(index, query)
    if not terms:
        return None
    if prefix or fuzzy:
        return _postings(index, expanded(index, query, prefix, fuzzy, threshold), None).select("doc_id").distinct()
    return index.postings.where(F.col("term").isin(*sorted(terms))).select("doc_id").distinct()


def explain(index: TextIndex, doc_id: int, k1: float = K1, b: float = B) -> DataFrame:
    """term, tf, df, idf, bm25_weight of each term of a document."""
    n, mean = index.numbers()
    own = index.postings.where(F.col("doc_id") == doc_id)
    few = own.select("term").limit(MOST_PUSHED + 1).collect()
    found = index.terms()
    found = found.where(F.col("term").isin(*[r[0] for r in few])) if few and len(few) <= MOST_PUSHED else found
    rows = own.join(found, "term")
    return rows.select("term", "tf", "df", idf(F.col("df"), n).alias("idf"), weight(F.col("tf"), F.col("df"), F.col("doc_length"), n, mean, k1, b).alias("bm25_weight")).orderBy(F.desc("tf"), "term")


@dataclass
class Found:
    """``page`` (doc_id, bm25_score, vector_score, combined_score), ``total`` (one row, total_found) and ``facets`` (counts, or None)."""

    page: DataFrame
    total: DataFrame
    facets: DataFrame | None = None


def search_documents(
    docs: DataFrame, text: TextIndex | None, query: str | None, index: FacetIndex | None = None, filters: Filters = None, vectors: DataFrame | None = None, query_vector: Column | None = None,
    vector_weight: float = 0.5, limit: int = 10, offset: int = 0, min_score: float = 0.0, facet_limit: int = 5, within_distance: float = 0.8,
    prefix: bool = False, fuzzy: bool = False, threshold: float = 0.3, k1: float = K1, b: float = B,
) -> Found:
    """Documents that match a query and a filter, ranked, paged and counted by facet.

    ``docs`` has doc_id; ``vectors`` has doc_id and embedding. A blank query browses, also without a text index: every document scores 1 and comes by id. With a query
    vector, candidates are text matches and documents nearer than ``within_distance`` (cosine); the combined score is bm25 * (1 - w) +
    (1 - distance / 2) * w. Facets are counted over all candidates under the filter, before ``min_score``; the total after it.
    """
    chosen = documents(index, filters) if index is not None else None
    if not (query or "").strip():
        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id")) if chosen is None else chosen
        hits = hits.select("doc_id", F.lit(1.0).alias("bm25_score"), F.lit(0.0).alias("vector_score"), F.lit(1.0).alias("combined_score"))
    else:
        if text is None:
            raise ValueError("a query with words needs a text index")
        hits = scores(text, _terms(text, query, prefix, fuzzy, threshold), chosen, k1, b).select("doc_id", F.col("score").alias("bm25_score"))
        if query_vector is None:
            hits = hits.select("doc_id", "bm25_score", F.lit(0.0).alias("vector_score"), F.col("bm25_score").alias("combined_score"))
        else:
            near = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), cosine_distance(F.col("embedding"), query_vector).alias("distance"))
            near = near if chosen is None else near.join(chosen, "doc_id", "left_semi")
            hits = hits.join(near, "doc_id", "full").where(F.col("bm25_score").isNotNull() | (F.col("distance") < within_distance))
            hits = hits.select("doc_id", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce(1 - F.col("distance") / 2, F.lit(0.0)).alias("vector_score"))
            hits = hits.withColumn("combined_score", F.col("bm25_score") * (1 - vector_weight) + F.col("vector_score") * vector_weight)
    enough = hits.where(F.col("combined_score") >= min_score)
    page = enough.orderBy(F.desc(F.round("combined_score", 6)), "doc_id").offset(offset)
    page = page.limit(limit) if limit else page
    facets = counts.top_counts(index, hits.select("doc_id"), facet_limit) if index is not None else None
    return Found(page, enough.agg(F.count("*").alias("total_found")), facets)


def _results(found: Found, docs: DataFrame, content: str, metadata: list[str] = (), created_at: str | None = None, updated_at: str | None = None) -> DataFrame:
    """k, doc_id (the page's order), result. The page is cut before it meets the documents."""
    fields = [F.col("doc_id").alias("id"), F.col(content).alias("content"), *[F.round(c, 6).alias(c) for c in ("bm25_score", "vector_score", "combined_score")]]
    fields += [F.col(c).alias(n) for n, c in (("created_at", created_at), ("updated_at", updated_at)) if c] + ([F.struct(*metadata).alias("metadata")] if metadata else [])
    return found.page.join(docs, "doc_id", "left").select((-F.round("combined_score", 6)).alias("k"), "doc_id", F.to_json(F.struct(*fields)).alias("result"))


def results_json(found: Found, docs: DataFrame, content: str, metadata: list[str] = (), **columns) -> DataFrame:
    """The page in order as JSON objects, one a row: id, content, scores, and metadata (a list) and date columns if named."""
    return _results(found, docs, content, metadata, **columns).orderBy("k", "doc_id").select("result")


def response_json(found: Found, docs: DataFrame, content: str, **columns) -> DataFrame:
    """One row: response, a JSON object of results (a page in order), facets and total_found."""
    page = _results(found, docs, content, **columns).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id", "result"))), lambda r: r["result"]).alias("results"))
    facets = counts.as_json(found.facets) if found.facets is not None else found.total.select(F.lit("[]").alias("facets"))
    one = page.crossJoin(F.broadcast(facets)).crossJoin(F.broadcast(found.total))  # three single rows
    return one.select(F.concat(F.lit('{"results":['), F.array_join("results", ","), F.lit('],"facets":'), F.coalesce("facets", F.lit("[]")), F.lit(',"total_found":'), F.col("total_found").cast("string"), F.lit("}")).alias("response"))
