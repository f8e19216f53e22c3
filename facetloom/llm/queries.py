"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, fixity, language, near_dedup, packing, quality_mcd, shard_tree, syncmers, token_counts
from .common import read


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rule keeps, with their statistics and distances."""
    return quality_mcd.score(read(spark, sf_dir, "documents")).where("keep").drop("keep")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives the text back."""
    encoded = bpe.encode(read(spark, sf_dir, "documents"))
    return bpe.decode(encoded).select("doc_id", "ids", (F.xxhash64(F.col("decoded").cast("string")) == F.col("h")).alias("exact"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def syncmer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages of the benchmark stand in the documents, by positional matching of operator 4's anchors: every item against every document."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return syncmers.align(syncmers.fingerprints(items), syncmers.fingerprints(read(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier finds good and not toxic, with the probabilities."""
    docs = read(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, read(spark, sf_dir, "labels"))).where("keep").drop("keep")


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages against a replica. There is none in the tables, so one is made here: of every eighth run of 64 ids, by the first digit of the payload's MD5,
    records have a flipped first character (0 to 3), are longer (4, 5), shorter (6, 7), lost (8, 9), or there without being in the first replica (a, b)."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html", F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 1).alias("mark"))
    struck = F.coalesce(F.expr("floor(page_id / 64) % 8 = 1"), F.lit(False))
    mark = lambda *x: struck & F.col("mark").isin(*x)
    html = F.when(mark(*"0123"), F.concat(F.lit("X"), F.expr("substr(html, 2)"))).when(mark(*"45"), F.concat("html", F.lit("!!"))).when(mark(*"67"), F.expr("substr(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return fixity.audit(fixity.records(pages.where(~mark(*"ab"))), fixity.records(pages.where(~mark(*"89")).withColumn("html", html)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with keep: whether it is certain."""
    return language.identify(read(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by its visible text, the language its markup declares, its address and its host."""
    pages = read(spark, sf_dir, "pages")
    visible = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang=[\"']?([a-z]+)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", visible.alias("text"), declared.alias("lang"))
    return language.identify(pages, key="page_id", address="url", host=None)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that goes, with the one of its group that stays."""
    return near_dedup.duplicates(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


OPERATORS = (op1_quality_mcd, op2_bpe, op3_packing, op4_syncmers, op5_quality_classifier, op6_shard_tree, op7_fixity, op8_language_id, op9_near_dedup, op10_token_counts, language_of_pages, syncmer_matches)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {
    "op6_shard_tree": shard_tree.sql(),
    "op7_fixity": """
WITH marked AS (
  SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file, CASE WHEN floor(page_id / 64) % 8 = 1 THEN substr(md5(coalesce(html, '')), 1, 1) ELSE '-' END AS mark, html,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS length
  FROM pages),
placed AS (SELECT *, CAST(coalesce(sum(CASE WHEN mark NOT IN ('a', 'b') THEN length END) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at",
  max(CASE WHEN mark NOT IN ('a', 'b') THEN page_id END) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked)
SELECT p.file, CASE WHEN p.mark IN ('a', 'b') THEN coalesce(q."at", 0) ELSE p."at" END AS "offset", p.page_id, CASE WHEN p.mark IN ('8', '9') THEN 'missing' WHEN p.mark IN ('a', 'b') THEN 'extra' ELSE 'corrupt' END AS status
FROM placed p LEFT JOIN placed q ON q.page_id = p.before
WHERE p.mark IN ('8', '9', 'a', 'b') OR p.mark BETWEEN '0' AND '5' AND p.html IS NOT NULL OR p.mark IN ('6', '7') AND p.html <> ''""",
}
