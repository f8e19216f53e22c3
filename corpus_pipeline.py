"""From raw documents to packed training windows, in four stages; each stage's rows are written and read again by the next.

A stage's rows replace those of the stage before, whose table is deleted, as are the tables that a stage has written for itself.

``ORACLE_SQL`` is None: neither the concentration steps of the robust estimate, nor the fingerprint search, nor online packing
can be stated in SQL. ``tests/llm/test_pipeline.py`` holds the stages against brute-force versions.

Defined cases: rows whose text is null or blank are rejected by the first stage. Rows with a null doc_id pass all stages and are packed; they are in no
group of copies. Rows with equal doc_id and text are one document from the third stage on. Very long texts are read whole. Null languages
and sources are values of their own, and a null language is replaced by the one found. An empty table gives no rows. Columns other than doc_id, text, lang and source are carried
along unread, whatever their names, as far as the third stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from facetloom.llm import language, near_dedup, packing, quality_mcd
from facetloom.llm.common import delete, read, scratch, work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose statistics are no outliers for their language and source."""
    return quality_mcd.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain and is the declared one."""
    return language.keep_certain(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the training windows."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
