"""Queries that run streams to their present end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.text import TextIndex
from ..sources.folders import work_dir
from ..streaming.merge import Store, TextStore, start, start_text
from .facet_queries import ORACLES, _changes, orders_index, query, table
from .text_queries import TOKENS


def _streamed(spark, changes, folder):
    for op in ("insert", "delete", "update"):
        changes.where(f"op = '{op}'").write.mode("append").parquet(f"{folder}/changes")
    return spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/changes")


@query(ORACLES["delta_merge"])
def stream_merge(spark, sf_dir):
    """The changes of ``delta_merge`` as a stream of files in several micro-batches, merged into a store."""
    base, changes = _changes(spark, sf_dir)
    folder = work_dir(spark)
    index, store = orders_index(spark, sf_dir, base), Store(spark, f"{folder}/store")
    store.write(index.rows)
    start(_streamed(spark, changes, folder), store, index.facets, index.key, f"{folder}/progress", once_only=True).awaitTermination()
    return store.read()


_TEXT_AFTER = "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN reverse(lang) || ' changed ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0) documents WHERE"


@query(f"WITH {TOKENS.replace('FROM documents WHERE', _TEXT_AFTER).split('len AS')[0].rstrip().rstrip(',')} SELECT term, doc_id, tf FROM p")
def stream_text(spark, sf_dir):
    """A stored text index kept current from a stream: of documents 0 mod 5 the text changes, others 0 mod 7 go, 0 mod 10 come."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key, row = F.col("doc_id"), F.struct("doc_id", "text")
    changed = F.struct("doc_id", F.concat(F.reverse("lang"), F.lit(" changed "), "text").alias("text"))
    op = F.when(key % 10 == 0, "insert").when(key % 5 == 0, "update").when(key % 7 == 0, "delete")
    changes = docs.select(op.alias("op"), F.when(op != "insert", row).alias("old"), F.when(op != "delete", changed).alias("new")).where("op IS NOT NULL")
    folder = work_dir(spark)
    store = TextStore(spark, f"{folder}/store")
    store.write(TextIndex.build(docs.where(key % 10 != 0), "doc_id", "text").rows)
    start_text(_streamed(spark, changes, folder), store, "doc_id", "text", f"{folder}/progress", once_only=True).awaitTermination()
    return store.index().postings.select("term", "doc_id", "tf")
