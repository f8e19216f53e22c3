"""The pipeline's stages in order, each against a direct version over what the stage before it kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from facetloom.llm import language, near_dedup, packing, quality_mcd

from .test_operators import copies, corpus, frame, odd


def test_run(spark, tmp_path):
    junk = [(5000 + i, "!!## %% || " * 40, "en", "s1") for i in range(5)]
    extra = [(i + 1000, t, l, s) for i, t, l, s in copies()]
    docs = frame(spark, corpus(200) + extra + odd() + junk).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = quality_mcd.score(docs).toPandas()
    ids = lambda df: sorted(df.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0])
    want = sorted(good[good.keep].doc_id.fillna(-1).astype(int))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and ids(first) == want
    assert not set(want) & ({5000 + i for i in range(5)} | {900, 901, 902})

    found = language.identify(first).toPandas()
    second = corpus_pipeline.STAGES[1][1](spark, first, str(tmp_path))
    assert ids(second) == sorted(found[found.keep].doc_id.fillna(-1).astype(int))

    prints = near_dedup.fingerprints(second).toPandas().drop_duplicates()
    f = np.stack([prints[c].to_numpy(np.int64).view(np.uint64) for c in near_dedup.FINGERPRINT], 1)
    doc = prints.doc_id.fillna(-1).astype(int).to_numpy()
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= near_dedup.RADIUS
    near[doc == -1] = near[:, doc == -1] = False
    keep = {int(d) for d in doc if d == -1}
    left = set(range(len(doc))) - {int(i) for i in np.flatnonzero(doc == -1)}
    while left:
        group, new = set(), {min(left, key=lambda i: doc[i])}
        while new:
            group |= new
            new = {int(j) for i in new for j in np.flatnonzero(near[i])} - group
        keep.add(int(min(doc[list(group)])))
        left -= group
    third = corpus_pipeline.STAGES[2][1](spark, second, str(tmp_path))
    assert set(ids(third)) == keep and third.columns == docs.columns

    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id.fillna(-1).astype(int)) == keep
    sizes = {r.d: r.n for r in third.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), packing._words(F.col("text")).alias("n")).collect()}
    assert out.groupby(out.doc_id.fillna(-1).astype(int))["size"].sum().to_dict() == sizes


def test_empty_table_and_clashing_columns(spark, tmp_path):
    full = frame(spark, corpus(30) + odd())
    for name, docs in (("empty", full.where("false")), ("clash", full)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        if name == "empty":
            for _, stage in corpus_pipeline.STAGES[:-1]:
                assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "part", "shard", "window", "start", "size"] and (out.count() > 0) == (name == "clash")
