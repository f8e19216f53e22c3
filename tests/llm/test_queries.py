"""The registered queries over whole tables against direct versions of their results."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from facetloom.llm import classifier, language, near_dedup, packing, quality_mcd, queries, syncmers, token_counts, vocabulary

from .test_operators import slow_anchors, slow_mcd

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=vocabulary.load(), special_tokens={})


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_outliers(spark):
    """At sf0.01, where some groups have hundreds of documents and some a few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_mcd.statistics(docs, ["doc_id"]).where("x0 IS NOT NULL").toPandas()
    want = slow_mcd(stats[quality_mcd.X].to_numpy(), stats["__lang"].to_numpy(), stats["__source"].to_numpy())
    rows = {r.doc_id: r.distance2 for r in queries.op1_quality_mcd(spark, "/root/testdata/sf0.01").collect()}
    limit = quality_mcd.chi_square_quantile(1 - quality_mcd.TAIL, quality_mcd.D)
    ids, keep = stats["doc_id"].to_numpy(), want <= limit
    assert set(rows) <= set(ids) and np.mean([(i in rows) == k for i, k in zip(ids, keep, strict=True)]) >= 0.99
    both = [(rows[i], w) for i, w in zip(ids, want, strict=True) if i in rows]
    assert np.median([abs(g - w) / (1 + w) for g, w in both]) < 0.03


def test_bpe(spark, texts, encoding):
    rows = run(spark, "op2_bpe")
    assert len(rows) == len(texts) and all(r.exact for r in rows)
    assert all(list(r.ids) == encoding.encode_ordinary(texts[r.doc_id].text) for r in rows)


def test_packing(spark, texts):
    ids = sorted(i for i, r in texts.items() if r.text.split())
    sizes = np.array([len(texts[i].text.split()) + 1 for i in ids])
    want = {(ids[i], part, window, start, size) for i, part, window, start, size in packing.place(sizes)}
    assert {(r.doc_id, r.part, r.window, r.start, r["size"]) for r in run(spark, "op3_packing")} == want


def test_syncmers(spark, texts):
    rows = run(spark, "op4_syncmers")
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id].text) < 2500:
            assert list(r.positions) == slow_anchors(texts[r.doc_id].text.encode())
        assert len(r.positions) == len(r.hashes)
        assert not r.positions or max(np.diff(r.positions), default=0) <= syncmers.K - syncmers.S


def test_matches(spark, texts):
    """Every passage that an item and a document share at length is found at its place."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.left_id, r.right_id): r for r in run(spark, "syncmer_matches")}
    whole = {(i, d): t.text.encode().index(x.encode()) for i, x in items.items() for d, t in texts.items() if len(x) > 200 and x in t.text}
    assert set(whole) <= set(got)
    for (i, d), r in got.items():
        raw = near_dedup.fold_case(np.frombuffer(items[i].encode(), np.uint8)).tobytes()[r.left_start : r.left_start + syncmers.K]
        assert raw in near_dedup.fold_case(np.frombuffer(texts[d].text.encode(), np.uint8)).tobytes()


def test_classifier(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    table = classifier.fit(docs, labels)
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in run(spark, "op5_quality_classifier")}
    for i, r in texts.items():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        buckets = np.concatenate([b for _, b in classifier.features(raw, np.array([0, len(raw)]))]) if len(raw) else np.zeros(0, int)
        z = (table[buckets].astype(float).mean(0) if len(buckets) else 0) + table[-1]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        good, toxic = p[1] + p[3], p[2] + p[3]
        assert (i in got) == (good >= 0.5 and toxic <= 0.5)
        if i in got:
            assert np.allclose(got[i], (good, toxic), atol=1e-4)


def test_language(spark, texts):
    def grams(text):
        low = bytes(near_dedup.fold_case(np.frombuffer(text.encode(), np.uint8)))
        low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
        for i in range(len(low) - 2):
            if low[i + 1] != 32:
                yield ((low[i] | low[i + 1] << 8 | low[i + 2] << 16) * 0x9E3779B1 % 2**32) >> (32 - language.BITS)

    langs = sorted({r.lang for r in texts.values()})
    bags = {i: Counter(grams(r.text)) for i, r in texts.items()}
    total = {lang: sum((bags[i] for i, r in texts.items() if r.lang == lang), Counter()) for lang in langs}
    size = 1 << language.BITS
    logs = {lang: {b: math.log((total[lang][b] + 0.5) / (sum(total[lang].values()) + 0.5 * size)) + math.log(size) for b in set().union(*bags.values())} for lang in langs}
    ll = {i: [sum(n * logs[lang][b] for b, n in bag.items()) for lang in langs] + [0.0] for i, bag in bags.items()}
    best = {i: None if max(v) == 0 else int(np.argmax(v)) for i, v in ll.items()}
    k, s, n = len(langs) + 1, language.SMOOTH, len(texts)
    all_n = np.array([sum(b == j for b in best.values()) + 1.0 for j in range(k)])
    all_n[-1] = language.UND_PRIOR / (1 - language.UND_PRIOR) * all_n[:-1].sum()
    prior = all_n / all_n.sum()

    def count(where):
        return np.array([sum(best[i] == j for i in texts if where(texts[i])) for j in range(k)], float)

    host, said = {}, {}
    for h in {r.source for r in texts.values()}:
        c = count(lambda r, h=h: r.source == h)
        above = (c + s * prior) / (c[:-1].sum() + s)  # a source has no domain above it but itself
        host[h] = np.log(np.append(((c + s * above) / (c[:-1].sum() + s))[:-1], prior[-1]))
    for v in langs:
        c, m = count(lambda r, v=v: r.lang == v), sum(r.lang == v for r in texts.values())
        said[v] = np.append(np.log((c + s * m / n) / (all_n + s))[:-1], math.log(m / n))
    rows = {r.doc_id: r for r in run(spark, "op8_language_id")}
    assert set(rows) == set(texts)
    got = {i: (r.language, r.posterior) for i, r in rows.items() if r.keep}
    for i, r in texts.items():
        z = np.array(ll[i]) * language.TEMPER + host[r.source] + said[r.lang]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        j = int(p.argmax())
        assert (i in got) == (j < k - 1 and p[j] >= 0.9)
        if i in got:
            assert got[i][0] == langs[j] and abs(got[i][1] - p[j]) < 1e-3


def test_near_copies(spark, texts):
    ids = sorted(texts)
    raws = [texts[i].text.encode() for i in ids]
    f, known = near_dedup.simhash(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    near = (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= near_dedup.RADIUS) & known[:, None] & known[None]
    pairs = {(ids[i], ids[j]) for i, j in np.argwhere(near) if i < j}
    root = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {i: min([root[i], *(root[b if a == i else a] for a, b in pairs if i in (a, b))]) for i in ids}
        if new == root:
            break
        root = new
    want = {i for i in ids if root[i] != i}
    got = {r.doc_id: r.duplicate_of for r in run(spark, "op9_near_dedup")}
    assert want and set(got) == want
    assert all(root[i] == root[j] for i, j in got.items())


def test_token_counts(spark, texts, encoding):
    whole = token_counts.proven()
    for r in run(spark, "op10_token_counts"):
        ids = encoding.encode_ordinary(texts[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.n_whole <= r.n_words <= r.n_tokens
    assert len(whole) > 50_000


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cursor = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*[F.col(n) for n in names]).collect())) == Counter(cursor.fetchall())


def test_pages(spark):
    rows = run(spark, "language_of_pages")
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and sum(r.keep for r in rows) > 0.9 * len(rows)
