"""Each operator against a brute-force version, and on the awkward inputs its docstring defines."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from facetloom.llm import bpe, classifier, fixity, language, near_dedup, packing, quality_mcd, shard_tree, syncmers, token_counts, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, words string, x0 double, size string"
WORDS = {"en": "the of and to with from over under river mountain yellow garden window table people water morning evening forest bridge".split(), "de": "der die und nicht über für straße häuser müssen schön grün wälder brücke morgen abend fenster garten tisch leute wasser".split()}


def prose(rng, lang, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS[lang]) if rng.random() < 0.6 else "".join(rng.choice(WORDS[lang])[:3] for _ in range(3))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        rows.append((i, prose(rng, lang, rng.randint(40, 160)), lang, f"s{i % 2}", 0, "clash", "clash", 0.0, "clash"))
    return rows


def odd():
    text = prose(random.Random(5), "en", 60)
    return [(900, None, "en", "s0"), (901, "", None, "s0"), (902, "  \n ", "en", None), (None, text, None, None), (903, text, "en", "s1"), (903, text, "en", "s1"), (904, "word " * 60000, "en", "s0"), (905, "x" * 200000, "de", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) + (0, "clash", "clash", 0.0, "clash")[: 9 - len(r)] if len(r) < 9 else r for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, corpus(60) + odd())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1. outlier rules


def test_outliers_go_and_prose_stays(spark, docs):
    junk = [(1000 + i, ("THE!! RIVER!! " if i % 2 else "zz | qq | ## %% ") * 30, "en", "s1") for i in range(6)]
    out = quality_mcd.score(docs.unionByName(frame(spark, junk))).toPandas().set_index("doc_id")
    assert not out.loc[[1000 + i for i in range(6)], "keep"].any()
    assert out.loc[range(160), "keep"].mean() > 0.97


def test_outlier_distances_match_direct_computation(spark, docs):
    stats = quality_mcd.statistics(docs, ["doc_id"])
    groups, model = quality_mcd.estimate(stats)
    judged = quality_mcd.judge(stats, groups, model).toPandas()
    m = {r["g"]: r for r in model.collect()}
    by = {(r["__lang"], r["__source"]): m[r["g"]] for r in groups.collect()}
    for _, r in judged.iterrows():
        p = by[r["__lang"], r["__source"]]
        x = np.array([r[c] for c in quality_mcd.X]) - np.array([p[f"m{i}"] for i in range(quality_mcd.D)])
        w = np.array([[p[f"w{i}_{j}"] if j <= i else 0.0 for j in range(quality_mcd.D)] for i in range(quality_mcd.D)])
        assert abs(((w @ x) ** 2).sum() - r.distance2) < 1e-6 * (1 + r.distance2)


def slow_mcd(x, lang, source):
    """Squared distances by the rule, with each group's vectors sorted at every step; the starts and the steps' end are the operator's."""
    d, share, floor = quality_mcd.D, 0.75, quality_mcd.FLOOR
    chi, cdf = quality_mcd.chi_square_quantile, quality_mcd.chi_square_cdf
    limit = chi(0.975, d)

    def whiten(scatter):
        values, vectors = np.linalg.eigh(scatter / np.outer(floor, floor))
        full = vectors @ np.diag(np.maximum(values, 1)) @ vectors.T * np.outer(floor, floor)
        return np.linalg.inv(full), np.linalg.slogdet(full)[1]

    def far(x, mean, inverse):
        return np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)

    def moments(x, weight):
        mean = weight @ x / weight.sum()
        return mean, (x - mean).T @ ((x - mean) * weight[:, None]) / weight.sum()

    def level(x):
        middle = np.median(x, 0)
        scale = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, floor)
        z = np.tanh((x - middle) / scale)
        corr = (z - z.mean(0)).T @ (z - z.mean(0)) / len(z)
        unit = np.sqrt(np.diag(corr) + 1e-6)

        def step(model):
            order = np.argsort(far(x, *model[1:]), kind="stable")
            weight = np.zeros(len(x))
            weight[order] = np.clip(share * len(x) - np.arange(len(x)), 0, 1)
            mean, cov = moments(x, weight)
            inverse, logdet = whiten(cov * share / cdf(chi(share, d), d + 2))
            return logdet, mean, inverse

        models = [(0, middle, whiten(start)[0]) for start in (np.diag(scale**2), corr / np.outer(unit, unit) * np.outer(scale, scale))]
        model = min((step(step(m)) for m in models), key=lambda m: m[0])
        while (new := step(model))[0] < model[0] - quality_mcd.TOLERANCE:
            model = new
        inside = far(x, *model[1:]) <= limit
        if not inside.any():
            return None
        mean, cov = moments(x[inside], np.ones(inside.sum()))
        return mean, cov * 0.975 / cdf(limit, d + 2), inside.sum()

    def drawn(own, above, n):
        w = n / (n + quality_mcd.PRIOR)
        if own is None or above is None:
            return above if own is None else (own[0], own[1] * (1 + (d + 1) / own[2]))
        return tuple(w * a + (1 - w) * b for a, b in zip(own[:2], above, strict=True))

    top, out = drawn(level(x), None, len(x)), np.full(len(x), np.nan)
    for one in set(lang):
        middle = drawn(level(x[lang == one]), top, (lang == one).sum())
        for name in set(source[lang == one]):
            rows = (lang == one) & (source == name)
            model = drawn(level(x[rows]), middle, rows.sum())
            if model is not None:
                out[rows] = far(x[rows], model[0], whiten(model[1])[0])
    return out


def agree(got, want, least=0.99):
    """Nearly the same verdicts, and distances that differ by the width of the bins only."""
    limit = quality_mcd.chi_square_quantile(1 - quality_mcd.TAIL, quality_mcd.D)
    assert np.isnan(got).tolist() == np.isnan(want).tolist()
    assert ((got <= limit) == (want <= limit)).mean() >= least
    assert np.median(np.abs(got - want) / (1 + want)) < 0.03


def test_estimate_agrees_with_concentration_in_numpy(spark):
    """Groups of 400, 200, 3 and 1 documents, with junk."""
    rows = [(r[0], r[1], r[2], "big" if r[2] == "en" else r[3], *r[4:]) for r in corpus(800, 3) if r[2] == "en" or r[0] % 4 == 0]
    junk = [(1000 + i, "!!## %% " * 40, "en", "big", 0, "", "", 0.0, "") for i in range(25)]
    few = [(1100 + i, prose(random.Random(i), "de", 80) if i < 3 else "## !! " * 50, "de", "few" if i < 3 else "lone", 0, "", "", 0.0, "") for i in range(4)]
    df = frame(spark, rows + junk + few)
    stats = quality_mcd.statistics(df, ["doc_id"]).toPandas()
    want = slow_mcd(stats[quality_mcd.X].to_numpy(), stats["__lang"].to_numpy(), stats["__source"].to_numpy())
    got = quality_mcd.score(df).toPandas().set_index("doc_id").loc[stats["doc_id"]]
    agree(got["distance2"].to_numpy(float), want)
    assert not got.loc[[1000 + i for i in range(25)] + [1103], "keep"].any() and got.loc[[1100, 1101, 1102], "keep"].all()


@pytest.mark.parametrize("n", [20, 90])
def test_junk_goes_from_small_corpora(spark, n):
    """There is no size below which nothing is judged."""
    rng = random.Random(n)
    rows = [(i, prose(rng, "en", rng.randint(40, 160)), "en", f"s{i % 5}") for i in range(n)] + [(n, "## !! %% " * 60, "en", "s0")]
    out = quality_mcd.score(frame(spark, rows)).toPandas().set_index("doc_id")
    assert not out.keep[n] and out.keep[range(n)].mean() >= 0.95 and out.distance2.notna().all()
    assert quality_mcd.score(frame(spark, rows[:1])).first().keep


def test_labelled_junk_goes(spark):
    """On labelled documents at least 95 % of the bad go, and hardly any of the good."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labelled = quality_mcd.score(read("documents")).join(read("labels"), "doc_id").where("doc_id % 2 = 1")
    share = {r.quality: r.kept for r in labelled.groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("kept")).collect()}
    assert share[0] <= 0.05 and share[1] >= 0.999


def test_outliers_on_awkward_rows(awkward, empty):
    out = quality_mcd.score(awkward).toPandas()
    assert len(out) == 68
    blank = out[out.doc_id.isin([900, 901, 902])]
    assert not blank.keep.any() and blank.distance2.isna().all()
    assert out[out.doc_id == 903].keep.nunique() == 1
    kept = quality_mcd.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == out.keep.sum()
    assert quality_mcd.score(empty).count() == 0 and quality_mcd.keep_good(empty).count() == 0


# 2 and 10. tokens


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=vocabulary.load(), special_tokens={})


def odd_texts():
    return [(910, "héllo wörld  \n\n x 日本語 \U0001f600!!'ll", None, None), (911, "\x1c\x85  a b\t\t", None, None), (912, "don't 12345  6 ", None, None)]


def test_bpe_agrees_and_round_trips(spark, awkward, encoding):
    df = frame(spark, corpus(40) + odd() + odd_texts()).coalesce(2)
    rows = bpe.decode(bpe.encode(df)).collect()
    texts = Counter((r.doc_id, r.text) for r in df.collect())
    got = Counter((r.doc_id, None if r.decoded is None else bytes(r.decoded).decode()) for r in rows)
    assert got == texts
    for r in rows:
        assert r.ids is None if r.decoded is None else list(r.ids) == encoding.encode_ordinary(bytes(r.decoded).decode())


def test_bpe_agrees_over_many_blocks(spark, docs, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 500)
    rows = bpe.encode(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(list(r.ids) == encoding.encode_ordinary(texts[r.doc_id]) for r in rows)


def test_bpe_of_shuffled_input(spark, docs, encoding):
    shuffled = docs.repartition(3).join(docs.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other")).repartition(5)
    encoded = bpe.encode(shuffled)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: encoding.encode_ordinary(t) for i, t in texts.items()}


def test_bpe_splits_texts_once(spark, docs):
    encoded = bpe.encode(docs)
    encoded.collect()
    final = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final


def test_decoding_bad_ids_and_empty(spark, empty):
    df = spark.createDataFrame([(1, [262]), (2, [262, None]), (3, [10**6]), (4, [-1]), (5, []), (6, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(df).collect()} == {1: b" the", 2: None, 3: None, 4: None, 5: b"", 6: None}
    assert bpe.encode(empty).count() == 0


WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space, which Python's \\s isn't


def pre_tokens(text):
    pattern = vocabulary.PATTERN.replace(r"[^\s\p{L}", rf"[^{WHITE}\p{{L}}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return [m.group().encode() for m in __import__("regex").finditer(pattern, text)]


def test_token_counts(spark, empty, encoding):
    df = frame(spark, corpus(40) + odd() + odd_texts())
    whole = token_counts.proven()
    want = Counter()
    for r in df.collect():
        words = None if r.text is None else pre_tokens(r.text)
        want[(r.doc_id, None, None, None) if words is None else (r.doc_id, len(words), sum(w in whole for w in words), len(encoding.encode_ordinary(r.text)))] += 1
    assert Counter(map(tuple, token_counts.count(df).collect())) == want
    assert token_counts.count(empty).count() == 0


def test_proof_rejects_what_merging_does_not_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    assert vocabulary.merge(b"ab", ranks) == [b"ab"]
    assert vocabulary.merge(b"xyz", ranks) == [b"x", b"y", b"z"]


# 3. packing


def slow_place(sizes, capacity):
    fills, out = [], []
    for i, size in enumerate(sizes):
        while size >= capacity:
            out.append((i, len(fills), 0, capacity))
            fills.append(capacity)
            size -= capacity
        if not size:
            continue
        options = []
        for w in [None, *range(len(fills))]:
            if w is None:
                after = [*fills, size]
            elif fills[w] + size <= capacity:
                after = fills.copy()
                after[w] += size
            else:
                continue
            n = Counter(f for f in after if f < capacity)
            options.append((sum(v * v for v in n.values()), -(fills[w] if w is not None else 0), w))
        best = min(o[:2] for o in options)
        level = -best[1]
        out.append((i, None, level, size))
        w = next(o[2] for o in options if o[:2] == best)
        if w is None:
            fills.append(size)
        else:
            fills[w] += size
    return out


def test_packing_is_sum_of_squares():
    rng = random.Random(2)
    sizes = [rng.choice([1, 3, 5, 8, 13, 20, 45, rng.randint(1, 30)]) for _ in range(250)]
    got = packing.place(np.array(sizes), 20)
    assert [(i, start, size) for i, _, _, start, size in got] == [(i, start, size) for i, _, start, size in slow_place(sizes, 20)]
    fill = Counter()
    for _, _, w, start, size in got:
        assert fill[w] == start
        fill[w] += size
    assert max(fill.values()) <= 20


def test_packing_awkward(spark, awkward, empty):
    out = packing.pack(awkward, run=50).toPandas()
    words = {r.doc_id: r.n for r in awkward.where("doc_id IS NOT NULL").select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n")).collect()}
    assert not set(out.doc_id.dropna()) & {900, 901, 902}
    assert out[out.doc_id == 904]["size"].sum() == 60001 and (out["size"] <= 2048).all()
    assert out[out.doc_id == 903]["size"].sum() == 2 * (words[903] + 1)
    assert out.groupby(["shard", "window"], dropna=False)["size"].sum().max() <= 2048
    assert out.doc_id.isna().sum() == 1 and set(out["shard"].dropna()) == {0, 1, 18} and out["shard"].isna().sum() == 1
    assert packing.pack(empty).count() == 0


def test_packing_does_not_depend_on_other_shards(spark):
    docs = frame(spark, corpus(300))
    rows = lambda df: {tuple(r) for r in packing.pack(df, run=100).where("shard = 1").collect()}
    assert rows(docs) == rows(docs.where("doc_id BETWEEN 100 AND 199")) != set()


def test_hot_shards_are_dealt(spark):
    """A third of all rows with one doc_id, and a third with none: no group of more than some RUN rows, and nothing lost."""
    rows = [(i, "a b c") for i in range(300)] + [(7, "x " * (1 + i % 9)) for i in range(300)] + [(None, "n " * (1 + i % 5)) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=16, run=50).toPandas()
    assert out["size"].sum() == sum(len(t.split()) + 1 for _, t in rows) and len(out) == len(rows)
    assert out.groupby(["shard", "window"], dropna=False)["size"].sum().max() <= 16
    deal = out.assign(deal=out["window"] // 2**40).groupby(["shard", "deal"], dropna=False).size()
    assert deal.max() < 120 and len(deal) > 12


# 4. syncmers


def slow_anchors(data):
    def low(b):
        return near_dedup.fold_case(np.frombuffer(b, np.uint8)).tobytes()

    def value(b):
        return int(near_dedup.mix(np.array([int.from_bytes(b, "little")], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])

    data = low(data)
    out = []
    for i in range(len(data) - syncmers.K + 1):
        inner = [value(data[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers(spark, empty):
    texts = [(i, prose(random.Random(i), "de", 60), None, None) for i in range(5)] + [(7, "a" * 60, None, None), (8, "short", None, None), (9, None, None, None), (10, "", None, None), (None, "y" * 41, None, None)]
    got = {r.doc_id: r for r in syncmers.fingerprints(frame(spark, texts).coalesce(1)).collect()}
    for i, text, *_ in texts:
        assert got[i].positions is None if text is None else list(got[i].positions) == slow_anchors(text.encode())
    assert len(set(got[7].hashes)) == 1
    assert syncmers.fingerprints(empty).count() == 0


def test_syncmers_of_long_and_repeated_rows(spark):
    rng = random.Random(3)
    long = prose(rng, "de", 40000)
    rows = [(1, long, None, None), (2, "word " * 60000, None, None), (2, "word " * 60000, None, None)]
    got = syncmers.fingerprints(frame(spark, rows)).collect()
    one = next(r for r in got if r.doc_id == 1)
    at = np.array(one.positions)
    assert len(long.encode()) > 200_000 and max(np.diff(at)) <= syncmers.K - syncmers.S and at[-1] > len(long.encode()) - 2 * syncmers.K
    cut = len(long[:150_000].encode())
    part = slow_anchors(long.encode()[cut : cut + 3000])
    assert [a - cut for a in at.tolist() if cut <= a <= cut + 3000 - syncmers.K] == part
    twice = [r for r in got if r.doc_id == 2]
    assert len(twice) == 2 and list(twice[0].hashes) == list(twice[1].hashes)


def test_passages_align(spark):
    passage = prose(random.Random(9), "en", 80)
    a = "Something before. " + passage
    b = "Other words stand here first, " + passage + " and after."
    left, right = (syncmers.fingerprints(frame(spark, [(i, t, None, None)])) for i, t in ((1, a), (2, b)))
    best = max(syncmers.align(left, right).collect(), key=lambda r: r.anchors)
    assert best.shift == a.index(passage) - b.index(passage)
    assert best.left_end - best.left_start > 0.8 * len(passage)


# 5. classifier


def test_classifier_held_out(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, "en", 60) if i % 3 else " | ".join(rng.choice(WORDS["en"]) for _ in range(50)), None, None) for i in range(150)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(None, 1, 0), (5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    table = classifier.fit(df, labels)
    out = classifier.score(df, table).toPandas().set_index("doc_id").loc[range(100, 150)]
    assert (out.keep == [i % 3 > 0 for i in range(100, 150)]).mean() > 0.95
    odd_out = classifier.score(frame(spark, odd()), table).toPandas()
    assert len(odd_out) == 8 and odd_out.p_quality.between(0, 1).all()
    assert odd_out[odd_out.doc_id == 900].p_quality.iloc[0] == odd_out[odd_out.doc_id == 901].p_quality.iloc[0]
    nothing = classifier.fit(df, labels.where("false"))
    assert classifier.score(df, nothing).where("p_quality <> 0.5").count() == 0
    assert classifier.score(empty, table).count() == 0


def test_training_against_plain_loops(spark):
    """The same descent, example by example and bucket by bucket, from whole texts and in double precision."""
    rng = random.Random(8)
    texts = [prose(rng, "en", 30) if i % 2 else "zz | " * (i + 1) + prose(rng, "de", 3) for i in range(20)] + ["", "a " * 3000]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(22)] + [(3, 1, 1)]
    df, given = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs, classes = classifier.examples(df, given)
    assert len(docs) == 23 and sorted(classes.tolist()) == sorted(q + 2 * t for _, q, t in labels)
    bags = {}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        bags[i] = Counter(int(b) for _, found in (classifier.features(raw, np.array([0, len(raw)])) if len(raw) else []) for b in found)
    assert sorted(sorted(zip(b.tolist(), n.tolist(), strict=True)) for b, n in docs) == sorted(sorted(bags[i].items()) for i, *_ in labels)

    def slow(docs, classes, epochs, rate, batch=32, seed=7):
        draw, k, dim = np.random.default_rng(seed), 4, classifier.DIM
        vectors = draw.uniform(-1 / dim, 1 / dim, (1 << classifier.BITS, dim)).astype(np.float32).astype(float)
        output = draw.normal(0, 1 / np.sqrt(dim), (dim, k))
        bias = np.array([math.log(sum(classes == c) + 0.5) for c in range(k)])
        bias -= bias.mean()
        sv, so, sb = {}, np.full((dim, k), 1e-8), np.full(k, 1e-8)
        for epoch in range(epochs):
            order = draw.permutation(len(docs)).tolist()
            for i in range(0, len(order), batch):
                rows, gv, go, gb = order[i : i + batch], {}, np.zeros((dim, k)), np.zeros(k)
                for r in rows:
                    bucket, n = docs[r]
                    total = max(sum(n.tolist()), 1)
                    mean = sum((c / total * vectors[b] for b, c in zip(bucket.tolist(), n.tolist(), strict=True)), np.zeros(dim))
                    p = np.exp(mean @ output + bias)
                    p /= p.sum()
                    p[classes[r]] -= 1
                    go, gb = go + np.outer(mean, p) / len(rows), gb + p / len(rows)
                    for b, c in zip(bucket.tolist(), n.tolist(), strict=True):
                        gv[b] = gv.get(b, 0) + c / total * (output @ p) / len(rows)
                so, sb, step = so + go**2, sb + gb**2, rate * (1 - epoch / epochs)
                output, bias = output - step * go / np.sqrt(so), bias - step * gb / np.sqrt(sb)
                for b, g in gv.items():
                    sv[b] = sv.get(b, 1e-8) + g**2
                    vectors[b] -= step * g / np.sqrt(sv[b])
        return np.vstack([vectors @ output, bias])

    want, got = slow(docs, classes, 2, 0.5, batch=8), classifier.train(docs, classes, epochs=2, rate=0.5, batch=8)
    assert np.abs(want - got).max() < 2e-3


def test_labels_without_documents_do_not_use_up_the_bound(spark):
    df = frame(spark, [(i, f"text {i}", None, None) for i in range(10)] + [(3, "again", None, None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)] + [(4, 0, 1)] * 3, "doc_id long, quality int, toxic int")
    assert len(classifier.examples(df, labels, most_labelled=14)[0]) == 14 and len(classifier.examples(df, labels, most_labelled=100)[0]) == 14


def test_features_do_not_cross_words_or_texts():
    texts = [b"abcd ef", b"ghijk", b"", b"ab cdefg"]
    off = np.cumsum([0, *map(len, texts)])
    found = classifier.features(np.frombuffer(b"".join(texts), np.uint8), off)
    for size, (at, _) in zip(classifier.GRAMS, found[1:], strict=True):
        want = [o + i for t, o in zip(texts, off, strict=False) for i in range(len(t) - size + 1) if b" " not in t[i + 1 : i + size - 1]]
        assert at.tolist() == want


# 6. shard tree


def slow_place_key(key, tree):
    path, node, out = "", tree, []
    for _ in range(3):
        draws = []
        for name, child in node.items():
            w = shard_tree.weight(child)
            u = (int(hashlib.md5(f"{key}|{path}{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if w > 0:
                draws.append((-math.log(u) / w, name))
        name = min(draws)[1]
        out.append(name)
        path, node = f"{path}{name}/", node[name]
    return tuple(out)


def test_shard_tree(spark):
    df = spark.createDataFrame([(i, "clash") for i in range(3000)] + [(None, "x"), (5, "x")], "doc_id long, __key string")
    placed = shard_tree.place(df, "doc_id")
    out = placed.collect()
    assert placed.columns == ["doc_id", "__key", "region", "rack", "shard"] and {r["__key"] for r in out} == {"clash", "x"}
    with pytest.raises(ValueError, match="rack"):
        shard_tree.place(df.withColumnRenamed("__key", "Rack"), "doc_id")
    clash = shard_tree.place(df.withColumnRenamed("__key", "rack"), "doc_id", names=("r1", "r2", "r3"))
    assert clash.columns == ["doc_id", "rack", "r1", "r2", "r3"] and {(r.r1, r.r2, r.r3) for r in clash.collect()} == {(r.region, r.rack, r.shard) for r in out}
    tie = {"b": {"x": {"s": 1.0}}, "a": {"x": {"s": 1.0}}}
    assert "struct(" in shard_tree._choice(tie, "", "k") and shard_tree._choice(tie, "", "k").index("'a'") < shard_tree._choice(tie, "", "k").index("'b'")
    assert all((r.region, r.rack, r.shard) == slow_place_key("null" if r.doc_id is None else r.doc_id, shard_tree.TREE) for r in out)
    share = Counter(r.region for r in out)
    total = shard_tree.weight(shard_tree.TREE)
    assert all(abs(share[n] / len(out) - shard_tree.weight(c) / total) < 0.04 for n, c in shard_tree.TREE.items())
    assert shard_tree.place(df.where("false"), "doc_id").count() == 0


def test_movement_is_confined(spark):
    changed = {r: {k: dict(s) for k, s in racks.items()} for r, racks in shard_tree.TREE.items()}
    changed["north"]["n3"]["n3c"] = 4.0
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: (r.region, r.rack, r.shard) for r in shard_tree.place(df, "doc_id", t).collect()} for t in (shard_tree.TREE, changed))
    moved = [i for i in a if a[i] != b[i]]
    assert moved and all(b[i][0] == "north" for i in moved)  # the weights of north, n3 and n3c have changed
    assert all(b[i][:2] == ("north", "n3") for i in moved if a[i][0] == "north")
    assert all(b[i][2] == "n3c" for i in moved if a[i][1] == "n3")
    none = {"a": {"b": {"c": 0.0}}}
    assert shard_tree.place(df, "doc_id", none).where("region IS NOT NULL").count() == 0


# 7. fixity


def fixity_rows():
    rows = [(i, f"http://h/{i}", "payload %d " % i * (i % 50 + 1), "clash") for i in range(9000)]
    return rows + [(None, None, None, "x"), (None, "http://h/n", "no id", "x"), (50, "http://h/50", "again", "x"), (51, "http://h/51", rows[51][2], "x"), (12288, None, "z" * 300_000, "x")]


def fixity_records(spark, rows):
    return fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string, hash string"))


def test_fixity_finds_what_differs(spark):
    rows = fixity_rows()
    a = fixity_records(spark, rows)
    damage = {17: lambda h: h[:-1] + "X", 4095: lambda h: h[:-1], 300: lambda h: h + "!!", 12288: lambda h: "y" + h[1:]}
    lost = {4096, 8000, 0}
    new = [(-1, "http://h/new", "new", ""), (20000, "u", "new", "")]
    b = fixity_records(spark, [(i, u, damage[i](h) if i in damage else h, c) for i, u, h, c in rows if i not in lost] + new)
    want = {i: "corrupt" for i in damage} | {i: "missing" for i in lost} | {i: "extra" for i, *_ in new}
    got = fixity.audit(a, b).collect()
    assert len(got) == len(want) and {r.page_id: r.status for r in got} == want
    other = {"corrupt": "corrupt", "missing": "extra", "extra": "missing"}
    back = fixity.audit(b, a).collect()
    assert len(back) == len(want) and {r.page_id: r.status for r in back} == {k: other[v] for k, v in want.items()}
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a, a.where("false")).count() == len(rows) - 2 and fixity.audit(a.where("false"), a.where("false")).count() == 0


@pytest.mark.parametrize("change,status", [(lambda rows: rows[:700] + rows[701:], "missing"), (lambda rows: [*rows[:700], (700, rows[700][1], rows[700][2] + "!!", ""), *rows[701:]], "corrupt"), (lambda rows: [*rows[:700], (700, rows[700][1], rows[700][2][:-3], ""), *rows[701:]], "corrupt")])
def test_one_damaged_record_is_one_row(spark, change, status):
    rows = fixity_rows()[:1000]
    got = fixity.audit(fixity_records(spark, rows), fixity_records(spark, change(rows))).collect()
    offset = sum(len(fixity_text(r)) for r in rows[:700])
    assert [(r.page_id, r.offset, r.status) for r in got] == [(700, offset, status)]
    extra = fixity.audit(fixity_records(spark, rows[:700] + rows[701:]), fixity_records(spark, rows)).collect()
    assert [(r.page_id, r.offset, r.status) for r in extra] == [(700, offset - len(fixity_text(rows[699])), "extra")]


def fixity_text(row):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {row[1]}\r\nWARC-Record-ID: <urn:page:{row[0]}>\r\nContent-Length: {len(row[2])}\r\n\r\n{row[2]}\r\n\r\n"


def test_fixity_of_repeated_records(spark):
    rows = [(1, "u", "same", "")] * 500 + [(None, "u", "no id", "")] * 400 + [(2, "u", "a", ""), (2, "u", "b", "")]
    a = fixity_records(spark, rows)
    assert a.count() == 4
    assert fixity.audit(a, fixity_records(spark, rows[::-1])).count() == 0
    got = {(r.page_id, r.status) for r in fixity.audit(a, fixity_records(spark, [*rows[1:901], (2, "u", "a", ""), (2, "u", "c", "")])).collect()}
    assert got == {(1, "missing"), (2, "corrupt")}
    assert {(r.page_id, r.status) for r in fixity.audit(a, fixity_records(spark, [*rows, (None, "u", "no id", "")])).collect()} == {(None, "extra")}
    changed = [*rows[:899], (None, "u", "other", ""), *rows[900:]]
    assert sorted(r.status for r in fixity.audit(a, fixity_records(spark, changed)).collect()) == ["extra", "missing"]


# 8. language


def test_language_fusion(spark, empty):
    rows = corpus(200, 8)
    df = frame(spark, [(r[0], r[1], ("de" if r[2] == "en" else "en") if r[0] % 20 == 3 else r[2], *r[3:]) for r in rows] + odd())
    out = language.identify(df).toPandas()
    assert len(out) == 208
    found = out.set_index("doc_id").language
    assert all(found[r[0]] == r[2] for r in rows)
    assert out.posterior.between(0, 1.0000001).all()
    kept = language.keep_certain(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.lang for r in kept.where("doc_id < 200").collect()} == {r[0]: r[2] for r in rows}
    assert language.identify(empty).count() == 0 and language.keep_certain(empty).count() == 0


def test_host_and_suffix_decide_where_text_does_not(spark):
    rows = [(i, prose(random.Random(i), "de" if i % 2 else "en", 40), "de" if i % 2 else "en", f"https://www.a{i % 2}.example.{'de' if i % 2 else 'uk'}/x") for i in range(120)]
    rows += [(500, "123", None, "https://www.a1.example.de/y"), (501, None, None, "https://b.example.uk/"), (502, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    out = {r.doc_id: r for r in language.identify(df, address="url", host=None).collect()}
    assert out[500].language == "de" and out[500].keep
    assert out[501].language == "en"
    assert not out[502].keep


def test_language_ties(spark):
    """Two languages with the same texts: whatever is as probable in both is the one that sorts first."""
    rows = [(2 * i + j, prose(random.Random(i), "en", 60), "bb" if j else "aa", "s") for i in range(40) for j in range(2)]
    out = language.identify(frame(spark, rows + [(900, prose(random.Random(1), "en", 60), None, "s")])).collect()
    assert next(r for r in out if r.doc_id == 900).language == "aa"
    assert {r.language for r in out} == {"aa"}


def test_rare_languages_stay(spark):
    """A language of a few thousandths of a per cent is learned if it has the text, and stands by its declaration if it hasn't."""
    rng = random.Random(21)
    few = "ja nej och inte skog vatten morgon kväll fönster trädgård berg flod gul bord människor bro".split()
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(words)[:3] for _ in range(n))
    rows = [(i, prose(rng, "en" if i % 2 else "de", 30), "en" if i % 2 else "de", "s0") for i in range(9000)]
    rows += [(20000 + i, text(few, 200), "sv", "s0") for i in range(8)] + [(20008, text(few, 200), None, "s0")]
    rows += [(30000, "ukuthi abantu bahamba ehlathini ebusuku", "zu", "s0"), (30001, text(few, 60), " ", "s0"), (30002, "123", "und", "s0")]
    model = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in language.identify(model).where("doc_id >= 20000").collect()}
    assert all(out[20000 + i].language == "sv" and out[20000 + i].keep and out[20000 + i].posterior >= 0.9 for i in range(9))
    assert (out[30000].language, out[30000].posterior, out[30000].keep) == ("zu", None, True)
    assert out[30001].language == "sv" and not out[30002].language == "zu"
    kept = {r.doc_id: r.lang for r in language.keep_certain(model).where("doc_id >= 20000").collect()}
    assert kept[20000] == "sv" and kept[30000] == "zu"


def test_many_languages_count_alike(spark, monkeypatch):
    """Counts of languages beyond a task's slots are passed on, none lost."""
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 20), f"l{i % 7}") for i in range(140)]
    batch = pa.RecordBatch.from_pylist([{"text": t, "d": d} for _, t, d in rows])
    tally = lambda: sorted(pa.Table.from_batches(language._counts([batch, batch])).group_by(["d", "bucket"]).aggregate([("n", "sum")]).to_pandas().itertuples(index=False, name=None))
    want = tally()
    monkeypatch.setattr(language, "_SLOTS", 3)
    assert tally() == want and {r[0] for r in want} == {f"l{i}" for i in range(7)}


# 9. near copies


def copies(seed=11):
    rng = random.Random(seed)
    rows, i = [], 0
    for base in range(40):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 10))) for _ in range(120)]
        for _ in range(1 + base % 4):
            own = [w if rng.random() > 0.02 else "".join(rng.choice("qrstuv") for _ in range(7)) for w in words]
            rows.append((i, " ".join(own), "en", "s0"))
            i += 1
    return rows


def nodes_of(spark, f):
    return spark.createDataFrame([(i, *map(int, row.view(np.int64))) for i, row in enumerate(f)], "id long, " + ", ".join(f"{c} long" for c in near_dedup.FINGERPRINT))


def flipped(rng, row, bits):
    out = np.unpackbits(row.view(np.uint8), bitorder="little")
    out[rng.permutation(len(out))[:bits]] ^= 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def parts(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("low,high,least", [(1, 31, 1.0), (32, 48, 0.99), (49, 56, 0.97), (57, 64, 0.93)])
def test_near_pairs_by_distance(spark, low, high, least):
    """Pairs of random fingerprints at each distance: all up to 31 bits, and nearly all up to the radius."""
    rng = np.random.default_rng(low)
    base = rng.integers(0, 1 << 63, (600, near_dedup.WORDS), dtype=np.int64).view(np.uint64)
    f = np.concatenate([base, [flipped(rng, row, low + i % (high - low + 1)) for i, row in enumerate(base)]])
    got = {r.node: r.root for r in near_dedup.linked(near_dedup.cut(nodes_of(spark, f))).collect()}
    assert all(got[n] == n % 600 for n in got) and len(got) >= 2 * 600 * least


def test_components_are_those_of_all_pairs(spark):
    """A hot group of near copies that drift away from the first, strangers that share its segments, and chains between groups."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (30, near_dedup.WORDS), dtype=np.int64).view(np.uint64)
    f = [*base, *(flipped(rng, base[0], 12 + i % 18) for i in range(150)), *(flipped(rng, base[1 + i % 29], 30) for i in range(60))]
    for i in range(60):  # same first words, other rest
        mixed = rng.integers(0, 1 << 63, near_dedup.WORDS, dtype=np.int64).view(np.uint64)
        mixed[:3] = base[0][:3]
        f.append(mixed)
        f.append(flipped(rng, mixed, 25))
    for _ in range(12):
        f.append(flipped(rng, f[-1], 31))
    f = np.array(f)
    distance = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    want = parts([(int(i), int(j)) for i, j in np.argwhere(distance <= 31) if i < j], len(f))
    got = {r.node: r.root for r in near_dedup.linked(near_dedup.cut(nodes_of(spark, f)), radius=31).collect()}
    assert {n: got.get(n, n) for n in range(len(f))} == want
    size = Counter(want.values())
    assert set(got) == {n for n in want if size[want[n]] > 1}
    met = near_dedup.meetings(nodes_of(spark, f))
    assert met.count() < 150 * len(f) and met.where("home").groupBy("key").count().agg(F.max("count")).first()[0] > 50


def test_groups_of_copies(spark, empty):
    rows = copies()
    df = frame(spark, rows + [(2000 + i, rows[0][1], "en", "s0") for i in range(50)] + odd())
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not any(i is not None and i >= 2000 for i in ids)
    assert ids.count(903) == 1 and ids.count(None) == 1 and {900, 901, 902, 904, 905} <= set(ids)
    starts, i = set(), 0
    for base in range(40):
        starts.add(i)
        i += 1 + base % 4
    assert {x for x in ids if x is not None and x < 900} == starts
    gone = {r.doc_id: r.duplicate_of for r in near_dedup.duplicates(df).collect()}
    assert set(gone) == ({r[0] for r in rows} - starts) | {2000 + i for i in range(50)} and gone[2049] == 0
    assert near_dedup.keep_one(empty).count() == 0 and near_dedup.duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(35)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(r == find(n) for n, r in got.items()) and {x for e in edges if e[0] != e[1] for x in e} == set(got)
