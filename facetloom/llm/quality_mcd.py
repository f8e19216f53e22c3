"""Quality rules: robust multivariate outliers.

Every document becomes a vector of transformed text statistics. For each language and source the centre and scatter of
the vectors are estimated by minimum covariance determinant (deterministic starts, then concentration steps, then
reweighting), and documents whose squared Mahalanobis distance exceeds a chi-square quantile are rejected.

A concentration step is one grouped aggregation: the squared distances fall in narrow logarithmic bins, each bin gathers
count, sums and products of its vectors, and the bins up to the h-th smallest distance (the last one in part) make the new
centre and scatter. No group is ever brought to one place, so a source that holds most of the corpus costs no more than others.
A group's steps end when its scatter's log-determinant falls by less than ``tolerance``; as it is bounded below, they all end.

Every group has an estimate of its own, and so have every language and the corpus, over all their documents. A group's centre and scatter are
drawn towards its language's, and a language's towards the corpus', by the weight of ``PRIOR`` documents: a group of a few documents is
judged by its language, one of thousands by itself, and there is no size at which the rule changes.

Defined cases: a null or blank text has no statistics and is rejected with a null distance. Null language or source is a value
of its own. A corpus of one document keeps it. Repeated rows and rows with a null doc_id are judged one by one.
Ties and constant statistics are handled by a floor under the scatter: in no direction is it less than that of the standard deviations in
STATISTICS, and where it is more they don't matter. Only doc_id, text, lang and source are read, so extra
columns can't clash; ``keep_good`` returns all columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import byte_chunks, checked, cut, join_checked, per_text, span_hashes, word_bounds

#: The transformed statistics, and for each a standard deviation below which differences don't count.
STATISTICS = {"log_words": 0.5, "log_word_length": 0.06, "upper_share": 0.06, "point_share": 0.04, "symbol_share": 0.06, "repeat_share": 0.06, "log_variety": 0.12}
D = len(STATISTICS)
#: Share of clean documents beyond the limit, were they normal. Chosen on the labelled rows of sf0.1 with even doc_id, as the largest of 1e-3, 3e-4, 1e-4, .. that loses no good document there.
TAIL = 3e-4
#: Documents that the estimate of the level above weighs as much as.
PRIOR = 80.0
#: Fall of the scatter's log-determinant at which a group's concentration steps end.
TOLERANCE = 0.01
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]

_CLASS = np.zeros(256, np.uint8)  # 1: ordinary punctuation, 2: other symbols
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 2


def vectors(raw: np.ndarray, offsets: np.ndarray, upper: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Statistic vectors of the texts, NaN where a text has no word. Shares are shrunk by some 100 characters or 20 words and taken by square root."""
    start, end = word_bounds(raw, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    m = len(offsets) - 1
    words = np.bincount(doc, minlength=m).astype(float)
    lead = (raw & 0xC0) != 0x80  # one for each character
    solid = per_text(lead & (raw > 32), offsets).astype(float)
    kind = _CLASS[raw]
    point, symbol = (per_text(kind == k, offsets).astype(float) for k in (1, 2))
    hashes = span_hashes(raw, start, end)
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(start), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=m).astype(float)
    out = np.column_stack(
        (
            np.log(words + 20),
            np.log((solid + 120) / (words + 20)),
            np.sqrt(upper / (letters + 100)),
            np.sqrt(point / (solid + 100)),
            np.sqrt(symbol / (solid + 100)),
            np.sqrt(np.bincount(doc[again], minlength=m) / (words + 20)),
            np.log((distinct + 20) / (words + 20)),
        )
    )
    out[words == 0] = np.nan
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in byte_chunks(batch, "__text"):
            ascii_upper = (raw >= 65) & (raw <= 90)
            # Latin, Greek and Cyrillic capitals beyond ASCII: C3 80-9E, CE 91-AB, D0 80-AF
            two = np.zeros(len(raw), bool)
            if len(raw) > 1:
                a, b = raw[:-1], raw[1:]
                two[:-1] = ((a == 0xC3) & (b >= 0x80) & (b <= 0x9E)) | ((a == 0xCE) & (b >= 0x91) & (b <= 0xAB)) | ((a == 0xD0) & (b >= 0x80) & (b <= 0xAF))
            letter = ascii_upper | ((raw >= 97) & (raw <= 122)) | (raw >= 0xC3)
            x = vectors(raw, offsets, per_text(ascii_upper | two, offsets).astype(float), per_text(letter, offsets).astype(float))
            keep = [i for i, name in enumerate(part.schema.names) if name != "__text"]
            arrays = [part.column(i) for i in keep] + [pa.array(x[:, j], pa.float64(), mask=np.isnan(x[:, j])) for j in range(D)]
            yield pa.RecordBatch.from_arrays(arrays, names=[part.schema.names[i] for i in keep] + X)


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, ``__lang``, ``__source`` and the statistic vector x0.. of each row; one narrow pass over the texts."""
    taken = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col("lang"), F.lit("\0")).alias("__lang"), F.coalesce(F.col("source"), F.lit("\0")).alias("__source"), F.col("text").alias("__text"))
    schema = T.StructType([f for f in taken.schema.fields if f.name != "__text"] + [T.StructField(x, T.DoubleType()) for x in X])
    return taken.mapInArrow(_batches, schema)


def chi_square_quantile(p: float, d: float) -> float:
    """The x with P(chi-square of d degrees <= x) = p, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, d) < p else (low, mid)
    return high


def chi_square_cdf(x: float, d: float) -> float:
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    f = 1 / b
    h = f
    for i in range(1, 500):  # Lentz's continued fraction
        k = -i * (i - a)
        b += 2
        f = 1 / (k * f + b)
        c = b + k / c
        h *= f * c
        if abs(f * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(a * math.log(x) - x - math.lgamma(a))


MODEL = T.StructType(
    [T.StructField("g", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("logdet", T.DoubleType())]
    + [T.StructField(f"m{i}", T.DoubleType()) for i in range(D)]
    + [T.StructField(f"w{i}_{j}", T.DoubleType()) for i in range(D) for j in range(i + 1)]
)


FLOOR = np.array(list(STATISTICS.values()))


def whiten(scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """Lower-triangular W with W S W' = 1 and the log-determinant, S being the scatter with no direction's variance below the floor's."""
    values, vectors = np.linalg.eigh(scatter / np.outer(FLOOR, FLOOR))
    low = np.linalg.cholesky((vectors * np.maximum(values, 1)) @ vectors.T) * FLOOR[:, None]
    return np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum())


def _centre_and_scatter(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = sums / n, np.zeros((D, D))
    for (i, j), p in zip(PAIRS, products / n, strict=True):
        cov[i, j] = cov[j, i] = p - mean[i] * mean[j]
    return mean, cov


def _row(mean: np.ndarray, scatter: np.ndarray) -> list[float]:
    w, logdet = whiten(scatter)
    return [logdet, *mean, *(w[i, j] for i in range(D) for j in range(i + 1))]


def _model(scale: float):
    """From moments of a subset (n, s_i, p_i_j about 0) to centre and whitening; scale corrects the scatter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = f[M].to_numpy(float)
            rows = [[g, start, *_row(m, scale * c)] for g, start, n, v in zip(f["g"], f["start"], f["n"], values, strict=True) for m, c in [_centre_and_scatter(max(n, 1e-9), v[:D], v[D:])]]
            yield pd.DataFrame(rows, columns=MODEL.names)

    return run


def _improved(scale: float, tolerance: float):
    """As ``_model``, with the model that the subset was chosen by (old_): where the new one is hardly better the old one stays, and has ended."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = pd.concat([*_model(scale)([f]), pd.DataFrame(columns=MODEL.names)])
            old = f[[f"old_{c}" for c in MODEL.names]].set_axis(MODEL.names, axis=1)
            ended = ~(new["logdet"].to_numpy(float) < old["logdet"].to_numpy(float) - tolerance)
            yield old.where(pd.Series(ended, index=old.index), new.set_axis(old.index)).assign(ended=ended)

    return run


def _shrunk(scale: float):
    """From the moments of a group, its language (l_) and the corpus (a_), and the sizes of group and language, to the group's model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            parts = [(f[f"{x}n"].to_numpy(float), f[[f"{x}{m}" for m in M]].to_numpy(float)) for x in ("a_", "l_", "")]
            for i, (g, size, size_l) in enumerate(zip(f["g"], f["size"], f["l_size"], strict=True)):
                mean = scatter = None
                for (n, v), weight in zip(parts, (0, size_l, size), strict=True):
                    if n[i] > 0:  # no document may lie within the limit of a centre between two that are far apart
                        m, c = _centre_and_scatter(n[i], v[i, :D], v[i, D:])
                        w = 1.0 if mean is None else weight / (weight + PRIOR)
                        mean, scatter = (m, scale * c * (1 + (D + 1) / n[i])) if mean is None else (w * m + (1 - w) * mean, w * scale * c + (1 - w) * scatter)
                if mean is not None:
                    rows.append([g, 0, *_row(mean, scatter)])
            yield pd.DataFrame(rows, columns=MODEL.names)

    return run


def distance() -> Column:
    """Squared Mahalanobis distance of x under the model columns of the row. (One parsed expression: built call by call it would take the driver longer than the job.)"""
    rows = [" + ".join(f"w{i}_{j} * (x{j} - m{j})" for j in range(i + 1)) for i in range(D)]
    return F.expr(" + ".join(f"({r}) * ({r})" for r in rows))


def _moments(x: list[str]) -> list[Column]:
    """Sums and sums of products of expressions."""
    return [F.expr(f"sum({v}) AS s{i}") for i, v in enumerate(x)] + [F.expr(f"sum({x[i]} * {x[j]}) AS p{i}_{j}") for i, j in PAIRS]


M = [f"s{i}" for i in range(D)] + [f"p{i}_{j}" for i, j in PAIRS]


def estimate(stats: DataFrame, share: float = 0.75, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The groups (``__lang``, ``__source`` -> g) and their models (MODEL, of reweighted MCD estimates drawn towards those of language and corpus).

    ``stats`` is read once a step, so it should be a written table. ``share`` of a group's documents make the concentrated subset.
    """
    known = stats.where(F.col("x0").isNotNull())
    name = lambda *parts: F.concat_ws("\1", *parts)
    of_source, of_lang, of_all = name(F.lit("s"), "__lang", "__source"), name(F.lit("l"), "__lang"), F.lit("a")
    sizes = cut(known.groupBy("__lang", "__source").agg(F.count("*").alias("size")))
    groups = sizes.select("__lang", "__source", of_source.alias("g"))
    levels = sizes.select("__lang", "__source", F.explode(F.array(of_source, of_lang, of_all)).alias("g"))
    data = join_checked(known, levels, ["__lang", "__source"], "inner").select("g", *X)

    centre = data.groupBy("g").agg(*[F.expr(f"percentile_approx({x}, array(0.25, 0.5, 0.75), 1000) AS q{i}") for i, x in enumerate(X)])
    centre = cut(centre.select("g", *[F.expr(f"q{i}[1] AS c{i}") for i in range(D)], *[F.expr(f"greatest((q{i}[2] - q{i}[0]) / 1.349D, {floor}D) AS d{i}") for i, floor in enumerate(STATISTICS.values())]))

    # Starts: 0, the coordinates' medians and quartile ranges; 1, the correlations of tanh-compressed scores.
    z = [f"tanh((x{i} - c{i}) / d{i})" for i in range(D)]
    squashed = join_checked(data, centre, ["g"], "inner").groupBy("g").agg(F.count("*").alias("n"), *_moments(z))
    squashed = squashed.join(centre, "g")
    corr = lambda i, j: f"(p{i}_{j} / n - s{i} * s{j} / n / n)"
    unit = lambda i: f"sqrt({corr(i, i)} + 1e-6D)"
    means = [F.expr(f"c{i} AS s{i}") for i in range(D)]
    one = [F.expr(f"{f'd{i} * d{i}' if i == j else '0.0D'} + c{i} * c{j} AS p{i}_{j}") for i, j in PAIRS]
    two = [F.expr(f"{corr(i, j)} / {unit(i)} / {unit(j)} * d{i} * d{j} + c{i} * c{j} AS p{i}_{j}") for i, j in PAIRS]
    starts = squashed.select("g", F.lit(0).alias("start"), F.lit(1.0).alias("n"), *means, *one).unionByName(squashed.select("g", F.lit(1).alias("start"), F.lit(1.0).alias("n"), *means, *two))
    model = cut(starts.mapInPandas(_model(1.0), MODEL))

    consistency = share / chi_square_cdf(chi_square_quantile(share, D), D + 2)

    def concentrated(model: DataFrame) -> DataFrame:
        """Moments of each model's nearest documents."""
        placed = data.join(model, "g").withColumn("d2", distance())
        bins = placed.groupBy("g", "start", F.floor(64 * F.log2(1 + F.col("d2"))).alias("bin")).agg(F.count("*").cast("double").alias("n"), *_moments(X))
        group = Window.partitionBy("g", "start")
        bins = bins.withColumn("all", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n"))
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("all") * share - F.col("before")) / F.col("n")))
        return bins.withColumn("part", part).where("part > 0").groupBy("g", "start").agg(*[F.expr(f"sum({c} * part) AS {c}") for c in ("n", *M)])

    for _ in range(2):
        model = cut(concentrated(checked(model)[0]).mapInPandas(_model(consistency), MODEL))
    best = Window.partitionBy("g").orderBy("logdet", "start")
    active = cut(model.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k"))
    schema = T.StructType([*MODEL.fields, T.StructField("ended", T.BooleanType())])
    model = active.where("false")
    while True:
        hinted, left = checked(active)
        if not left:
            break
        old = hinted.withColumnsRenamed({c: f"old_{c}" for c in MODEL.names})
        stepped = concentrated(hinted).join(old, (F.col("g") == F.col("old_g")) & (F.col("start") == F.col("old_start")))
        stepped = cut(stepped.mapInPandas(_improved(consistency, tolerance), schema))
        model, active = model.unionByName(stepped.where("ended").drop("ended")), stepped.where("NOT ended").drop("ended")

    limit = chi_square_quantile(0.975, D)
    inside = join_checked(data, cut(model), ["g"], "inner").where(distance() <= limit)
    inside = cut(inside.groupBy("g").agg(F.count("*").cast("double").alias("n"), *_moments(X)))
    over = lambda x, key: inside.withColumnsRenamed({c: f"{x}{c}" for c in ("n", *M)} | {"g": key})
    langs = sizes.groupBy("__lang").agg(F.sum("size").alias("l_size"))
    rows = sizes.join(langs, "__lang").select(of_source.alias("g"), of_lang.alias("g_l"), of_all.alias("g_a"), "size", "l_size")
    rows = rows.join(inside, "g", "left").join(over("l_", "g_l"), "g_l", "left").join(over("a_", "g_a"), "g_a", "left")
    return groups, cut(rows.select("g", "size", "l_size", *[f"{x}{c}" for x in ("", "l_", "a_") for c in ("n", *M)]).mapInPandas(_shrunk(0.975 / chi_square_cdf(limit, D + 2)), MODEL))


def judge(stats: DataFrame, groups: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """stats with ``distance2`` and ``keep``: not beyond the chi-square quantile that leaves ``tail``."""
    rows = join_checked(groups, model, ["g"], "left").drop("g", "start", "logdet")
    rows = cut(rows)
    out = join_checked(stats, rows, ["__lang", "__source"], "left").withColumn("distance2", distance())
    return out.withColumn("keep", F.col("x0").isNotNull() & (F.col("distance2").isNull() | (F.col("distance2") <= chi_square_quantile(1 - tail, D))))


def score(docs: DataFrame, tail: float = TAIL, **how) -> DataFrame:
    """doc_id, lang, source, the statistics, distance2 and keep of every row."""
    stats = cut(statistics(docs, ["doc_id", "lang", "source"]))
    groups, model = estimate(stats, **how)
    return judge(stats, groups, model, tail).select("doc_id", "lang", "source", *[F.col(x).alias(n) for x, n in zip(X, STATISTICS, strict=True)], "distance2", "keep")


def keep_good(docs: DataFrame, tail: float = TAIL, **how) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The texts are read twice rather than shuffled."""
    groups, model = estimate(cut(statistics(docs, [])), **how)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], "lang", "source", "text")
    judged = judge(statistics(inner, [f"__c{i}" for i in range(len(names))]), groups, model, tail)
    return judged.where("keep").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
