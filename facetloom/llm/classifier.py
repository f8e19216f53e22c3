"""Quality classifier with supervised subword embeddings.

Every word and every 3, 4 and 5 bytes within a word (with the blank before or after it) is hashed to one of 2^BITS vectors; a document is
the average of its vectors, and a softmax over (quality, toxic) classes reads it. Vectors and output layer are learned together on the
driver by numpy stochastic gradient descent with per-coordinate step sizes. To score, each vector is multiplied by the output layer
once, so a document costs a table lookup and a sum for each feature; texts are scored whole.

Training reads at most ``most_labelled`` labelled documents (those with the least hash of doc_id, of the labels that have a document); the bound is a
parameter and keeps the driver's memory fixed. Of each the whole text is learned from: a document is sent as its distinct buckets and their counts,
of which there are at most 2^BITS however long it is. Everything else covers all rows.

Defined cases: null and blank texts score as the output layer's bias. Labels with nulls, or whose document or text is missing, aren't
learned from; of several labels for one doc_id, and of several documents with it, each counts, in order of hash of id, id, label and text. With no labels at all every class is as probable as every other. Ties keep
(probability of 0.5 is good enough). Repeated rows and null ids are scored one by one. Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, cut, join_checked, span_hashes, word_bounds

BITS = 17
GRAMS = (3, 4, 5)
DIM = 8
MOST_LABELLED = 4000
#: (quality, toxic) of each class.
CLASSES = ((0, 0), (1, 0), (0, 1), (1, 1))


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of words, then of n-grams of each size."""
    start, end = word_bounds(raw, offsets)
    out = [(start, (span_hashes(raw, start, end) >> np.uint64(64 - BITS)).astype(np.int64))]
    n = len(raw)
    blank = raw <= 32
    inner = np.cumsum(np.concatenate(([0], blank)))
    x = np.where(blank, np.uint8(32), raw).astype(np.uint32)
    last = np.zeros(n + 1, bool)
    last[offsets] = True
    cuts = np.cumsum(last)[:n]  # which text a byte lies in
    h = x
    for size in range(2, max(GRAMS) + 1):
        if n < size:
            break
        h = h[: n - size + 1] * np.uint32(0x01000193) ^ x[size - 1 :] * np.uint32(0x9E3779B1)
        if size in GRAMS:
            good = (inner[size - 1 : n] - inner[1 : n - size + 2]) == 0  # no blank but first or last
            good &= cuts[size - 1 :] == cuts[: n - size + 1]
            at = np.flatnonzero(good)
            g = h[at]
            out.append((at, ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int64)))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of each text its distinct buckets and their counts, packed, with their number n."""
    for batch in batches:
        for part, raw, offsets in byte_chunks(batch, "text"):
            found = features(raw, offsets)
            bounds = [np.searchsorted(at, offsets) for at, _ in found]
            data, size = [], []
            for i in range(part.num_rows):
                bucket, n = np.unique(np.concatenate([b[k[i] : k[i + 1]] for (_, b), k in zip(found, bounds, strict=True)]), return_counts=True)
                data.append(pa.compress(np.concatenate((np.diff(bucket, prepend=0), n)).astype("<i4").tobytes(), "zstd", asbytes=True))
                size.append(len(bucket))
            keep = [i for i, name in enumerate(part.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=[*(part.schema.names[i] for i in keep), "n", "data"])


def unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and counts of a document."""
    both = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), "<i4") if n else np.zeros(0, np.int32)
    return np.cumsum(both[:n]), both[n:]


def train(docs: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, epochs: int = 12, rate: float = 3.0, batch: int = 32, seed: int = 7) -> np.ndarray:
    """A table of scores, class by class, for each bucket; its last row is the bias. ``docs`` are distinct buckets and counts."""
    k = len(CLASSES)
    if not len(docs):
        return np.zeros(((1 << BITS) + 1, k), np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    output, bias = rng.normal(0, 1 / np.sqrt(DIM), (DIM, k)), np.log(np.bincount(classes, minlength=k) + 0.5)
    bias -= bias.mean()
    seen_v, seen_o, seen_b = np.full((1 << BITS, DIM), 1e-8, np.float32), np.full((DIM, k), 1e-8), np.full(k, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            size = [len(docs[r][0]) for r in rows]
            used, code = np.unique(np.concatenate([docs[r][0] for r in rows]), return_inverse=True)
            part = np.zeros((len(rows), len(used)), np.float32)
            part[np.repeat(np.arange(len(rows)), size), code] = np.concatenate([docs[r][1] for r in rows])
            part /= np.maximum(part.sum(1, keepdims=True), 1)
            mine = vectors[used]
            mean = part @ mine
            z = mean @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), classes[rows]] -= 1
            p /= len(rows)
            back = part.T @ (p @ output.T).astype(np.float32)
            for value, seen, grad in ((output, seen_o, mean.T @ p), (bias, seen_b, p.sum(0))):
                seen += grad * grad
                value -= step * grad / np.sqrt(seen)
            total = seen_v[used] + back * back
            seen_v[used] = total
            vectors[used] = mine - step * back / np.sqrt(total)
    return np.vstack([vectors @ output, bias]).astype(np.float32)


def examples(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Distinct buckets and counts, and the class, of at most ``most_labelled`` labelled documents."""
    order = [F.xxhash64("__id"), F.col("__id"), F.col("quality"), F.col("toxic")]
    named = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("text IS NOT NULL")
    there = join_checked(texts.select("__id"), cut(named.select("__id").distinct()), ["__id"], "left_semi").distinct()
    chosen = cut(named.join(there, "__id", "left_semi").orderBy(*order).limit(most_labelled))
    rows = join_checked(texts, chosen, ["__id"], "inner").select("__id", "quality", "toxic", F.xxhash64("text").alias("h"), "text")
    rows = rows.mapInArrow(_counted, "__id long, quality int, toxic int, h long, n int, data binary")
    got = rows.orderBy(*order, "h").limit(most_labelled).select("quality", "toxic", "n", "data").toArrow()
    classes = np.array(got.column("quality").to_pylist(), int) + 2 * np.array(got.column("toxic").to_pylist(), int)
    return [unpack(n, data) for n, data in zip(got.column("n").to_pylist(), got.column("data").to_pylist(), strict=True)], classes


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, **how) -> np.ndarray:
    """The table of scores learned from a bounded sample of the labelled documents."""
    return train(*examples(docs, labels, most_labelled), **how)


def _scores(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = table.value
        k = scores.shape[1]
        for batch in batches:
            for part, raw, offsets in byte_chunks(batch, "text"):
                total, n = np.zeros((len(offsets) - 1, k)), np.zeros(len(offsets) - 1)
                for at, bucket in features(raw, offsets):
                    bounds = np.searchsorted(at, offsets)
                    n += np.diff(bounds)
                    for c in range(k):
                        run_sum = np.concatenate(([0], np.cumsum(scores[bucket, c], dtype=np.float64)))
                        total[:, c] += run_sum[bounds[1:]] - run_sum[bounds[:-1]]
                z = total / np.maximum(n, 1)[:, None] + scores[-1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                good = sum(p[:, c] for c, (q, _) in enumerate(CLASSES) if q)
                toxic = sum(p[:, c] for c, (_, t) in enumerate(CLASSES) if t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(good), pa.array(toxic)], names=["doc_id", "p_quality", "p_toxic"])

    return run


def score(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, the probabilities of being good and of being toxic, and keep, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(sent), "doc_id long, p_quality double, p_toxic double")
    return rows.withColumn("keep", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5))
