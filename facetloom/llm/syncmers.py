"""Document fingerprints by closed syncmers.

Of all K-byte stretches of a text (case folded) those are kept whose least S-byte stretch, by hash, is their first or their last.
Whether a stretch is kept depends on its own bytes alone, so a passage has the same anchors wherever it stands, and their positions
line up between documents (``align``). In every K - S successive stretches at least one is kept.

Defined cases: a null text has null anchors; a text of fewer than K bytes has none. Ties: a stretch is kept if its first or last
value equals the least. Repeated rows and null ids are treated one by one. Texts are read whole; positions count bytes of UTF-8 from 0.
Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, fold_case, mix

K, S = 40, 8


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each closed syncmer of the texts."""
    n = len(raw) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = fold_case(raw).astype(np.uint64)
    for shift in (1, 2, 4):  # to 8 bytes in a number
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    order = mix(x * np.uint64(0x9E3779B97F4A7C15))
    span = K - S  # the last S-byte stretch begins so far behind the first
    least, width = order, 1
    while 2 * width <= span + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span + 1 - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    least = least[:n]
    keep = (order[:n] == least) | (order[span : span + n] == least)
    for end in offsets[1:-1].tolist():  # stretches across a text's end
        keep[max(0, end - K + 1) : end] = False
    at = np.flatnonzero(keep)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(0, K, S):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + x[at + back] + np.uint64(back + 1))
    return at, h


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in byte_chunks(batch, "text"):
            at, h = anchors(raw, offsets)
            bounds = np.searchsorted(at, offsets)
            null = ~np.asarray(part.column(1).is_valid())
            ends = pa.array(bounds.astype(np.int32), mask=np.concatenate((null, [False])))
            place = (at - np.repeat(offsets[:-1], np.diff(bounds))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["doc_id", "positions", "hashes"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the positions and hashes of the anchors of every row; one narrow pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, "doc_id long, positions array<int>, hashes array<long>")


def align(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """left_id, right_id, shift, anchors, left_start, left_end: where fingerprints share at least ``least`` anchors at one distance.

    Positional matching: anchors meet by hash, and those of one passage lie on one diagonal (left position less right position). ``left`` is a
    stated set of queries (benchmark passages, say) and ``right`` all documents: what an anchor costs is its queries times its documents, each of
    which is a match. Null ids match nothing; a row repeated with its id counts once.
    """
    flat = lambda df, side: df.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(f"{side}_id"), F.explode(F.arrays_zip("positions", "hashes")).alias("a")).select(f"{side}_id", F.col("a.positions").alias(f"{side}_at"), F.col("a.hashes").alias("hash"))
    met = flat(left, "left").join(flat(right, "right"), "hash").withColumn("shift", F.col("left_at") - F.col("right_at"))
    lines = met.groupBy("left_id", "right_id", "shift").agg(F.countDistinct("left_at").alias("anchors"), F.min("left_at").alias("left_start"), (F.max("left_at") + K).alias("left_end"))
    return lines.where(F.col("anchors") >= least)
