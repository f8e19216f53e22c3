"""Tokenising and counting whole Arrow batches with numpy: bytes are classed at once, words never become Python objects (but to be stemmed, each distinct one once)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import STOP_WORDS

#: Bytes of text that are looked at together; a longer text is looked at alone, and whole.
CHUNK = 1 << 20
#: Words whose stems a task keeps.
KNOWN = 200_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[48:58] = _WORD[128:] = True
SCHEMA = "doc_id long, term string, tf long, doc_length long"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of stretches of a batch of (doc_id, text) without nulls."""
    text = batch.column(1)
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    n = len(text)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        yield batch.column(0).slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in order, 2 to 100 bytes, ASCII folded, stop words among them; and which text each is of."""
    folded = _FOLD[raw]
    inner = _WORD[folded]
    if not inner.any():
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:-1]
    ends[:-1] &= ~inner[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    fits = (size >= 2) & (size <= 100)
    start, end, size = start[fits], end[fits], size[fits]
    step = np.zeros(len(raw) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    data = folded[np.cumsum(step[:-1], dtype=np.int8) > 0]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(offsets, start, side="right") - 1


def _counter(stem: Callable[[str], str] | None, lengths: bool, numbers: bool = False):
    stop = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for ids, raw, offsets in _chunks(batch):
                found, doc = words(raw, offsets)
                codes = found.dictionary_encode()
                terms = codes.dictionary.to_pylist()
                live = np.array([t not in stop for t in terms], bool)
                code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc, code = doc[live[code]] if len(code) else doc, code[live[code]] if len(code) else code
                if stem is not None:
                    for t in terms:
                        if t not in known:
                            known[t] = stem(t)
                    merged: dict[str, int] = {}
                    to = np.array([merged.setdefault(known[t], len(merged)) for t in terms], np.int64)
                    code, terms = to[code] if len(code) else code, list(merged)
                size = np.bincount(doc, minlength=len(ids)).astype(np.int64)
                key, tf = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
                at, code = key // max(1, len(terms)), key % max(1, len(terms))
                columns = [ids.take(pa.array(at)), pa.array(terms, pa.string()).take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(size[at])]
                if lengths:  # one row more for each document, of no term
                    n = len(ids)
                    columns = [pa.concat_arrays([c, x]) for c, x in zip(columns, [ids, pa.array([""] * n, pa.string()), pa.array(np.bincount(at if numbers else at[:0], minlength=n).astype(np.int64)), pa.array(size)], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "tf", "doc_length"])
                if len(known) > KNOWN:
                    known.clear()
            del batch
            pa.default_memory_pool().release_unused()

    return run


def counted(df: DataFrame, key: str, text: Column, stem: Callable[[str], str] | None = None, lengths: bool = True, numbers: bool = False) -> DataFrame:
    """doc_id, term, tf, doc_length: a row for each term of each text and, with ``lengths``, one of the empty term (tf 0 or, with ``numbers``, its number of terms) for each text that isn't null or empty. One narrow pass, no shuffle."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), text.alias("t")).where("t IS NOT NULL AND t <> ''")
    return rows.mapInArrow(_counter(stem, lengths, numbers), SCHEMA)
