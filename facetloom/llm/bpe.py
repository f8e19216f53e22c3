"""BPE encoding and decoding over a distinct-word table.

Texts are split into pre-tokens in Spark. A block is a stretch of a scan's rows; it has the list of its distinct words and, for each
word of each text in order, the word's position in the list. The blocks' lists are dealt by hash of the word, so that every distinct word
of the corpus meets all its mentions in one place (the distinct-word table) and is encoded once; its ids go back to the block and the
position that asked. What is shuffled is the lists, a fraction of the text, and the positions, never a row for each word of the corpus.
The texts are read and split once: lists and positions leave by one shuffle, that both the table and the blocks read. A place takes its lists one
after another and keeps only its distinct words with their ids. The input may come in any order; if an executor is lost while an
input that itself comes from a shuffle is read, a block's checksum can differ from its lists', which is an error, never a wrong result.

Decoding joins ids to the vocabulary's pieces: the piece table is as large as the vocabulary, whatever the corpus, and goes to every
worker, where the ids of a batch gather their pieces at once.

Defined cases: a null text has null ids, an empty one none. An id that is null or outside the vocabulary makes the decoded bytes null.
Rows are encoded one by one, so repeated rows, null and equal doc_ids don't matter. Texts are encoded whole. Only doc_id and text are
read, so extra columns can't clash; ``decode`` keeps all columns and adds one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary
from .common import mix, span_hashes

#: Words of a block; a text of more is a block of its own.
BLOCK = 1_500_000
#: Places of the distinct-word table for each partition of the scan, and least number of them.
PLACES = 4, 12


def _packed(*arrays: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    for a in arrays:
        batch = pa.RecordBatch.from_arrays([a], names=["x"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[pa.Array]:
    source, out = pa.BufferReader(data), []
    while source.tell() < len(data):
        with pa.ipc.open_stream(source) as reader:
            out.append(reader.read_next_batch().column(0))
            for _ in reader:
                pass
    return out


def _planes(x: np.ndarray) -> pa.Array:
    """Bytes of 32-bit numbers, all lowest bytes first, which compress better."""
    return pa.array([np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary())


def _whole(a: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(a[0].as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(number, doc_id, h, words as a list array without nulls, validity) of each block of this partition."""
    number = 0
    for batch in batches:
        words = batch.column(2)
        offsets = words.offsets.to_numpy().astype(np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
            j = min(j, batch.num_rows)
            flat = words.values.slice(offsets[i], offsets[j] - offsets[i])
            yield number, batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), flat, np.diff(offsets[i : j + 1]), words.slice(i, j - i).is_valid()
            number += 1
            i = j


def _distinct(flat: pa.Array, places: int):
    """Positions of the words in the block's list, the list as bytes, and the list's order by place with each place's bounds."""
    codes = flat.dictionary_encode()
    words = codes.dictionary.cast(pa.binary())
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]] if n and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    place = (mix(span_hashes(raw, off[:-1], off[1:]) if n else np.zeros(0, np.uint64)) % np.uint64(places)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(places + 1))
    return codes.indices.to_numpy(zero_copy_only=False), words, order, bounds


def _check(h: pa.Array) -> int:
    return zlib.crc32(np.ascontiguousarray(h.fill_null(0).to_numpy(zero_copy_only=False)).tobytes())


MIXED = "k long, part int, number int, crc long, data binary"


def _split(places: int):
    """For each block its list of distinct words, place by place (k: the place), and its texts as positions in the lists (k < 0: the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, doc, h, flat, sizes, valid in _blocks(batches):
            codes, words, order, bounds = _distinct(flat, places)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))  # the order in which the places' answers lie
            at = np.flatnonzero(np.diff(bounds))
            data = [_packed(words.take(pa.array(order[bounds[p] : bounds[p + 1]]))) for p in at]
            data.append(_packed(doc, h, valid, _planes(sizes), _planes(rank[codes] if len(codes) else codes)))
            n = len(data)
            keys = np.append(at, -1 - (part << 31 | number))
            same = lambda x, kind, n=n: pa.array(np.full(n, x, kind))
            yield pa.RecordBatch.from_arrays([pa.array(keys), same(part, np.int32), same(number, np.int32), same(_check(h), np.int64), pa.array(data, pa.binary())], names=["k", "part", "number", "crc", "data"])

    return run


def _answers(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder(ranks.value)
        known: dict[bytes, int] = {}  # the place's distinct words, each encoded once
        size, flat = np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        start, filled = np.zeros(1024, np.int64), 0
        for batch in batches:
            out = []
            for data in batch.column(4).to_pylist():
                words = _unpacked(data)[0].to_pylist()
                code = np.empty(len(words), np.int64)
                for i, w in enumerate(words):
                    c = known.get(w)
                    if c is None:
                        c = known[w] = len(known)
                        ids = encode(w)
                        if c == len(size):
                            size, start = np.resize(size, 2 * c), np.resize(start, 2 * c)
                        while filled + len(ids) > len(flat):
                            flat = np.resize(flat, 2 * len(flat))
                        size[c], start[c] = len(ids), filled
                        flat[filled : filled + len(ids)] = ids
                        filled += len(ids)
                    code[i] = c
                out.append(_packed(_planes(size[code]), _planes(flat[_ranges(start[code], size[code])])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (1, 2, 3)), pa.array(out, pa.binary())], names=["place", "part", "number", "crc", "ids"])

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (size[0] of them), start[1], .."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(start - (end - size), size)


def _joined(texts: pa.Table, answers: pa.Table) -> pa.Table:
    if texts.num_rows != 1 or len(set(answers.column("crc").to_pylist()) - {texts.column("crc")[0].as_py()}):
        raise RuntimeError("an executor was lost and the documents came in another order when they were read again; encode a written table")
    doc, h, valid, sizes, codes = _unpacked(texts.column("data")[0].as_py())
    parts = [_unpacked(x) for _, x in sorted(zip(answers.column("place").to_pylist(), answers.column("ids").to_pylist(), strict=True))]
    size = np.concatenate([_whole(p[0]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([_whole(p[1]) for p in parts] or [np.zeros(0, np.uint32)])
    start = np.concatenate(([0], np.cumsum(size)))
    codes, sizes = _whole(codes).astype(np.int64), _whole(sizes).astype(np.int64)
    ids = flat[_ranges(start[codes], size[codes])].astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(size[codes])))[np.concatenate(([0], np.cumsum(sizes)))]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.concatenate((~np.asarray(valid), [False]))), pa.array(ids))
    return pa.table({"doc_id": doc, "h": h, "ids": lists})


def encode(docs: DataFrame, path: str = vocabulary.PATH) -> DataFrame:
    """doc_id, h (xxhash64 of the text) and ids of every row."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), vocabulary.split_words(F.col("text")).alias("words"))
    each, least = PLACES
    places = each * docs.rdd.getNumPartitions() + least
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))
    mixed = words.mapInArrow(_split(places), MIXED).repartition("k")
    # the partition's number keeps the conditions above the shuffle, so that there is one for both
    only = lambda condition: mixed.where(F.expr(f"CASE WHEN spark_partition_id() >= 0 THEN {condition} END"))
    answers = only("k >= 0").groupBy("k").applyInArrow(_answers(ranks), "place long, part int, number int, crc long, ids binary")
    answers = answers.withColumn("k", -1 - F.shiftleft(F.col("part").cast("long"), 31).bitwiseOR(F.col("number").cast("long")))
    return only("k < 0").groupBy("k").cogroup(answers.groupBy("k")).applyInArrow(_joined, "doc_id long, h long, ids array<int>")


def _pieces(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for piece, i in ranks.value.items():
            table[i] = piece
        pieces = pa.array(table, pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__ids"))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            wrong = pc.or_(pc.is_null(ids), pc.or_kleene(pc.less(ids, 0), pc.greater_equal(ids, len(table)))).fill_null(True)
            wrong = np.asarray(wrong)
            ids = pc.if_else(pa.array(~wrong), ids, 0).fill_null(0) if wrong.any() else ids
            got = pieces.take(ids)
            ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
            at = ends[offsets]
            bad = ~np.asarray(lists.is_valid()) | (np.diff(np.concatenate(([0], np.cumsum(wrong)))[offsets]) > 0)
            data = got.buffers()[2] if len(got) else pa.py_buffer(b"")
            text = pa.Array.from_buffers(pa.large_binary(), len(lists), [pa.py_buffer(np.packbits(~bad, bitorder="little").tobytes()), pa.py_buffer(np.ascontiguousarray(at)), data]).cast(pa.binary())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), text], names=[*(batch.schema.names[i] for i in keep), "__bytes"])

    return run


def decode(encoded: DataFrame, path: str = vocabulary.PATH, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns, and the bytes that the ids stand for."""
    names = encoded.columns
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary.load(path))
    inner = encoded.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([f for f in inner.schema.fields if f.name != "__ids"] + [T.StructField("__bytes", T.BinaryType())])
    return inner.mapInArrow(_pieces(ranks), schema).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__bytes").alias(into))
