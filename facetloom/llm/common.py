"""Session, storage and byte-level helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that may be broadcast; every broadcast of a table that could grow is behind this check.
BROADCAST_ROWS = 50_000

#: Bytes of text that a Python worker looks at together (a longer text is looked at alone, and whole).
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, most: str = "64m") -> None:
    """Let Arrow batches end at so many bytes, as 10,000 rows of long texts wouldn't fit a worker; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves, but in local mode only: a cluster's machines don't share theirs.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="facetloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes in this block are deleted at its end; results made in it must be written in it."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for folder in _WRITTEN.pop():
            delete(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, as a table written in the shared folder, and go on from there: a lost executor costs no lineage.

    (checkpoint() computes its last stage twice.) The tables stay until the end of the ``scratch`` block around, or until ``clear``.
    """
    folder = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/facetloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what ``cut`` has written in this application; DataFrames made from it can't be read any more."""
    delete(spark, work_dir(spark))


def checked(right: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """right, which should be written or cheap, to be joined to a larger table, and its rows (``most`` + 1 if they are more): it is broadcast only if it has at most ``most``, else both sides are shuffled."""
    n = right.limit(most + 1).count()
    return F.broadcast(right) if n <= most else right.hint("shuffle_hash"), n


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a ``checked`` right side."""
    return left.join(checked(right, most)[0], on, how)


def byte_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the UTF-8 bytes of their texts and the offsets of the texts in them; a null has no bytes."""
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if text.null_count:  # a null's slot may hold bytes in principle
        size = np.where(np.asarray(text.is_valid()), np.diff(off), 0)
        if size.sum() != off[-1] - off[0]:
            raise ValueError("bytes behind a null")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between successive offsets, which may be empty stretches."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes above the space, which no text boundary lets run on."""
    return spans(raw > 32, offsets)


def fold_case(raw: np.ndarray) -> np.ndarray:
    """A copy in which ASCII and two-byte Latin-1 capitals are lower case; lengths stay."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        late = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[late] += 32
    return out


def spans(inner: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, ended also by text boundaries."""
    n = len(inner)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inner.copy(), inner.copy()
    start[1:] &= ~inner[:-1] | edge[1:n]
    end[:-1] &= ~inner[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they lie."""
    with np.errstate(over="ignore"):
        n = len(raw)
        power = np.cumprod(np.full(n + 1, _MULTIPLIER, np.uint64))
        back = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
        return mix((prefix[end] - prefix[start]) * back[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def take(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(x)) for x in names]
