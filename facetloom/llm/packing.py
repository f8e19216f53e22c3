"""Sum-of-squares online packing of documents into training windows.

Documents arrive one by one. A window that is filled to level h of ``capacity`` is partially filled; N(h) counts them. A document
of size s goes where the sum of N(h) squared becomes least: onto a window at some level h with room, or into a new one. Only the
array of N is looked at, so a placement costs one pass over the levels. A document larger than a window fills whole windows of its
own first, and what is left over is placed like any other.

Online packing is one sequence by nature. The stream is dealt into shards, runs of ``RUN`` successive doc_ids, and every shard packs its own windows;
a shard leaves at most a few partially filled ones. Which shard a document is in, and where it lies there, depends on the documents
of its run alone, not on the size of the table. A run with more than twice ``RUN`` rows, which ids that repeat (or rows without one, a run of their own)
can make, is dealt by hash into as many parts as it has times ``RUN`` rows; the windows of part p are numbered from p * 2^40.

Defined cases: sizes are whitespace-separated words and one for the separator unless another column is given. Null and blank texts
take no room and have no row. Rows with null doc_id are packed like others, in shard null. Repeated rows each take room. Within a shard documents
arrive by doc_id, then size; equal sums prefer the fullest window, then a new one, and of windows at one level the newest.
Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_checked

CAPACITY = 2048
#: Successive doc_ids of a shard.
RUN = 1 << 15

SCHEMA = "doc_id long, part long, shard long, window long, start int, size int"


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, part, window, start, size) of each piece, for documents in order of arrival."""
    level = np.zeros(capacity + 1, np.int64)  # N; neither the empty nor the full count
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    windows = 0
    out = []
    for i, size in enumerate(sizes.tolist()):
        part = 0
        while size >= capacity:
            out.append((i, part, windows, 0, capacity))
            windows, part, size = windows + 1, part + 1, size - capacity
        if not size:
            continue
        top = capacity - size
        fits = np.flatnonzero(level[1 : top + 1]) + 1
        # (N-1)^2 - N^2 for the level left, (N+1)^2 - N^2 for the one reached unless it is full
        best, h = 2 * int(level[size]) + 1, 0
        if len(fits):
            reached = fits + size
            change = 1 - 2 * level[fits] + np.where(reached < capacity, 2 * level[reached] + 1, 0)
            k = len(fits) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                h = int(fits[k])
        if h:
            window = at[h].pop()
            level[h] -= 1
        else:
            window, windows = windows, windows + 1
        if h + size < capacity:
            at[h + size].append(window)
            level[h + size] += 1
        out.append((i, part, window, h, size))
    return out


def _words(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(n > 0, n + 1).otherwise(0)


def _shard(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "size"], na_position="first", kind="stable")
        pieces = np.array(place(frame["size"].to_numpy(), capacity), np.int64).reshape(-1, 5)
        column = lambda name: frame[name].astype("Int64").array[pieces[:, 0]]
        window = pieces[:, 2] + (int(frame["deal"].iloc[0]) << 40)
        return pd.DataFrame({"doc_id": column("doc_id"), "part": pieces[:, 1], "shard": column("shard"), "window": window, "start": pieces[:, 3].astype(np.int32), "size": pieces[:, 4].astype(np.int32)})

    return run


def pack(docs: DataFrame, size: Column | None = None, capacity: int = CAPACITY, run: int = RUN) -> DataFrame:
    """Where each piece of each document lies: doc_id, part, shard, window (numbered within the shard), start, size."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_words(F.col("text")) if size is None else size).cast("long").alias("size")).where("size > 0")
    sizes = cut(sizes.select("doc_id", "size", F.floor(F.col("doc_id") / run).alias("shard"), F.monotonically_increasing_id().alias("row")))
    large = sizes.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * run).select(F.coalesce("shard", F.lit(-1)).alias("key"), F.col("shard").isNull().alias("none"), F.ceil(F.col("n") / run).alias("deals"))
    keyed = sizes.withColumn("key", F.coalesce("shard", F.lit(-1))).withColumn("none", F.col("shard").isNull())
    dealt = join_checked(keyed, cut(large), ["key", "none"]).withColumn("deal", F.coalesce(F.pmod(F.xxhash64("row"), F.col("deals")), F.lit(0)))
    return dealt.select("doc_id", "size", "shard", "deal").groupBy("shard", "deal").applyInPandas(_shard(capacity), SCHEMA)
