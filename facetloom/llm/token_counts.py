"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is merged from its bytes by the merge rules alone; those that end as one part are proven to
encode alone as one token. In the corpus a pre-token that is one of them counts 1 without being merged, and only the others are
merged, each distinct one once for a batch. One narrow pass over the texts, no shuffle.

Defined cases: a null text has null counts, an empty one counts 0. Rows are counted one by one, so repeated rows and null ids don't
matter. Texts are read whole. Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

SCHEMA = "doc_id long, n_words long, n_whole long, n_tokens long"
#: Merged pre-tokens that a worker remembers from batch to batch (for speed only).
REMEMBER = 200_000


@lru_cache(maxsize=4)
def proven(path: str = vocabulary.PATH) -> frozenset[bytes]:
    """The vocabulary's strings that the merge rules alone turn into one token."""
    ranks = vocabulary.load(path)
    return frozenset(p for p in ranks if len(vocabulary.merge(p, ranks)) == 1)


def _counter(ranks, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder(ranks.value)
        single, known = whole.value, {}
        for batch in batches:
            words = batch.column(1)
            lists, flat = words.offsets.to_numpy().astype(np.int64), words.values
            flat = flat.slice(lists[0], lists[-1] - lists[0]) if len(lists) else flat
            lists = lists - lists[0]
            codes = flat.dictionary_encode()
            lens = np.empty(len(codes.dictionary), np.int64)
            for i, w in enumerate(codes.dictionary.cast(pa.binary()).to_pylist()):
                if w in single:
                    lens[i] = 0
                else:
                    n = known.get(w)
                    if n is None:
                        n = len(encode(w))
                        if len(known) >= REMEMBER:
                            known.clear()
                        if len(w) < 64:
                            known[w] = n
                    lens[i] = n
            each = lens[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, np.int64)
            total = lambda x: np.concatenate(([0], np.cumsum(x)))[lists]
            n_whole, rest = np.diff(total(each == 0)), np.diff(total(each))
            null = ~np.asarray(words.is_valid())
            columns = [pa.array(x.astype(np.int64), mask=null) for x in (np.diff(lists), n_whole, n_whole + rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_whole", "n_tokens"])

    return run


def count(docs: DataFrame, path: str = vocabulary.PATH) -> DataFrame:
    """doc_id and the numbers of pre-tokens, of those that are proven whole tokens, and of tokens."""
    sc = docs.sparkSession.sparkContext
    run = _counter(sc.broadcast(vocabulary.load(path)), sc.broadcast(proven(path)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), vocabulary.split_words(F.col("text")).alias("words")).mapInArrow(run, SCHEMA)
