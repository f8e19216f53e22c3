"""Public byte-level BPE vocabularies: reading rank files, the pre-token pattern in Java's dialect, merging one pre-token.

The file's path is a parameter; the driver reads it once and sends the ranks to the workers, so executors need no copy of the file.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens: contractions, words, numbers and other signs with one leading space, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def load(path: str = PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def split_words(text: Column) -> Column:
    """The pre-tokens of a text; put together they are the text. ((?U): white space is Unicode's, as the rank files' users have it.)"""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), 0)


def encoder(ranks: dict[bytes, int]):
    """A function from a pre-token's bytes to its ids; kept by the worker process for later batches."""
    import tiktoken

    global _ENCODER
    key = (len(ranks), hash(frozenset(list(ranks.items())[:: max(1, len(ranks) // 64)])))
    if _ENCODER is None or _ENCODER[0] != key:
        _ENCODER = key, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return _ENCODER[1]


_ENCODER = None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts left of piece when neighbours are merged, least rank first, till none can be: with no look at whether piece itself is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if rank > len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts
