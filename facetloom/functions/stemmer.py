"""The Porter2 (English) stemmer, from its published rules; the word lists of exceptions are the algorithm's."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "[aeiouy]"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_LETTERS, _VOWEL, _VC, _VY, _APOSTROPHE, _SHORT = (re.compile(p) for p in ("[a-z']+", _V, f"{_V}[^aeiouy]", f"({_V})y", r"('s'|'s|')$", r"[^aeiouy][aeiouy][^aeiouywxY]$"))
_VC_ONLY = re.compile("[aeiouy][^aeiouy]")


def _by_length(ends: Iterable[str]) -> list[tuple[int, frozenset[str]]]:
    """Endings by their length, longest first."""
    ends = list(ends)
    return [(n, frozenset(e for e in ends if len(e) == n)) for n in sorted({len(e) for e in ends}, reverse=True)]


_ENDS2, _ENDS3, _ENDS4 = _by_length([*_STEP2, "ogi", "li"]), _by_length([*_STEP3, "ative"]), _by_length([*_STEP4, "ion"])


def _ending(w: str, ends: list[tuple[int, frozenset[str]]]) -> str | None:
    """The longest of the endings that w has."""
    for n, some in ends:
        if (end := w[-n:]) in some:
            return end
    return None


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = _VC.search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w) or _VC_ONLY.fullmatch(w))


def stem(w: str) -> str:
    """The stem of a lower-case word; words with other letters than a to z are left as they are."""
    if len(w) <= 2 or not _LETTERS.fullmatch(w):
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.lstrip("'")
    if "y" in w:
        w = re.sub(r"^y", "Y", w)
        w = _VY.sub(r"\1Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _APOSTROPHE.sub("", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None) if w.endswith(("ingly", "edly", "ing", "ed")) else None
        if end and _VOWEL.search(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    if (end := _ending(w, _ENDS2)) and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    if (end := _ending(w, _ENDS3)) and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + _STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[:-5]
    if (end := _ending(w, _ENDS4)) and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = stem(w)
        return known[w]

    return words.map(lambda row: None if row is None else [one(w) for w in row])


def stems(words: Column) -> Column:
    """Arrow batches of token arrays to arrays of stems; a batch's distinct words are stemmed once."""
    return F.pandas_udf(_stems, "array<string>")(words)
