"""The Snowball stemmers for German and Spanish, from their published rules; words are lower case."""

from __future__ import annotations

import re

LANGUAGES = ("german", "spanish")
_GERMAN = "aeiouyäöü"
_SPANISH = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _region(w: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return m.end() if m else len(w)


def _ending(w: str, endings: tuple[str, ...]) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _german(w: str) -> str:
    w = w.replace("ß", "ss")
    w = re.sub(f"(?<=[{_GERMAN}])([uy])(?=[{_GERMAN}])", lambda m: m[1].upper(), w)
    r1 = _region(w, _GERMAN)
    r2 = _region(w, _GERMAN, r1)
    r1 = max(r1, 3)
    end = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1:
        if end in ("em", "ern", "er"):
            w = w[: -len(end)]
        elif end == "s":
            w = w[:-1] if w[-2:-1] in set("bdfghklmnrt") else w
        else:
            w = w[: -len(end)]
            w = w[:-1] if w.endswith("niss") else w
    end = _ending(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or (w[-3:-2] in set("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(end)]
    end = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(w) - len(end) >= r2:
        rest = w[: -len(end)]
        if end in ("end", "ung"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and not rest.endswith("eig") else rest
        elif end in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif end in ("lich", "heit"):
            w = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= r1 else rest
        else:
            more = _ending(rest, ("lich", "ig"))
            w = rest[: -len(more)] if more and len(rest) - len(more) >= r2 else rest
    return w.translate(str.maketrans("äöüUY", "aouuy"))


_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_NOUNS = {
    "": ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"),
    "ic": ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"),
    "log": ("logía", "logías"), "u": ("ución", "uciones"), "ente": ("encia", "encias"), "amente": ("amente",), "mente": ("mente",), "idad": ("idad", "idades"), "iva": ("iva", "ivo", "ivas", "ivos"),
}
_Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_VERBS = tuple(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
)
_GU_VERBS = ("en", "es", "éis", "emos")


def _spanish(w: str) -> str:
    v = _SPANISH
    if len(w) > 1 and w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
    elif len(w) > 1 and w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
    else:
        m = re.compile(".").search(w, 2)
    rv = m.end() if m else len(w)
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    inside = lambda end, region: len(w) - len(end) >= region

    end = _ending(w, _PRONOUNS)
    if end:
        rest = w[: -len(end)]
        verb = _ending(rest, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb and len(rest) - len(verb) >= rv and (verb != "yendo" or rest[:-5].endswith("u")):
            w = rest[: -len(verb)] + verb.translate(_PLAIN)

    before = w
    kind, end = max(((k, e) for k, all_ in _NOUNS.items() for e in all_ if w.endswith(e)), key=lambda x: len(x[1]), default=("", None))
    if end and inside(end, r1 if kind == "amente" else r2):
        w = w[: -len(end)]
        drop = lambda *ends: next((w[: -len(e)] for e in ends if w.endswith(e) and len(w) - len(e) >= r2), w)
        if kind == "ic":
            w = drop("ic")
        elif kind in ("log", "u", "ente"):
            w += kind
        elif kind == "amente":
            short = drop("iv", "os", "ic", "ad")
            w, was = short, w
            if was.endswith("iv") and short != was:
                w = drop("at")
        elif kind == "mente":
            w = drop("ante", "able", "ible")
        elif kind == "idad":
            w = drop("abil", "ic", "iv")
        elif kind == "iva":
            w = drop("at")
    if w == before:
        end = _ending(w[rv:], _Y_VERBS)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _ending(w[rv:], _VERBS + _GU_VERBS)
            if end:
                w = w[: -len(end)]
                if end in _GU_VERBS and w.endswith("gu"):
                    w = w[:-1]
    end = _ending(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


def stem(language: str, w: str) -> str:
    """The stem of a word in one of LANGUAGES."""
    return {"german": _german, "spanish": _spanish}[language](w)
