"""Stems of English (Porter 2) and Russian words, after the published descriptions of the two algorithms.

Stems are computed once for each distinct word: ``stem_column`` stems a word column through an Arrow function with a
bounded memo per worker, so a text of repeated words costs a lookup per word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Words of the English algorithm with a given stem, and words that stay after step 1a.
_ENGLISH_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_ENGLISH_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffixes of steps 2 to 4 and what replaces them.
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel behind a vowel begins, looking from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """Porter 2 stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in _ENGLISH_WHOLE:
        return _ENGLISH_WHOLE[word]
    w = word.lstrip("'")
    # a y at the start or behind a vowel is a consonant
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy" and not (i > 1 and w[i - 1] == "y" and w[i - 2] in "aeiou")) else c for i, c in enumerate(w))
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plural forms
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _ENGLISH_KEPT:
        return w.lower()
    # past and progressive forms
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    s = _longest(w, _STEP2)
    if s and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if s == "li":
            w = stem if stem and stem[-1] in "cdeghkmnrt" else w
        elif s == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        else:
            w = stem + _STEP2[s]
    s = _longest(w, _STEP3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _STEP3[s]
    s = _longest(w, _STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_RU_VOWELS = "аеиоуыэюя"

# Endings of the Russian algorithm by class; those marked must follow а or я.
_GERUND_A, _GERUND = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_A, _PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_VERB_A = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_VERB = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)


def _cut(w: str, rv: int, plain: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """The word without the longest ending within RV, or None. Endings in ``after_a`` need а or я before them in RV."""
    best = 0
    for s in plain:
        if len(s) > best and w.endswith(s) and len(w) - len(s) >= rv:
            best = len(s)
    for s in after_a:
        if len(s) > best and len(w) - len(s) - 1 >= rv and w.endswith(("а" + s, "я" + s)):
            best = len(s)
    return w[:-best] if best else None


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    """Russian stem of a word in lower case; ё counts as е."""
    w = word.replace("ё", "е")
    first = next((i for i, c in enumerate(w) if c in _RU_VOWELS), None)
    if first is None:
        return w
    rv = first + 1

    def region(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _RU_VOWELS and w[i - 1] in _RU_VOWELS:
                return i + 1
        return len(w)

    r2 = region(region(0))
    got = _cut(w, rv, _GERUND, _GERUND_A)
    if got is None:
        w = _cut(w, rv, ("ся", "сь")) or w
        got = _cut(w, rv, _ADJECTIVE)
        if got is not None:
            got = _cut(got, rv, _PARTICIPLE, _PARTICIPLE_A) or got
        else:
            got = _cut(w, rv, _VERB, _VERB_A) or _cut(w, rv, _NOUN)
    w = got if got is not None else w
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for s in ("ость", "ост"):
        if w.endswith(s) and len(w) - len(s) >= r2:
            w = w[: -len(s)]
            break
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    else:
        for s in ("ейше", "ейш"):
            if w.endswith(s) and len(w) - len(s) >= rv:
                w = w[: -len(s)]
                if w.endswith("нн"):
                    w = w[:-1]
                return w
        if w.endswith("ь") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def stem_word(word: str) -> str:
    """Russian if most letters are Cyrillic, English if all are ASCII, else only lower case."""
    low = word.lower()
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in low)
    if cyrillic > sum("a" <= c <= "z" for c in low):
        return russian(low)
    return english(low) if low.isascii() else low


_TOKENS = re.compile(r"\w+|\W+")
_QUERY = re.compile(r"\w{2,}")
_PARTS = re.compile(r"[^\W_]+")


def stem_text(text: str | None) -> str | None:
    """The text in lower case with every word stemmed; what lies between words stays. Words that begin with ``_`` stay."""
    if text is None:
        return None
    return "".join(stem_word(t) if t[0].isalnum() else t.lower() for t in _TOKENS.findall(text))


def stem_query(text: str | None) -> list[str]:
    """Stems of the words of at least two characters, repeated ones kept."""
    return [stem_word(w) for w in _QUERY.findall(text or "")]


def _stem_part(part: str) -> str:
    low = part.lower()
    if any("Ѐ" <= c <= "ӿ" for c in low):
        return russian(low)
    return english(low) if low.isascii() else low


def stem_identifiers(text: str | None) -> str | None:
    """As ``stem_text``, but words are cut at ``_`` and parts of one character are dropped."""
    if text is None:
        return None
    out = []
    for t in _TOKENS.findall(text):
        out.append(" ".join(_stem_part(p) for p in _PARTS.findall(t) if len(p) > 1) if t[0].isalnum() or t[0] == "_" else t)
    return "".join(out)


def stem_identifier_query(text: str | None) -> list[str]:
    """Stems of the parts of query words; words that are neither ASCII nor Cyrillic are left out."""
    out = []
    for w in _QUERY.findall(text or ""):
        if w.isascii() or any("Ѐ" <= c <= "ӿ" for c in w):
            out += [_stem_part(p) for p in _PARTS.findall(w) if len(p) > 1]
    return out


def stem_column(c: Column, identifiers: bool = False) -> Column:
    """Stemmed text of a column; null stays null."""
    one = stem_identifiers if identifiers else stem_text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(c)


def stem_query_column(c: Column, identifiers: bool = False) -> Column:
    """Query terms of a column; none for null."""
    one = stem_identifier_query if identifiers else stem_query

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if isinstance(t, str) else [])

    return run(c)
