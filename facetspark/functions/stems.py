"""English stems by suffix stripping (Porter 1980, with the usual later extensions), in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
# Suffixes of the second and third step and what stands for them.
DERIVED = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "fulli": "ful",
    "logi": "log",
}
SHORTENED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Suffixes that the fourth step takes off.
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: How many words a worker remembers.
CACHED_WORDS = 200_000


def _forms(word: str) -> str:
    """The word as c (consonants) and v (vowels); y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _forms(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends with consonant, vowel and a consonant other than w, x and y, or is a vowel and a consonant."""
    forms = _forms(stem)
    return (forms.endswith("cvc") and stem[-1] not in "wxy") or forms == "vc"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _forms(word[: -len(s)])), None)
    if end is None:
        return word
    stem = word[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _forms(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _derived(word: str) -> str:
    end = _longest(word, DERIVED)
    if end is None:
        return word
    stem = word[: -len(end)]
    if _measure(word[:-3] if end == "logi" else stem) == 0:
        return word
    short = stem + DERIVED[end]
    return _derived(short) if end == "alli" else short


def _shortened(word: str) -> str:
    end = _longest(word, SHORTENED)
    return word if end is None or _measure(word[: -len(end)]) == 0 else word[: -len(end)] + SHORTENED[end]


def _dropped(word: str) -> str:
    end = _longest(word, DROPPED)
    if end is None:
        return word
    stem = word[: -len(end)]
    return stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else word


def _tidied(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(CACHED_WORDS)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two characters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _forms(word)[-2] == "c":
        word = word[:-1] + "i"
    return _tidied(_dropped(_shortened(_derived(word))))


@F.pandas_udf(ArrayType(StringType()))
def stems(texts: pd.Series) -> pd.Series:
    """The stems of a text's words without ASCII punctuation, and without a, an, the and and; a null text has none."""
    return texts.map(lambda t: [] if t is None else [stem(w) for w in re.sub(r"\b(a|an|the|and)\b", " ", re.sub(r"[!-/:-@\[-`{-~]", "", t.lower())).split()])
