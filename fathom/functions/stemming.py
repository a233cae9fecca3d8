"""Porter's stemmer (M. F. Porter, 1980: An algorithm for suffix stripping), Arrow-batched, each word once a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's endings and what they become, by step; the longest that fits decides.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for n, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and n > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel part is followed by a consonant part."""
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _ending(word, ("ed", "ing"))
    if end is None or "v" not in _shape(word[: -len(end)]):
        return word
    stem = word[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem


def _mapped(word: str, endings: dict[str, str]) -> str:
    end = _ending(word, endings)
    if end is None or _measure(word[: -len(end)]) == 0:
        return word
    return word[: -len(end)] + endings[end]


def _stripped(word: str) -> str:
    end = _ending(word, _STEP4)
    if end is None:
        return word
    stem = word[: -len(end)]
    if _measure(stem) < 2 or end == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem


def _final(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _closed(stem):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Words of one or two letters, and words with anything but a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _final(_stripped(_mapped(_mapped(word, _STEP2), _STEP3)))


def porter(terms: Column) -> Column:
    """The stems of an array of lower-case terms."""

    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        return rows.map(lambda words: [stem(w) for w in words])

    return stems(terms)
