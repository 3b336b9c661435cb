"""The Porter stemmer (Porter 1980), as rule tables over one word; Spark applies it to distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C, _V = r"(?:[^aeiouy]|(?<![^aeiou])y|^y)", r"(?:[aeiou]|(?<=[^aeiou])y)"
_VOWEL = re.compile(_V)
_MEASURE = re.compile(rf"{_V}+{_C}+")
_DOUBLE = re.compile(r"([^aeiouy])\1$")
_CVC = re.compile(rf"{_C}{_V}(?![wxy]){_C}$")
# Suffixes and what they become where the stem before them has a measure above 0 (steps 2 and 3) or 1 (step 4).
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_STEP2, _STEP3, _STEP4 = (tuple(sorted(rules, key=lambda r: -len(r[0]))) for rules in (_STEP2, _STEP3, tuple((s, "") for s in _STEP4)))


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _replace(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The longest suffix that fits decides (rules are sorted by that), whether or not its stem is long enough."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least and (suffix != "ion" or stem.endswith(("s", "t"))) else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words beyond a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _VOWEL.search(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _DOUBLE.search(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _CVC.search(word):
                    word += "e"
                break
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 0)
    word = _replace(word, _STEP3, 0)
    word = _replace(word, _STEP4, 1)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _CVC.search(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def head(stem_: str) -> str:
    """How each word of a stem begins: only a last e or i, or the end of -bl(e) from -bility, may be other letters in the word."""
    if stem_.endswith("ble"):
        return stem_[:-2]
    may_differ = stem_.endswith(("e", "bl")) or (stem_.endswith("i") and re.search("[aeiouy]", stem_[:-1]))
    return (stem_[:-1] if may_differ else stem_) or stem_


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")
