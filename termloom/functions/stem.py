"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), for distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed values of the paper's steps 2, 3 and 4: suffix and what takes its place.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """By the rule with the longest suffix, if the rest measures more than ``least``."""
    fits = [r for r in rules if word.endswith(r[0])]
    if fits:
        suffix, new = max(fits, key=lambda r: len(r[0]))
        stem = word[: -len(suffix)]
        if _measure(stem) > least:
            return stem + new
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if _has_vowel(rest := word[: -len(suffix)]):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif _double(rest) and rest[-1] not in "lsz":
                        rest = rest[:-1]
                    elif _measure(rest) == 1 and _cvc(rest):
                        rest += "e"
                    word = rest
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP2, 0)
    word = _replaced(word, STEP3, 0)
    fits = [s for s in STEP4 if word.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _cvc(rest):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_column(column: Column) -> Column:
    """Made when it is used: a worker that imports this module has no session."""
    return F.pandas_udf(stem_words, "string")(column)
