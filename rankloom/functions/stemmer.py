"""The English stemmer of the published Snowball family (its second version): suffixes go in five steps, each only where enough of a word stays before it.

A word's regions R1 and R2 say what is enough: R1 begins after the first consonant that follows a vowel, R2 is the same within
R1. stems() runs over the distinct words of a table, once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the algorithm: words with a stem of their own; words that are stems, at once and after step 1a; beginnings that set R1; suffixes and what takes their place.
OWN_STEM = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES, LI_ENDINGS = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous",
    "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize",
    "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _end(word: str, suffixes) -> str:
    """The longest of the suffixes that a word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in OWN_STEM:
        return OWN_STEM[word]
    w = word.removeprefix("'")
    w = re.sub(r"([aeiouy])y", r"\1Y", "Y" + w[1:] if w[:1] == "y" else w)
    begun = next((b for b in BEGINNINGS if w.startswith(b)), None)
    m = _REGION.match(w)
    r1 = len(begun) if begun else m.end() if m else len(w)
    m = _REGION.match(w, r1)
    r2 = m.end() if m else len(w)

    w = w.removesuffix(_end(w, ("'", "'s", "'s'")))
    # 1a: plurals
    s = _end(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # 1b: past forms
    s = _end(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2 and 3: derived forms
    s = _end(w, STEP_2)
    before = w[-len(s) - 1 : -len(s)] if s else ""
    if s and len(w) - len(s) >= r1 and (s not in ("ogi", "li") or (s == "ogi" and before == "l") or (s == "li" and before and before in LI_ENDINGS)):
        w = w[: -len(s)] + STEP_2[s]
    s = _end(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    # 4: endings of long words
    s = _end(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: DataFrame) -> DataFrame:
    """word, stem of each distinct word of a column word: each is stemmed once, however often it comes."""

    @F.pandas_udf("string")
    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stem)

    return words.select("word").filter("word is not null").distinct().withColumn("stem", stemmed("word"))
