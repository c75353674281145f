"""The Porter2 stemmer for English as tables of steps: each step looks for its longest suffix and then decides."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm: words with stems of their own, and those that end after the plural step.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
DONE_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes with what takes their place, in the part behind the first vowel and consonant.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDING = "cdeghkmnrt"
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = re.compile(rf"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$")
DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


BEHIND = re.compile(f"{VOWEL}{OTHER}")
ANY_VOWEL = re.compile(VOWEL)
PLAIN = re.compile(r"[a-z']+")
HARD_Y = re.compile(r"^y|(?<=[aeiouy])y")
FIXED = re.compile("gener|commun|arsen")
OWNER = re.compile(r"('s'|'s|')$")


def by_length(suffixes: dict[str, str] | tuple[str, ...]) -> list[tuple[int, set[str]]]:
    """The suffixes of each length, long ones first."""
    return [(n, {s for s in suffixes if len(s) == n}) for n in sorted({len(s) for s in suffixes}, reverse=True)]


PAST, ENDS_2, ENDS_3, ENDS_4 = map(by_length, (("eed", "eedly", "ed", "edly", "ing", "ingly"), STEP_2, STEP_3, STEP_4))


def region(word: str, start: int) -> int:
    """Where the part behind the next vowel and consonant begins."""
    m = BEHIND.search(word, start)
    return m.end() if m else len(word)


def longest(word: str, suffixes: list[tuple[int, set[str]]]) -> str:
    return next((word[-n:] for n, some in suffixes if word[-n:] in some), "")


def plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and ANY_VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def past(w: str, r1: int) -> str:
    s = longest(w, PAST)
    if s.startswith("ee"):
        return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    if not s or not ANY_VOWEL.search(w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if DOUBLE.search(w):
        return w[:-1]
    return w + "e" if SHORT.search(w) and r1 >= len(w) else w


@lru_cache(1 << 16)
def porter2(word: str) -> str:
    """The stem of a word in lower case; two letters or fewer stay, and so do words that aren't of ASCII letters."""
    if len(word) <= 2 or word in EXCEPTIONS or not PLAIN.fullmatch(word):
        return EXCEPTIONS.get(word, word)
    w = HARD_Y.sub("Y", word.removeprefix("'"))
    fixed = FIXED.match(w)
    r1 = fixed.end() if fixed else region(w, 0)
    r2 = region(w, r1)
    w = plural(OWNER.sub("", w))
    if w in DONE_AFTER_PLURAL:
        return w
    w = past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = longest(w, ENDS_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in LI_ENDING):
        w = w[: -len(s)] + STEP_2[s]
    s = longest(w, ENDS_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    s = longest(w, ENDS_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of lists of lower-case words; a word is worked out once a worker."""
    return words.map(lambda ws: None if ws is None else [porter2(w) for w in ws])
