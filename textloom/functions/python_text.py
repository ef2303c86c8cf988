"""Text functions that Spark has no expression for, as Arrow-batched pandas UDFs over whole columns."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


class _Main(HTMLParser):
    """Text outside scripts, styles, navigation and links; table cells are kept, parted by a bar."""

    SKIP = {"script", "style", "nav", "footer", "header", "noscript", "a", "form", "svg"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def main_text(html: str | None) -> str:
    p = _Main()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip(" |") for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_ROMANS = "i ii iii iv v vi vii viii ix x".split()
_NUMBER = rf"(?:\d{{1,2}}(?:st|nd|rd|th)?|{'|'.join(sorted(_ROMANS + _ORDINALS, key=len, reverse=True))})\b"
_LIST = rf"{_NUMBER}(?:\s*(?:,|/|&|\band\b|\bor\b|\bto\b|-|–)+\s*{_NUMBER})*"
#: "Year / Semester: III / VI" names the year before the slash; otherwise numbers stand behind the word, or before it.
_PAIRED = re.compile(rf"\byear\s*/\s*sem(?:ester)?s?\s*[:\-]?\s*{_NUMBER}\s*/\s*({_LIST})", re.I)
_BEHIND = re.compile(rf"\bsem(?:ester)?s?\b\.?\s*[:\-]?\s*({_LIST})", re.I)
_BEFORE = re.compile(rf"\b({_LIST})\s+sem(?:ester)?s?\b", re.I)
_PART = re.compile(rf"({_NUMBER})(?:\s*(?:\bto\b|-|–)\s*({_NUMBER}))?", re.I)


def _number(said: str) -> int:
    said = said.lower()
    for names in (_ROMANS, _ORDINALS):
        if said in names:
            return names.index(said) + 1
    return int(re.match(r"\d+", said)[0])


def semesters(text: str | None) -> list[int]:
    """Numbers of semesters from 1 to 12 in lists, ranges and alternatives, as digits, roman numerals or ordinals, ascending."""
    found: set[int] = set()
    rest = text or ""
    for pattern in (_PAIRED, _BEHIND, _BEFORE):
        for m in pattern.finditer(rest):
            for low, high in _PART.findall(m[1]):
                found.update(range(_number(low), _number(high or low) + 1))
        # what one form has named is not read again by the next
        rest = pattern.sub(" ; ", rest)
    return sorted(x for x in found if 1 <= x <= 12)


@F.pandas_udf(ArrayType(IntegerType()))
def semester_list(texts: pd.Series) -> pd.Series:
    return texts.map(semesters)


# The endings of Porter's published algorithm with what takes their place, by step
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _sounds(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _sounds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x and y."""
    return _sounds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _ending(word: str, ends) -> str | None:
    """The longest of the endings that the word has: one rule of a step is tried."""
    return max((e for e in ends if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """The stem of an English word in lower case by Porter's five steps; words of one or two letters stay."""
    if len(word) < 3:
        return word
    # 1a: plurals
    if end := _ending(word, ("sses", "ies", "ss", "s")):
        word = word[: len(word) - len(end)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[end]
    # 1b: -eed, -ed, -ing
    end = _ending(word, ("eed", "ed", "ing"))
    stem = word[: -len(end)] if end else ""
    if end == "eed":
        word = stem + "ee" if measure(stem) else word
    elif end and "v" in _sounds(stem):
        if stem.endswith(("at", "bl", "iz")):
            word = stem + "e"
        elif len(stem) > 1 and stem[-1] == stem[-2] and _sounds(stem)[-1] == "c" and stem[-1] not in "lsz":
            word = stem[:-1]
        else:
            word = stem + "e" if measure(stem) == 1 and _short(stem) else stem
    # 1c: -y
    if word.endswith("y") and "v" in _sounds(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        if (end := _ending(word, table)) and measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    if (end := _ending(word, _STEP_4)) and measure(stem := word[: -len(end)]) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    # 5: a last e, a double l
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [porter(t) for t in ts])


def rouge_l(a: list[str], b: list[str]) -> float:
    """F-measure of the longest common subsequence."""
    if not a or not b:
        return 0.0
    # bit j of ``v`` is clear where the longest common subsequence with b[: j + 1] is one longer than with b[:j]: all of b in a few operations a token
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    n = len(b) - v.bit_count()
    p, r = n / len(a), n / len(b)
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge_n(a: list[str], b: list[str], n: int) -> float:
    """F-measure of the runs of n tokens that both have, each as often as both have it."""
    x, y = (Counter(zip(*[t[i:] for i in range(n)])) for t in (a, b))
    shared, total = sum((x & y).values()), x.total() + y.total()
    return 2 * shared / total if total else 0.0


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l")]))
def rouge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """ROUGE-1, 2 and L of lists of tokens; those of over three letters count by their stems."""
    stemmed = lambda ts: [porter(t) if len(t) > 3 else t for t in (ts if ts is not None else [])]
    rows = [(stemmed(x), stemmed(y)) for x, y in zip(a, b)]
    return pd.DataFrame({"rouge_1": [rouge_n(x, y, 1) for x, y in rows], "rouge_2": [rouge_n(x, y, 2) for x, y in rows], "rouge_l": [rouge_l(x, y) for x, y in rows]}, dtype="float64")
