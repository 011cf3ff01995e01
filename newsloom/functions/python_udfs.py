"""The few string functions that no built-in expresses, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

BRACKETS = {"[": "]", "(": ")", "（": "）", "<": ">", "【": "】"}
CLOSERS = set(BRACKETS.values())


def unescaped(text: str, passes: int = 4) -> str:
    for _ in range(passes):
        done = html.unescape(text)
        if done == text:
            break
        text = done
    return text


def without_tag(text: str, words: tuple[str, ...]) -> str:
    """The text without leading bracketed tags, nested ones included, whose content starts with one of the words."""
    while text and text[0] in BRACKETS and text[1:].lstrip().startswith(words):
        open_ones = []
        for i, c in enumerate(text):
            if c in BRACKETS:
                open_ones.append(BRACKETS[c])
            elif c in CLOSERS and c in open_ones:  # closes those that were opened within it too
                while open_ones.pop() != c:
                    pass
            if not open_ones:
                break
        if open_ones:
            return text
        text = text[i + 1 :].lstrip()
    return text


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(unescaped, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def form(text: str) -> str:
    """Letters and digits alone, width-folded and lower-cased."""
    return "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c)[0] in "LN").lower()


@F.pandas_udf(ArrayType(StringType()))
def unique_forms(xs: pd.Series, excluded: pd.Series) -> pd.Series:
    """Of texts with one form, the first; none whose form is empty or that of an excluded one."""

    def one(texts, gone) -> list[str] | None:
        if texts is None:
            return None
        seen = {form(x) for x in (() if gone is None else gone) if x is not None} | {""}
        return [x for x in texts if x is not None and (f := form(x)) not in seen and not seen.add(f)]

    return pd.Series([one(x, e) for x, e in zip(xs, excluded)], dtype="object")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of the first 300 characters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x[:300], y[:300]).ratio() for x, y in zip(a, b)], dtype="float64")


def strip_tag(words: tuple[str, ...]):
    @F.pandas_udf(StringType())
    def strip(x: pd.Series) -> pd.Series:
        return x.map(lambda t: without_tag(t, words), na_action="ignore")

    return strip
