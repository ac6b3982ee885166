"""Longest common subsequences and what follows from them, many symbols a step.

A row of the usual table is kept as one long integer with a bit for each symbol of the one sequence, so that a symbol of
the other costs an addition over its whole length; 20,000 words against as many take part of a second.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

_SIGNS = re.compile(r"\W+")


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence."""
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # a zero for each symbol of a that ends a longer subsequence
    for y in b:
        if hit := row & places.get(y, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 by insertions and deletions; two empty texts are equal."""
    n = len(a) + len(b)
    return 200.0 * common(a, b) / n if n else 100.0


def key(text: str) -> str:
    """What stays of a text when compatibility forms, case, spaces and signs go."""
    return _SIGNS.sub("", unicodedata.normalize("NFKC", text).casefold())


def one_line(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def evolving_keys(a: str, b: str) -> bool:
    """Whether two keys are states of one text: one starts or ends the other, or they differ little."""
    if not a or not b:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if long.startswith(short):
        return True
    return len(short) > 2 and (long.endswith(short) or ratio(a, b) >= (67 if len(short) <= 4 else 72))


@F.pandas_udf(LongType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of two texts' longest common subsequence; null has none."""
    return pd.Series([common((x or "").split(), (y or "").split()) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(LongType())
def common_signs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(x or "", y or "") for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(StringType())
def text_key(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else key(t))


@F.pandas_udf(BooleanType())
def evolving(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else evolving_keys(x, y) for x, y in zip(a, b)], dtype="object")


def similarity(a: Column, b: Column) -> Column:
    """ratio() of two columns."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * common_signs(a, b) / n)


def scores(pairs, matched: str, of: str, against: str, by: list[str]):
    """Mean precision, recall and F1 of pairs with `matched` common words, by class.

    `of` and `against` count the words of the answer and of the reference. Without words on one side all three are 0, on
    both sides 1.
    """
    n, m, k = F.col(against), F.col(of), F.col(matched)
    share = lambda x: F.when(n + m == 0, 1.0).when(x == 0, 0.0).otherwise(k / x)
    scored = pairs.withColumns({"precision": share(m), "recall": share(n), "f1": F.when(n + m == 0, 1.0).otherwise(2 * k / (n + m))})
    return scored.groupBy(*by).agg(F.count("*").alias("pairs"), *(F.round(F.avg(x), 6).alias(x) for x in ("precision", "recall", "f1")))
