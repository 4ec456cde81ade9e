"""Scorers: Columns where Spark has the function, an Arrow UDF over distinct pairs where it does not.

Each has a plain Python twin in ``PLAIN`` for the stream processor, which scores one record at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date as Date
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """The Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    hits_a = []
    used = [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits_a.append(c)
                break
    if not hits_a:
        return 0.0
    hits_b = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b, strict=True)) // 2
    m = len(hits_a)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for a common prefix of up to four characters, at any similarity."""
    j = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known[p] if p in known else known.setdefault(p, jaro_winkler(*p)) for p in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def exact(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")), 1.0).otherwise(0.0)


def levenshtein(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def numeric(a: Column, b: Column, absolute: str = "0.01", percent: str = "0") -> Column:
    """1 within the tolerance, 0 from twice the tolerance on, linear between.

    The tolerance is the larger of ``absolute`` and the share ``percent`` of the first amount; with 0 only equal amounts score.
    """
    gap, flat = F.abs(a - b), F.lit(absolute).cast("decimal(20,4)")
    if Decimal(percent):
        tol = F.greatest(flat.cast("decimal(38,10)"), (F.abs(a) * F.lit(percent).cast("decimal(12,8)")).cast("decimal(38,10)"))
    elif not Decimal(absolute):
        return F.when(gap == 0, 1.0).otherwise(0.0)
    else:
        tol = flat
    wide = tol.cast("double")
    return F.when(gap <= tol, 1.0).when(gap.cast("double") >= 2 * wide, 0.0).otherwise(1.0 - (gap.cast("double") - wide) / wide)


def date(a: Column, b: Column, days: int = 7) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.datediff(a, b)) / float(days)) if days > 0 else F.when(a == b, 1.0).otherwise(0.0)


SCORERS: dict[str, Callable[[Column, Column], Column]] = {"exact": exact, "jaro_winkler": jaro_winkler_column, "levenshtein_normalized": levenshtein, "numeric_closeness": numeric, "date_proximity": date}


def register(name: str, scorer: Callable[[Column, Column], Column], plain: Callable | None = None) -> None:
    """Add a scorer, or put one in the place of another; ``plain`` is its form for streams."""
    SCORERS[name] = scorer
    if plain is not None:
        PLAIN[name] = plain


def scored_pairs(pairs: DataFrame, a: str, b: str, scorer: str) -> DataFrame:
    """``pairs`` with ``score``."""
    return pairs.withColumn("score", SCORERS[scorer](F.col(a), F.col(b)))


def _plain_levenshtein(a: str, b: str) -> float:
    a, b = a or "", b or ""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def _plain_numeric(a: Decimal, b: Decimal) -> float:
    gap, tol = abs(a - b), Decimal("0.01")
    return 1.0 if gap <= tol else 0.0 if gap >= 2 * tol else float(1 - (gap - tol) / tol)


def _plain_date(a: Date, b: Date) -> float:
    return max(0.0, 1.0 - abs((a - b).days) / 7.0)


PLAIN: dict[str, Callable] = {"exact": lambda a, b: float((a or "") == (b or "")), "jaro_winkler": lambda a, b: jaro_winkler(a or "", b or ""), "levenshtein_normalized": _plain_levenshtein, "numeric_closeness": _plain_numeric, "date_proximity": _plain_date}
