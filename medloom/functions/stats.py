"""Closed-form statistics as column expressions, and tail probabilities for summary rows.

The Arrow functions run on one row per test or per cell, never on data rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)
TERMS = 4096  # terms of a tail in one step


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(s) or pd.isna(k) or k <= 0 else _upper_gamma(k / 2.0, s / 2.0)
        for s, k in zip(stat, dof)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


def _stirling_rest(n: float) -> float:
    """What Stirling's formula leaves out of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - HALF_LOG_TAU if n else 0.0
    square = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / square) / square) / square) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by its series where both are close."""
    gap = x - mean
    if abs(gap) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = gap / (x + mean)
    total, factor, j = gap * v, 2 * x * v, 1
    while True:
        factor *= v * v
        more = total + factor / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: float, n: float, p: float) -> float:
    """Log chance of ``x`` hits in ``n`` draws, without differences of large log factorials."""
    if x == 0 or x == n:
        return n * (math.log(p) if x else math.log1p(-p)) if n else 0.0
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x)
    return rest - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - HALF_LOG_TAU - 0.5 * math.log(x * (n - x) / n)


def _away_from_mode(first: float, ratios: Callable[[np.ndarray], np.ndarray], steps: int) -> float:
    """Sum of falling terms from ``first`` on, each a ratio of the last, until they stop counting."""
    total, term, done = first, first, 0
    while done < steps and term > total * 1e-18:
        terms = term * np.cumprod(ratios(np.arange(done, min(done + TERMS, steps), dtype="float64")))
        total, term, done = total + float(terms.sum()), float(terms[-1]), done + TERMS
    return total


def _overlap_tail(a: float, r: float, c: float, n: float) -> float:
    low, top = max(0.0, r + c - n), min(r, c)
    if a <= low or a > top:
        return 1.0 if a <= low else 0.0
    if c == n:
        return 1.0
    p = c / n
    at = lambda k: math.exp(_log_binomial(k, r, p) + _log_binomial(c - k, n - r, p) - _log_binomial(c, n, p))
    if a > (r + 1) * (c + 1) / (n + 2):  # past the mode terms fall upwards, before it downwards
        up = lambda i: (r - a - i) * (c - a - i) / ((a + i + 1) * (n - r - c + a + i + 1))
        return min(1.0, _away_from_mode(at(a), up, int(top - a)))
    b = a - 1
    down = lambda i: (b - i) * (n - r - c + b - i) / ((r - b + i + 1) * (c - b + i + 1))
    return max(0.0, 1.0 - _away_from_mode(at(b), down, int(b - low)))


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(a: pd.Series, row: pd.Series, col: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= a) with X the overlap of ``row`` and ``col`` picks out of ``total``."""
    return pd.Series([_overlap_tail(*map(float, v)) for v in zip(a, row, col, total)], dtype="float64")


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def softmax3(vata: Column, pitta: Column, kapha: Column) -> list[Column]:
    top = F.greatest(vata, pitta, kapha)
    e = [F.exp(z - top) for z in (vata, pitta, kapha)]
    total = e[0] + e[1] + e[2]
    return [x / total for x in e]


def dominant_dosha(vata: Column, pitta: Column, kapha: Column, margin: float) -> Column:
    """Largest share, or the two largest in fixed order when closer than ``margin``."""
    smallest = F.least(vata, pitta, kapha)
    largest = F.greatest(vata, pitta, kapha)
    middle = vata + pitta + kapha - largest - smallest
    close = largest - middle < margin
    # The earliest name wins among equal shares, so the dropped one is the latest smallest.
    dropped = (
        F.when(kapha == smallest, F.lit("kapha")).when(pitta == smallest, F.lit("pitta")).otherwise(F.lit("vata"))
    )
    pair = F.concat_ws(
        "-",
        F.when(dropped != "vata", F.lit("vata")),
        F.when(dropped != "pitta", F.lit("pitta")),
        F.when(dropped != "kapha", F.lit("kapha")),
    )
    single = (
        F.when(vata == largest, F.lit("vata")).when(pitta == largest, F.lit("pitta")).otherwise(F.lit("kapha"))
    )
    return F.when(close, pair).otherwise(single)


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], q: str, within: list[str] | None = None) -> DataFrame:
    """False-discovery q-values. One row per test, so a window over all tests is small."""
    part = W.partitionBy(*(within or [F.lit(1)]))
    up = part.orderBy(F.col(p).asc(), *order)
    down = part.orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order])
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(part))
    scaled = F.col(p) * F.col("_m") / F.col("_rank")
    return (
        ranked.withColumn(q, F.least(F.lit(1.0), F.min(scaled).over(down.rowsBetween(W.unboundedPreceding, 0))))
        .drop("_rank", "_m")
    )
