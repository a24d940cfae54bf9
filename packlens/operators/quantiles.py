"""Exact interpolated quantiles of a column in passes that each hold a bounded sketch and bounded counts.

``percentile`` brings every distinct value to one task. Here a sketch only proposes values; their exact counts decide
which of them has a wanted place, or between which two values it lies, and the next pass reads that span alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks within n / ACCURACY of the sketch's guess; spans of at most SMALL rows are collected.
ACCURACY, SMALL = 1000, 5000


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """As ``percentile`` of the column at each share; null without rows. Nulls don't count, NaN is the largest value."""
    rows = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n, numbers = rows.agg(F.count("x"), F.count(F.when(~F.isnan("x"), 1))).first()
    if n == 0:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    ranks = {r for at in places for r in (math.floor(at), math.ceil(at))}
    value = {r: math.nan for r in ranks if r >= numbers} | at_ranks(rows.where("NOT isnan(x)"), numbers, {r for r in ranks if r < numbers})
    out = []
    for at in places:
        low, high = math.floor(at), math.ceil(at)
        a, b = value[low], value[high]
        out.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
    return out


def at_ranks(rows: DataFrame, n: int, ranks: set[int]) -> dict[int, float]:
    """rank (from 0) -> the value x at it, by the order of x. A span is open: (low, high, rows up to low, rows in it)."""
    found: dict[int, float] = {}
    spans = {r: (None, None, 0, n) for r in ranks}
    while spans:
        small = sorted({s for s in spans.values() if s[3] <= SMALL}, key=repr)
        if small:
            got = rows.where(_any(small)).agg(*[F.array_sort(F.collect_list(F.when(_inside(s), F.col("x")))) for s in small]).first()
            held = dict(zip(small, got))
            found |= {r: held[s][r - s[2]] for r, s in spans.items() if s in held}
            spans = {r: s for r, s in spans.items() if s not in held}
            continue
        wide = sorted(set(spans.values()), key=repr)
        shares = {s: sorted({min(1.0, max(0.0, (r - s[2]) / s[3] + e / ACCURACY)) for r, t in spans.items() if t == s for e in (-2, 2)}) for s in wide}
        got = rows.where(_any(wide)).agg(*[F.percentile_approx(F.when(_inside(s), F.col("x")), shares[s], ACCURACY) for s in wide]).first()
        guesses = sorted({x for xs in got for x in xs})
        counts = rows.agg(*[c for x in guesses for c in (F.count(F.when(F.col("x") < x, 1)), F.count(F.when(F.col("x") <= x, 1)))]).first()
        less = dict(zip(guesses, zip(counts[::2], counts[1::2])))
        for r, (low, high, before, size) in list(spans.items()):
            after = before + size
            for x, (under, upto) in less.items():
                if under <= r < upto:
                    found[r] = x
                elif upto <= r and (low is None or x > low):
                    low, before = x, upto
                elif r < under and (high is None or x < high):
                    high, after = x, under
            spans[r] = (low, high, before, after - before)
        spans = {r: s for r, s in spans.items() if r not in found}
    return found


def _inside(span: tuple):
    low, high = span[:2]
    return F.lit(True) & (F.lit(True) if low is None else F.col("x") > low) & (F.lit(True) if high is None else F.col("x") < high)


def _any(spans: list[tuple]):
    out = F.lit(False)
    for s in spans:
        out = out | _inside(s)
    return out
