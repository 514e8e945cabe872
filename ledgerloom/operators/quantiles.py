"""Exact quantiles by distributed selection: no task and no driver sees all values.

A pass over the values brackets each wanted rank between two values of a bounded
sketch; the next counts what lies below, on and inside the brackets. A rank on an end
is found; one inside a bracket of few values is read from these; larger brackets are
bracketed again. The rows inside a bracket shrink by more than a thousand with each
round, so tables of any size need two or three.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import name

#: Of the sketch: a value's rank is wrong by at most one part in so many.
ACCURACY = 10_000
#: Values inside a bracket that the driver may read.
FEW = 2_000


def _bracket(x: Column, at: float) -> Column:
    """Two values of x between which lies the one at this share of the ranks."""
    ends = [min(max(at + side * 3 / ACCURACY, 0.0), 1.0) for side in (-1, 1)]
    return F.percentile_approx(x, F.array(*map(F.lit, ends)), ACCURACY)


def quantiles(df: DataFrame, column: str, shares: Sequence[float], few: int = FEW) -> list[float | None]:
    """Values of a double column at these shares of its ranks, between two neighbours in proportion; nulls are skipped.

    Reads df once for each pass: give a table, not a long plan.
    """
    values = df.select(name(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    x = F.col("x")
    first = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), *[_bracket(x, p).alias(f"b{i}") for i, p in enumerate(shares)]).first()
    n = first["n"]
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    #: rank -> bracket; a rank is found when it is in ``found``
    found: dict[int, float] = {0: first["lo"], n - 1: first["hi"]}
    todo = {rank: tuple(first[f"b{i}"]) for i, place in enumerate(places) for rank in (math.floor(place), math.ceil(place)) if rank not in found}
    while todo:
        ranks = list(todo)
        ends = sorted({e for bracket in todo.values() for e in bracket})
        inside = {b: (x > b[0]) & (x < b[1]) for b in todo.values()}
        counts = [F.count(F.when(c, 1)) for e in ends for c in (x < e, x == e)]
        row = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        below = {e: row[2 * i] for i, e in enumerate(ends)}
        upto = {e: row[2 * i] + row[2 * i + 1] for i, e in enumerate(ends)}
        small, large = {}, {}
        for rank in ranks:
            lo, hi = todo.pop(rank)
            # an end that the sketch put on the wrong side of the rank is moved out
            if rank < below[lo]:
                todo[rank] = (first["lo"], lo)
            elif rank < upto[lo]:
                found[rank] = lo
            elif rank >= upto[hi]:
                todo[rank] = (hi, first["hi"])
            elif rank >= below[hi]:
                found[rank] = hi
            else:
                (small if below[hi] - upto[lo] <= few else large)[rank] = (lo, hi)
        if small:
            read = sorted(r["x"] for r in values.where(_any([inside[b] for b in set(small.values())])).collect())
            for rank, (lo, hi) in small.items():
                found[rank] = [v for v in read if lo < v < hi][rank - upto[lo]]
        if large:
            share = {rank: (rank - upto[lo]) / max(below[hi] - upto[lo] - 1, 1) for rank, (lo, hi) in large.items()}
            row = values.agg(*[_bracket(F.when(inside[b], x), share[rank]).alias(f"b{i}") for i, (rank, b) in enumerate(large.items())]).first()
            todo |= {rank: tuple(row[f"b{i}"]) for i, rank in enumerate(large)}
    out = []
    for place in places:
        low, high = math.floor(place), math.ceil(place)
        a, b = found[low], found[high]
        out.append(a if low == high or a == b else (high - place) * a + (place - low) * b)
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
