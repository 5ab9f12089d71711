"""Exact quantiles of a column by counting ranges: no task sorts or holds more than a range of LIMIT values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 100_000  # values of a range that one task may sort
CUTS = 64  # parts a range is cut into by one pass


@dataclass(frozen=True)
class Range:
    """Values from low to high, both in it; below counts the values before, n those inside."""

    low: float
    high: float
    below: int
    n: int
    ranks: tuple[int, ...]


def _member(value: Column, ranges: list[Range]) -> Column:
    return F.coalesce(*[F.when((value >= r.low) & (value <= r.high), F.lit(i)) for i, r in enumerate(ranges)])


def _cut(rows: DataFrame, ranges: list[Range]) -> list[Range]:
    """The parts of the ranges that hold a rank. Cuts are near-quantiles from a sketch; each is a part of its own, so that ties shrink too."""
    inside = rows.select("v", _member(F.col("v"), ranges).alias("r")).where("r is not null")
    at = [i / CUTS for i in range(1, CUTS)]
    sketch = {x.r: sorted({*x.q, ranges[x.r].high}) for x in inside.groupBy("r").agg(F.percentile_approx("v", at, 1000).alias("q")).collect()}
    cuts = [sorted({y for x in sketch[i] for y in (x, math.nextafter(x, math.inf))}) for i in range(len(ranges))]
    part = F.coalesce(*[F.when(F.col("r") == i, F.size(F.filter(F.array(*[F.lit(c) for c in own]), lambda c: c <= F.col("v")))) for i, own in enumerate(cuts)])
    counted = inside.groupBy("r", part.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # a few hundred rows at most for each range
    out = []
    for i, r in enumerate(ranges):
        below = r.below
        for x in sorted((x for x in counted if x.r == i), key=lambda x: x.p):
            ranks = tuple(k for k in r.ranks if below <= k < below + x.n)
            if ranks:
                out.append(Range(x.low, x.high, below, x.n, ranks))
            below += x.n
    return out


def order_statistics(rows: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) of a numeric column in ascending order, nulls left out, NaN as the greatest; ranks must be below the count.

    Each pass counts the parts of the ranges that still hold more than LIMIT values and keeps the parts with a rank; only counts,
    bounds and the values asked for reach the driver.
    """
    rows = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    whole = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    found = {k: math.nan for k in ranks if k >= whole.n}
    inner = tuple(k for k in ranks if k < whole.n)
    ranges = [Range(whole.low, whole.high, 0, whole.n, inner)] if inner else []
    while ranges:
        found |= {k: r.low for r in ranges if r.low == r.high for k in r.ranks}
        ranges = [r for r in ranges if r.low < r.high]
        small, ranges = [r for r in ranges if r.n <= LIMIT], [r for r in ranges if r.n > LIMIT]
        if small:
            held = rows.select("v", _member(F.col("v"), small).alias("r")).where("r is not null").groupBy("r").agg(F.array_sort(F.collect_list("v")).alias("vs"))
            wanted = F.coalesce(*[F.when(F.col("r") == i, F.array(*[F.lit(k - r.below + 1) for k in r.ranks])) for i, r in enumerate(small)])
            for x in held.select("r", F.transform(wanted, lambda k: F.element_at(F.col("vs"), k)).alias("got")).collect():
                found |= dict(zip(small[x.r].ranks, x.got, strict=True))
        if ranges:
            ranges = _cut(rows, ranges)
    return found


def quantiles(rows: DataFrame, value: str, at: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation; None of a column without values."""
    n = rows.where(F.col(value).isNotNull()).count()
    if n == 0:
        return None
    places = [(n - 1) * q for q in at]
    got = order_statistics(rows, value, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}))
    low_high = [(p, math.floor(p), math.ceil(p)) for p in places]
    return [got[a] if got[a] == got[b] else (b - p) * got[a] + (p - a) * got[b] for p, a, b in low_high]
