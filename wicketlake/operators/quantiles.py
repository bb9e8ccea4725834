"""Exact quantiles by distributed selection (A10, Q7).

A quantile of n values is an interpolation between two order statistics. All
wanted order statistics of all columns are found together, in rounds: a range
that is known to hold the rank is cut into ``BINS`` ordered bins, one partial
aggregate counts the values of each bin, and the search goes on in the bin
that holds the rank, between the smallest and the largest value found there.
A task keeps at most ``BINS`` counters for each range, and only these
counters, never values, reach the driver; a filter on the range goes down to
the scan.

A range across zero is first cut at zero, a wide one is cut by the logarithm
and a narrow one evenly, so a range of doubles is settled in about eight
rounds whatever the distribution (1,024 bins are ten bits a round). Nulls and
NaN are left out; ties, constants and empty columns need no special case (an
empty column has null quantiles).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


@dataclass
class _Range:
    """Values of one column from ``low`` to ``high``: ``below`` values are
    smaller, and ``ranks`` (from 0) lie among the ``count`` inside."""

    column: str
    low: float
    high: float
    below: int
    count: int
    ranks: list[int] = field(default_factory=list)

    def bin_of(self, x: Column) -> Column:
        """The bin of a value, which never falls as the value grows."""
        low, high = self.low, self.high
        if math.isinf(low) or math.isinf(high):
            return F.when(x == float("-inf"), -1).when(x == float("inf"), 1).otherwise(0)
        if low < 0 < high:
            return F.signum(x).cast("int")
        size = min(abs(low), abs(high))
        if size == 0:
            # Zero, and the others by their logarithm.
            edge = math.log(max(abs(low), abs(high)))
            part = F.when(x == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.lit(BINS) + F.floor((F.log(F.abs(x)) - F.lit(edge)) * F.lit(BINS / 1500.0))))
            return (part if high > 0 else -part).cast("int")
        if max(abs(low), abs(high)) / size > 4:
            a, b = math.log(size), math.log(max(abs(low), abs(high)))
            part = F.floor((F.log(F.abs(x)) - F.lit(a)) * F.lit(BINS / (b - a)))
            return (part if high > 0 else -part).cast("int")
        return F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS))).cast("int")


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], weight: str | None = None,
                     bounds: dict[str, tuple] | None = None) -> dict[tuple[str, int], float]:
    """The values at ``wanted`` ranks (from 0, of the ascending non-null
    values as doubles) of several columns. ``weight`` counts a row that often."""
    times = F.lit(1) if weight is None else F.col(weight)
    bounds = bounds or column_bounds(df, list(wanted), weight)
    found: dict[tuple[str, int], float] = {}
    ranges = [_Range(c, *bounds[c][1:], 0, bounds[c][0], sorted(set(r))) for c, r in wanted.items() if bounds[c][0]]
    while ranges:
        open_ranges = []
        for r in ranges:
            if r.low == r.high:
                found |= {(r.column, rank): r.low for rank in r.ranks}
            else:
                open_ranges.append(r)
        if not open_ranges:
            break

        def value(r: _Range) -> Column:
            return F.col(f"`{r.column}`").cast("double")

        def inside(r: _Range) -> Column:
            x = value(r)
            return (x >= F.lit(r.low)) & (x <= F.lit(r.high))

        hits = F.array(*[F.when(inside(r), F.struct(F.lit(k).alias("k"), r.bin_of(value(r)).alias("bin"), value(r).alias("x")))
                         for k, r in enumerate(open_ranges)])
        some = inside(open_ranges[0])
        for r in open_ranges[1:]:
            some = some | inside(r)
        rows = df.filter(some).select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"), times.alias("n"))
        counted = rows.groupBy("h.k", "h.bin").agg(F.sum("n").alias("n"), F.min("h.x").alias("low"), F.max("h.x").alias("high"))
        bins: dict[int, list] = {}
        for row in counted.collect():  # at most BINS and a few rows per range
            bins.setdefault(row.k, []).append((row.bin, row.n, row.low, row.high))
        ranges = []
        for k, r in enumerate(open_ranges):
            below = r.below
            for _, n, low, high in sorted(bins[k]):
                own = [rank for rank in r.ranks if below <= rank < below + n]
                if own:
                    ranges.append(_Range(r.column, low, high, below, n, own))
                below += n
    return found


def column_bounds(df: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, tuple]:
    """``(count, min, max)`` of the non-null values of every column."""
    times = F.lit(1) if weight is None else F.col(weight)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        aggs += [F.coalesce(F.sum(F.when(x.isNotNull(), times)), F.lit(0)).alias(f"n{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], weight: str | None = None) -> dict[str, list[float | None]]:
    """The quantiles of several columns, interpolated between neighbours."""
    bounds = column_bounds(df, columns, weight)

    def places(c: str) -> list[float]:
        return [(bounds[c][0] - 1) * q for q in shares] if bounds[c][0] else []

    wanted = {c: [int(f(p)) for p in places(c) for f in (math.floor, math.ceil)] for c in columns}
    values = order_statistics(df, wanted, weight, bounds)
    out = {}
    for c in columns:
        if not bounds[c][0]:
            out[c] = [None] * len(shares)
            continue
        made = []
        for p in places(c):
            low, high = values[c, math.floor(p)], values[c, math.ceil(p)]
            made.append(low + (high - low) * (p - math.floor(p)))
        out[c] = made
    return out
