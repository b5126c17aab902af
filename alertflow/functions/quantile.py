"""Exact quantiles by rounds of histogram narrowing: no value is ordered anywhere."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a round; a round's answer has at most this many rows for each rank looked for.
BUCKETS = 1024


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]], buckets: int = BUCKETS) -> dict[str, float | None]:
    """Interpolated quantiles of non-null values by name, from (column, share); None for a column without values.

    A quantile lies between two order statistics. Each round counts, for every one of them, the values of its range in
    equal buckets, as one combinable aggregate for all columns, and narrows the range to the smallest and largest value
    of the bucket that holds the rank. It ends when they are equal, so repeats of a value cost nothing; ranges shrink by
    the number of buckets each round. NaN counts as no value.
    """
    columns = sorted({c for c, _ in wanted.values()})
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    ends = [f(value[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    first = df.agg(*ends).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    sizes = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    for c, q in wanted.values():
        if sizes[c]:
            place, i = q * (sizes[c] - 1), columns.index(c)
            for rank in (math.floor(place), math.ceil(place)):
                open_[(c, rank)] = (first[f"low{i}"], first[f"high{i}"], rank)
    while open_:
        for key in [k for k, (low, high, _) in open_.items() if low == high]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        bucket = []
        for j, (c, low, high) in enumerate(ranges):
            # halves first: the width of a range of doubles need not be a double
            at = (value[c] / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * F.lit(float(buckets))
            at = F.least(F.floor(at), F.lit(buckets - 1)) if high / 2 > low / 2 else (value[c] > low).cast("long")
            inside = (value[c] >= low) & (value[c] <= high)
            bucket.append(F.when(inside, F.struct(F.lit(j).alias("j"), at.alias("b"), value[c].alias("v"))))
        hits = df.select(F.explode(F.array_compact(F.array(*bucket))).alias("h")).select("h.*")
        counts = hits.groupBy("j", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["j"], r["low"])):
            by_range.setdefault(r["j"], []).append(r)
        for (c, rank), (low, high, left) in list(open_.items()):
            for r in by_range[ranges.index((c, low, high))]:
                if left < r["n"]:
                    open_[(c, rank)] = (r["low"], r["high"], left)
                    break
                left -= r["n"]
    out: dict[str, float | None] = {}
    for name, (c, q) in wanted.items():
        if not sizes[c]:
            out[name] = None
            continue
        place = q * (sizes[c] - 1)
        a, b = found[(c, math.floor(place))], found[(c, math.ceil(place))]
        out[name] = a + (b - a) * (place - math.floor(place))
    return out


def exact_quantile(df: DataFrame, column: str, q: float, buckets: int = BUCKETS) -> Column:
    """One interpolated quantile as a literal."""
    return F.lit(exact_quantiles(df, {"q": (column, q)}, buckets)["q"]).cast("double")
