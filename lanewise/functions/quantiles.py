"""Exact linear-interpolated quantiles of large columns."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# The sketch is off by at most 1/ACCURACY of the rows, well inside the spread.
SPREAD = 0.002
ACCURACY = 2_000
#: Rows in a range that one task may put in order. A range with more is cut again.
ORDERED_AT_ONCE = 50_000


@dataclass(frozen=True)
class Range:
    """The values of a column strictly between two ends; None is no end."""

    metric: str
    above: float | None = None
    below: float | None = None

    def holds(self) -> Column:
        value = F.col(self.metric)
        inside = value.isNotNull()
        if self.above is not None:
            inside &= value > self.above
        if self.below is not None:
            inside &= value < self.below
        return inside


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """One `(metric, p, quantile)` row per column and probability; none for empty columns."""
    found, _ = quantiles_with(df, columns, probabilities, [])
    rows = [(metric, p, value) for (metric, p), value in found.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, p double, quantile double")


def quantiles_with(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], also: Sequence[Column]
) -> tuple[dict[tuple[str, float], float], Row]:
    """Quantiles by column and probability, and the row of further aggregates of the first scan.

    `percentile` would hold every distinct value of a column in one aggregation buffer. Here
    sketched pivots on both sides of each wanted rank are counted exactly; a rank is then a
    pivot itself or lies between two of them, in about half a percent of the rows. That is
    repeated inside ranges until each has few enough rows to be put in order by one task. A
    poor sketch costs rounds and never changes the result. Each step is one aggregate whose
    size depends on the columns and probabilities alone.
    """
    values = df.select("*", *[F.col(c).cast("double").alias(f"{c}__value") for c in columns])
    named = {f"{c}__value": c for c in columns}
    cuts = sorted({min(max(p + s * SPREAD, 0.0), 1.0) for p in probabilities for s in (-1, 1)})
    first = values.agg(
        *also,
        *[F.count(v).alias(f"{v}__n") for v in named],
        *[F.percentile_approx(v, cuts, ACCURACY).alias(f"{v}__pivots") for v in named],
    ).first()
    sizes = {v: first[f"{v}__n"] for v in named}
    ranks = {
        v: sorted({r for p in probabilities for r in _ranks(p, sizes[v])}) for v in named if sizes[v]
    }
    at: dict[tuple[str, int], float] = {}
    open_ = {Range(v): (0, sizes[v], wanted) for v, wanted in ranks.items()}
    pivots = {Range(v): first[f"{v}__pivots"] for v in ranks}
    small: dict[Range, tuple[int, int, list[int]]] = {}
    while open_:
        for key in [k for k, (_, size, _) in open_.items() if size <= ORDERED_AT_ONCE]:
            small[key] = open_.pop(key)
        if not open_:
            break
        if missing := [k for k in open_ if k not in pivots]:
            pivots |= _sketched(values, {k: open_[k] for k in missing})
        cut = _cut(values, {k: (*open_[k], sorted(set(pivots.pop(k) or []))) for k in open_}, at)
        # A range that a poor sketch has hardly cut is put in order as it is.
        largest = max(size for _, size, _ in open_.values())
        open_ = {k: v for k, v in cut.items() if v[1] <= largest / 2}
        small |= {k: v for k, v in cut.items() if v[1] > largest / 2}
    _put_in_order(values, small, at)
    out = {}
    for v in ranks:
        for p in probabilities:
            low, high = _ranks(p, sizes[v])
            weight = p * (sizes[v] - 1) - low
            out[named[v], float(p)] = at[v, low] + (at[v, high] - at[v, low]) * weight
    return out, first


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _sketched(values: DataFrame, ranges: dict[Range, tuple[int, int, list[int]]]) -> dict:
    """Pivots on both sides of the wanted ranks, from the values of each range."""
    aggregates = []
    for i, (key, (before, size, wanted)) in enumerate(ranges.items()):
        places = [(rank - before) / size for rank in wanted]
        cuts = sorted({min(max(q + s * SPREAD, 0.0), 1.0) for q in places for s in (-1, 1)})
        inside = F.when(key.holds(), F.col(key.metric))
        aggregates.append(F.percentile_approx(inside, cuts, ACCURACY).alias(str(i)))
    row = values.agg(*aggregates).first()
    return dict(zip(ranges, row))


def _cut(values: DataFrame, ranges: dict, at: dict) -> dict[Range, tuple[int, int, list[int]]]:
    """Count below and through each pivot; ranks that are a pivot go to `at`."""
    aggregates = []
    for key, (*_, pivots) in ranges.items():
        value = F.col(key.metric)
        for pivot in pivots:
            aggregates += [F.count_if(value < pivot), F.count_if(value <= pivot)]
    counts = iter(values.agg(*aggregates).first()) if aggregates else iter(())
    out: dict[Range, tuple[int, int, list[int]]] = {}
    for key, (before, size, wanted, pivots) in ranges.items():
        through = [(pivot, next(counts), next(counts)) for pivot in pivots]
        parts = defaultdict(list)
        for rank in wanted:
            above, below, start, end = key.above, key.below, before, before + size
            for pivot, less, upto in through:
                if less <= rank < upto:
                    at[key.metric, rank] = pivot
                    break
                if upto <= rank:
                    above, start = pivot, upto
                elif below is None or pivot < below:
                    below, end = pivot, less
            else:
                parts[Range(key.metric, above, below), start, end - start].append(rank)
        out |= {part: (start, size, ranks) for (part, start, size), ranks in parts.items()}
    return out


def _put_in_order(values: DataFrame, ranges: dict, at: dict) -> None:
    """The wanted ranks of small ranges, from their values in order."""
    if not ranges:
        return
    keys = list(ranges)
    # A row is multiplied only by the ranges that it is in.
    inside = [
        F.when(k.holds(), F.struct(F.lit(i).alias("id"), F.col(k.metric).alias("value")))
        for i, k in enumerate(keys)
    ]
    counted = (
        values.select(F.inline(F.array_compact(F.array(*inside))))
        .groupBy("id", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = [(i, ranges[k][0], rank) for i, k in enumerate(keys) for rank in ranges[k][2]]
    wanted = values.sparkSession.createDataFrame(rows, "id int, before long, rank long")
    in_order = Window.partitionBy("id").orderBy("value")
    placed = counted.withColumn("upto", F.sum("n").over(in_order)).join(wanted, "id")
    place = F.col("rank") - F.col("before")
    hits = placed.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
    for row in hits.select("id", "rank", "value").collect():
        at[keys[row["id"]].metric, row["rank"]] = row["value"]
