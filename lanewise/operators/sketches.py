"""Approximate distinct counts that add up: sketches per cell, merged over any roll-up.

Opt-in: reports count exactly. A sketch of 2 ** LG_K registers is off by about
1.04 / sqrt(2 ** LG_K), 1.6 % at the default, one time in three by more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
COUNTED = {"orders": "order_id", "customers": "customer_id"}
CELL = ("order_month", "city", "category", "carrier")


def relative_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The share by which an estimate may be off, at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)


def distinct_sketches(lines: DataFrame, *keys: str, lg_k: int = LG_K) -> DataFrame:
    """A sketch of the orders and one of the customers per cell, to be stored as a mart."""
    return lines.groupBy(*(keys or CELL)).agg(
        *[F.hll_sketch_agg(column, F.lit(lg_k)).alias(name) for name, column in COUNTED.items()]
    )


def approximate_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct orders and customers per roll-up of the cells, from the cells alone."""
    return sketches.groupBy(*keys).agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in COUNTED]
    )


def exact_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """The same counts exactly, each from a grouping on the finer key."""
    frames = [
        lines.select(*keys, column)
        .where(F.col(column).isNotNull())
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(name))
        for name, column in COUNTED.items()
    ]
    return frames[0].join(frames[1], list(keys), "full")


def compared_counts(sketches: DataFrame, lines: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Exact counts per roll-up, and whether the estimates are within the stated error."""
    estimates = approximate_counts(sketches, *keys).select(
        *keys, *[F.col(c).alias(f"{c}_estimate") for c in COUNTED]
    )
    error = F.lit(relative_error(lg_k))
    within = [
        (F.abs(F.col(f"{c}_estimate") - F.col(c)) <= F.greatest(error * F.col(c), F.lit(1.0))).alias(
            f"{c}_within"
        )
        for c in COUNTED
    ]
    return exact_counts(lines, *keys).join(estimates, list(keys)).select(*keys, *COUNTED, *within)
