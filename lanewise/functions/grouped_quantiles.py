"""Exact quantiles per group, for many groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.sources.marts import shared_folder, write_mart

#: Size parameter of the sketches, and the share of a part's rows that a bracket reaches to
#: both sides of a wanted rank. Sketches of this size are off by well under one percent.
SKETCH_K = 400
SPREAD = 0.02
GRID = 200
#: Distinct values of a bracket that one task may put in order.
ORDERED_AT_ONCE = 50_000
#: Every round leaves a part with about a twentieth of its rows.
MAX_ROUNDS = 40


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """`keys, p, n, quantile`: linear-interpolated quantiles of the values in each group, exact.

    Each group is sketched; the sketch gives a bracket around every wanted rank, and one pass
    counts exactly what lies below and inside the brackets. A bracket with few distinct values
    is put in order; the rows of the others are written apart and go through the next round.
    So no task orders more than a bounded number of values, however many rows a group has. The
    sketches decide about rounds, never about results: a bracket that misses is made wider.

    Null values are left out, a null key is a group, and a group without values has no row.
    """
    folder = shared_folder(df.sparkSession, "quantiles")
    group = [f"g{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(value).cast("double").alias("v")
    )
    # In the first round all ranks of a group share its rows; later each has a part of its own.
    parts = write_mart(rows.withColumn("part", F.lit(0.0)), folder, "rows-0")
    steps = F.array(*[F.lit(float(p)) for p in sorted(set(probabilities))])
    place = F.col("p") * (F.col("n") - 1)
    wanted = (
        parts.groupBy(*group, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("p", F.explode(steps))
        .withColumns(
            {
                "low": F.floor(place).cast("long"),
                "high": F.ceil(place).cast("long"),
                "before": F.lit(0).cast("long"),
                "spread": F.lit(SPREAD),
            }
        )
    )
    found = []
    for turn in range(1, MAX_ROUNDS + 1):
        brackets = write_mart(_brackets(parts, wanted, group), folder, f"brackets-{turn}")
        counted = write_mart(_counted(parts, brackets, group), folder, f"counted-{turn}")
        hit = (F.col("low") >= F.col("below")) & (F.col("high") < F.col("upto"))
        small = (F.col("values") <= ORDERED_AT_ONCE) | (F.col("from") == F.col("to"))
        found.append(_in_order(parts, counted.where(hit & small), group))
        rest = counted.where(~(hit & small))
        if rest.isEmpty():
            results = reduce(DataFrame.unionByName, found)
            return results.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], "p", "n", "quantile")
        # A bracket that hit is the next part; one that missed is tried again, twice as wide.
        ends = {
            "from": F.when(hit, F.col("from")).otherwise(F.lit(float("-inf"))),
            "to": F.when(hit, F.col("to")).otherwise(F.lit(float("inf"))),
            "before": F.when(hit, F.col("below")).otherwise(F.col("before")),
            "spread": F.when(hit, F.lit(SPREAD)).otherwise(2 * F.col("spread")),
        }
        rest = write_mart(rest.withColumns(ends), folder, f"rest-{turn}")
        inside = _joined(parts, rest, [*group, "part"]).where(F.col("v").between(F.col("from"), F.col("to")))
        parts = write_mart(inside.select(*group, F.col("p").alias("part"), "v"), folder, f"rows-{turn}")
        wanted = rest.select(*group, F.col("p").alias("part"), "n", "p", "low", "high", "before", "spread")
    raise RuntimeError("the sketches do not narrow the brackets down")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join where nulls are equal; Spark broadcasts the brackets if they are few."""
    same = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    more = [f"r.{c}" for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *more)


def _brackets(parts: DataFrame, wanted: DataFrame, group: Sequence[str]) -> DataFrame:
    """The wanted ranks with values `from` and `to` on both sides of them, by sketch."""
    sketches = parts.groupBy(*group, "part").agg(
        F.count(F.lit(1)).alias("size"), F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("sketch")
    )

    # Sketches are asked for fixed shares, of which the next one outwards is taken.
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    sketches = sketches.select(*group, "part", "size", grid.alias("grid"))

    def end(rank: str, sign: int) -> Column:
        share = (F.col(rank) - F.col("before") + 0.5) / F.col("size") + sign * F.col("spread")
        step = (F.floor(share * GRID) if sign < 0 else F.ceil(share * GRID)).cast("int")
        beyond = step <= 0 if sign < 0 else step >= GRID
        limit = F.lit(float("-inf") if sign < 0 else float("inf"))
        return F.when(beyond, limit).otherwise(F.get("grid", step))

    joined = _joined(wanted, sketches, [*group, "part"])
    return joined.select(*wanted.columns, end("low", -1).alias("from"), end("high", 1).alias("to"))


def _counted(parts: DataFrame, brackets: DataFrame, group: Sequence[str]) -> DataFrame:
    """The brackets with the exact number of the group's rows `below` and `upto` their ends,
    and about how many distinct values they hold."""
    value, inside = F.col("v"), F.col("v").between(F.col("from"), F.col("to"))
    return (
        _joined(parts, brackets, [*group, "part"])
        .groupBy(*brackets.columns)
        .agg(
            F.count_if(value < F.col("from")).alias("less"),
            F.count_if(value <= F.col("to")).alias("through"),
            F.approx_count_distinct(F.when(inside, value)).alias("values"),
        )
        .withColumn("below", F.col("before") + F.col("less"))
        .withColumn("upto", F.col("before") + F.col("through"))
        .drop("less", "through")
    )


def _in_order(parts: DataFrame, counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Quantiles of brackets whose values one task can order."""
    bracket = [*group, "p"]
    values = (
        _joined(parts, counted, [*group, "part"])
        .where(F.col("v").between(F.col("from"), F.col("to")))
        .groupBy(*bracket, "n", "low", "high", "below", "v")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    reached = F.sum("rows").over(Window.partitionBy(*bracket).orderBy("v")) + F.col("below")
    values = values.withColumn("reached", reached)

    def at(rank: str) -> Column:
        return F.min(F.when(F.col(rank) < F.col("reached"), F.col("v")))

    ends = values.groupBy(*bracket, "n", "low").agg(at("low").alias("first"), at("high").alias("second"))
    weight = F.col("p") * (F.col("n") - 1) - F.col("low")
    quantile = F.col("first") + (F.col("second") - F.col("first")) * weight
    return ends.select(*bracket, "n", quantile.alias("quantile"))
