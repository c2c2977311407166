"""Wide one-row aggregates to rows, and one-pass roll-ups over several dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lanewise.sources.marts import shared_folder, write_mart


def rows_from(df: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn each row of `df` into the given rows; the mappings name the output columns."""
    structs = [
        F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows
    ]
    return df.select(F.inline(F.array(*structs)))


def value_with_text(columns: Sequence[str], name: str, value: str) -> Column:
    """Explode several columns into (column name, value as text) pairs."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value))
                for c in columns
            ]
        )
    )


def roll_up_dimensions(
    df: DataFrame, dimensions: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """`(dimension, value, sums...)` for each dimension from one pass over `df`.

    `df` is first summed to the combinations of all dimensions, so the rows that are
    repeated per dimension are only those combinations.
    """
    cells = df.groupBy(*dimensions).agg(*[F.sum(s).alias(s) for s in sums])
    long = cells.select(*sums, value_with_text(dimensions, "dimension", "value"))
    named = long.filter(F.col("value").isNotNull())
    return named.groupBy("dimension", "value").agg(*[F.sum(s).alias(s) for s in sums])


def few_rows(df: DataFrame) -> list[Row]:
    """The rows of a frame whose number does not grow with the data: one per month, mart or part."""
    return df.collect()


def cells(df: DataFrame) -> DataFrame:
    """The cells of a pivot, stored: the columns and the pivot itself are both taken from them."""
    return write_mart(df, shared_folder(df.sparkSession, "cells"), "cells")


def domain(df: DataFrame, column: str, listed: Sequence | None = None) -> list:
    """The distinct values of a column in order, for the columns of a pivot.

    Nulls are no column. A list fixes the order and may hold further values, but every value
    found must be in it: a pivot drops unlisted values without a word.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    values = sorted(row[0] for row in found)
    if listed is None:
        return values
    if missing := [value for value in values if value not in set(listed)]:
        raise ValueError(f"{column}: values that are not listed: {missing}")
    return list(listed)
