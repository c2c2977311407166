"""First-look profiling of the source tables and marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.quantiles import quantiles_with
from lanewise.functions.reshape import rows_from, value_with_text

TIME_COLUMNS = {
    "orders": ("created_at", "promised_delivery_date"),
    "shipments": ("shipped_at", "delivered_at"),
    "customers": ("signup_date",),
}
CATEGORY_COLUMNS = {
    "orders": ("status", "payment_method", "is_fast_delivery_eligible"),
    "shipments": ("carrier", "delivery_status"),
    "customers": ("segment", "city"),
    "products": ("category",),
}
ITEM_NUMERICS = (
    "quantity",
    "unit_price",
    "discount_pct",
    "platform_fee_pct",
    "gmv_line",
    "gmv_after_disc",
    "platform_fee",
)
QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def profile_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
            )
            for name, df in tables.items()
        ]
    )


def _per_column(df: DataFrame, measure) -> DataFrame:
    """One aggregate per column of `df` in a single pass, as one row."""
    return df.agg(*[measure(F.col(c)).alias(c) for c in df.columns])


def profile_schema(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column, type and number of values (non-null) of every table."""
    return _union(
        [
            rows_from(
                _per_column(df, F.count),
                [
                    {
                        "table_name": F.lit(name),
                        "column_name": F.lit(c),
                        "dtype": F.lit(dtype),
                        "n_values": F.col(c),
                    }
                    for c, dtype in df.dtypes
                ],
            )
            for name, df in tables.items()
        ]
    )


def profile_null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns that hold nulls; a table without any is listed once as `no nulls`."""

    def nulls(df: DataFrame, name: str) -> DataFrame:
        counted = _per_column(df, lambda c: F.count_if(c.isNull()))
        found = F.filter(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"))
                    for c in df.columns
                ]
            ),
            lambda entry: entry["n_null"] > 0,
        )
        marker = F.array(
            F.struct(
                F.lit("no nulls").alias("column_name"), F.lit(0).cast("long").alias("n_null")
            )
        )
        return counted.select(
            F.lit(name).alias("table_name"),
            F.inline(F.when(F.size(found) > 0, found).otherwise(marker)),
        )

    return _union([nulls(df, name) for name, df in tables.items()])


def profile_time_ranges(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] = TIME_COLUMNS
) -> DataFrame:
    """Earliest and latest value of every time column; dates count as midnight."""

    def bounds(df: DataFrame, name: str, times: Sequence[str]) -> DataFrame:
        ends = df.agg(
            *[F.min(c).alias(f"{c}__min") for c in times],
            *[F.max(c).alias(f"{c}__max") for c in times],
        )
        return rows_from(
            ends,
            [
                {
                    "column_name": F.lit(f"{name}.{c}"),
                    "min_value": F.col(f"{c}__min").cast("timestamp_ntz"),
                    "max_value": F.col(f"{c}__max").cast("timestamp_ntz"),
                }
                for c in times
            ],
        )

    return _union([bounds(tables[name], name, times) for name, times in columns.items()])


def profile_value_counts(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] = CATEGORY_COLUMNS
) -> DataFrame:
    """Rows per value, null included; rows are counted per combination before they are multiplied."""
    return _union(
        [
            tables[name]
            .groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("rows", value_with_text(cols, "column_name", "value"))
            .groupBy("column_name", "value")
            .agg(F.sum("rows").alias("n"))
            .select(F.lit(name).alias("table_name"), "column_name", "value", "n")
            for name, cols in columns.items()
        ]
    )


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per column, rounded."""
    moments = [
        F.struct(
            F.count(c).alias("n"),
            F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
            F.min(c).cast("double").alias("min_value"),
            F.max(c).cast("double").alias("max_value"),
        ).alias(c)
        for c in columns
    ]
    found, first = quantiles_with(df, columns, list(QUARTILES.values()), moments)
    stats = ["mean", "std", "min_value", *QUARTILES, "max_value"]
    rows = []
    for c in columns:
        values = first[c].asDict() | {name: found.get((c, p)) for name, p in QUARTILES.items()}
        rows.append((c, values["n"], *[values[stat] for stat in stats]))
    schema = "metric string, n long, " + ", ".join(f"{stat} double" for stat in stats)
    return df.sparkSession.createDataFrame(rows, schema).select(
        "metric", "n", *[F.round(stat, digits).alias(stat) for stat in stats]
    )


def profile_item_describe(items_enriched: DataFrame) -> DataFrame:
    return describe(items_enriched, ITEM_NUMERICS)


def profile_delay_describe(shipments_enriched: DataFrame) -> DataFrame:
    return describe(shipments_enriched, ["delivery_delay_days"])


def filter_domains(lines: DataFrame) -> DataFrame:
    """Choices for the slice filters: distinct names, and the first and last order date."""
    names = ["city", "category", "carrier"]
    # One scan: a row per combination, with its dates, serves both.
    combinations = lines.groupBy(*names).agg(
        F.to_date(F.min("created_at")).alias("first"), F.to_date(F.max("created_at")).alias("last")
    )
    ends = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(column).cast("string").alias("value"))
            for name, column in [*zip(names, names), ("date_from", "first"), ("date_to", "last")]
        ]
    )
    long = combinations.select(F.inline(ends)).where(F.col("value").isNotNull()).distinct()
    is_date = F.col("dimension").isin("date_from", "date_to")
    return (
        long.groupBy("dimension", F.when(~is_date, F.col("value")).alias("name"))
        .agg(
            F.when(F.col("dimension") == "date_from", F.min("value"))
            .otherwise(F.max("value"))
            .alias("value")
        )
        .select("dimension", "value")
        .orderBy("dimension", "value")
    )
