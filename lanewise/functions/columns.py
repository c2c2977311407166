"""Shared column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
ON_TIME = "OnTime"
LATE = ("Late_1_2d", "Late_3_5d", "Late_5p")
LOST = "Lost"
IN_TRANSIT = "InTransit"
FAILED = (*LATE, LOST)
EVALUABLE = (ON_TIME, *FAILED)
ARRIVED = (ON_TIME, *LATE)
OUTCOMES = (
    "OnTime",
    "Late 1-2d",
    "Late 3-5d",
    "Late 5d+",
    "Lost",
    "Returned",
    "InTransit",
    "Cancelled",
)


# money -------------------------------------------------------------------------------


def line_gmv() -> Column:
    return F.col("quantity") * F.col("unit_price")


def money_label(amount: Column) -> Column:
    """Rupee text: crore from 1e7, lakh from 1e5, else the whole number."""
    value = amount.cast("double")
    return (
        F.when(value >= 1e7, F.concat(F.lit("Rs "), F.format_number(value / 1e7, 2), F.lit(" Cr")))
        .when(value >= 1e5, F.concat(F.lit("Rs "), F.format_number(value / 1e5, 2), F.lit(" L")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(value, 0)))
    )


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE, for consumers without a decimal type."""
    return df.select(
        [
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# time --------------------------------------------------------------------------------


def month_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM")


def month_date(timestamp: Column) -> Column:
    return F.trunc(timestamp, "MM")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between the date parts."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def month_range(first: str, last: str) -> list[str]:
    """Every `YYYY-MM` from `first` to `last`, both included."""
    y0, m0 = map(int, first.split("-"))
    y1, m1 = map(int, last.split("-"))
    span = range(y0 * 12 + m0 - 1, y1 * 12 + m1)
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in span]


# delivery ----------------------------------------------------------------------------


def is_delayed(status: Column) -> Column:
    """False when on time, true when late or lost, null while the outcome is open."""
    return F.when(status == ON_TIME, F.lit(False)).when(status.isin(*FAILED), F.lit(True))


def is_evaluable(status: Column) -> Column:
    """Outcome known. Never null: an order without a shipment is not evaluable."""
    return F.coalesce(status.isin(*EVALUABLE), F.lit(False))


def not_on_time(status: Column) -> Column:
    return status != ON_TIME


def is_on_time(delay_days: Column, shift: int) -> Column:
    """On time if the promise moved by `shift` days. A shipment that never arrived never is.

    The label counts a delivery as on time only from one day before the promise.
    """
    return F.coalesce(delay_days <= F.lit(shift - 1), F.lit(False))


def order_outcome(status: Column, delivery_status: Column) -> Column:
    """Where an order ended up. The order status wins over the shipment status."""
    return (
        F.when(status.isin("Cancelled", "Returned"), status)
        .when(delivery_status.isNull() | (delivery_status == IN_TRANSIT), F.lit("InTransit"))
        .when(delivery_status.isin(ON_TIME, LOST), delivery_status)
        .when(delivery_status == "Late_1_2d", F.lit("Late 1-2d"))
        .when(delivery_status == "Late_3_5d", F.lit("Late 3-5d"))
        .when(delivery_status == "Late_5p", F.lit("Late 5d+"))
        .otherwise(F.lit("Other"))
    )


# rates and bands ---------------------------------------------------------------------


def rate(numerator: Column, denominator: Column) -> Column:
    """Ratio in DOUBLE, null on an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def count_where(condition: Column) -> Column:
    """COUNT of rows where the condition holds."""
    return F.count(F.when(condition, F.lit(1)))


def share_where(condition: Column) -> Column:
    """Mean of a flag over the rows where the flag is known."""
    return F.avg(F.when(condition, F.lit(1.0)).when(~condition, F.lit(0.0)))


def delay_band(delayed_rate: Column, danger: float = 0.5, warning: float = 0.32) -> Column:
    return (
        F.when(delayed_rate >= danger, F.lit("danger"))
        .when(delayed_rate >= warning, F.lit("warning"))
        .otherwise(F.lit("success"))
    )


def severity(value: Column, high: float, middle: float) -> Column:
    """Traffic light for a 0-1 score where more is better; unknown scores are neutral."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("info"))
        .when(value >= high, F.lit("good"))
        .when(value >= middle, F.lit("warn"))
        .otherwise(F.lit("danger"))
    )


def all_present(columns: Sequence[str]) -> Column:
    """True where none of the columns is null (group keys of null are not reported)."""
    condition = F.col(columns[0]).isNotNull()
    for column in columns[1:]:
        condition = condition & F.col(column).isNotNull()
    return condition
