"""Joins of events with the events that precede them within a number of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(time: Column, days: int) -> Column:
    return F.floor(F.datediff(time, F.lit("1970-01-01")) / F.lit(days))


def events_before(
    events: DataFrame,
    earlier: DataFrame,
    keys: Sequence[str],
    time: str,
    days: int,
    earlier_time: str | None = None,
) -> DataFrame:
    """Every event with each earlier one of its keys in the `days` before it, in columns `e_...`.

    `event - days <= earlier < event`, to the instant. Time is cut into bins as long as the
    interval, so that an earlier event lies in the event's bin or the one before: both are
    probed by an equality on keys and bin, and the instants are compared in the pairs that
    meet. A key with very many events is so dealt by bin. Null keys and times meet nothing.
    """
    at = earlier_time or time
    renamed = earlier.select(
        *[F.col(c).alias(f"e_{c}") for c in earlier.columns], _bin(F.col(at), days).alias("e_bin")
    )
    probes = events.withColumn("_bin", _bin(F.col(time), days)).withColumn(
        "_bin", F.explode(F.array(F.col("_bin"), F.col("_bin") - 1))
    )
    same = F.col("_bin") == F.col("e_bin")
    for key in keys:
        same = same & (F.col(key) == F.col(f"e_{key}"))
    back = F.make_dt_interval(days=F.lit(days))
    in_time = (F.col(f"e_{at}") < F.col(time)) & (F.col(f"e_{at}") >= F.col(time) - back)
    return probes.join(renamed, same & in_time).drop("_bin", "e_bin")


def deliveries_before(history: DataFrame, days: int = 90) -> DataFrame:
    """Per delivery: the customer's deliveries in the days before it, and the latest of them.

    Deliveries of one instant are summed up on both sides before the join, so that pairs are
    formed between instants only. Takes a delivered history (`cohorts.delivered_history`).
    """
    instants = (
        history.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "event_at")
        .agg(F.count(F.lit(1)).alias("deliveries"))
    )
    found = (
        events_before(instants.drop("deliveries"), instants, ["customer_id"], "event_at", days)
        .groupBy("customer_id", "event_at")
        .agg(F.sum("e_deliveries").alias("earlier"), F.max("e_event_at").alias("latest"))
    )
    return history.join(found, ["customer_id", "event_at"], "left").select(
        "order_id",
        "customer_id",
        F.col("event_at").alias("delivered_at"),
        F.coalesce("earlier", F.lit(0)).alias("deliveries_before"),
        F.datediff("event_at", "latest").alias("days_since_last"),
    )
