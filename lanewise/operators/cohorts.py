"""Repeat purchase of cohorts split by how the first order went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.columns import IN_TRANSIT, ON_TIME, rate

FIRST_STATUS = "first_order_delay_status"
DELAYED, OPEN = "Delayed", "Open"


def delivered_history(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """`customer_id, order_id, event_at, delivery_status` of every delivered order."""
    delivered = shipments.filter(F.col("delivered_at").isNotNull())
    return orders.select("order_id", "customer_id").join(
        delivered.select(
            "order_id", F.col("delivered_at").alias("event_at"), "delivery_status"
        ),
        "order_id",
    )


def history_of_mart(orders: DataFrame) -> DataFrame:
    """The same columns from the order mart, where no join is left to do."""
    return orders.filter(F.col("delivered_at").isNotNull()).select(
        "customer_id", "order_id", F.col("delivered_at").alias("event_at"), "delivery_status"
    )


def placed_history(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """The same columns for every non-cancelled order, at the time it was placed."""
    return (
        orders.filter(F.col("status") != "Cancelled")
        .select("order_id", "customer_id", F.col("created_at").alias("event_at"))
        .join(shipments.select("order_id", "delivery_status"), "order_id", "left")
    )


def first_and_next(history: DataFrame) -> DataFrame:
    """Per customer: time and outcome of the first event, and the next later event time.

    Events at the same instant are merged first, so that `next_at` is strictly later; the
    lowest order id names the outcome, found as the lowest id per outcome because that
    aggregates in place. The rank filter runs before the shuffle to the customer: no
    customer sends more than two rows per map task.
    """
    status, order_id = F.col("delivery_status"), F.col("order_id")
    is_open = status.isNull() | (status == IN_TRANSIT)
    lowest = {
        ON_TIME: F.min(F.when(status == ON_TIME, order_id)),
        DELAYED: F.min(F.when(~is_open & (status != ON_TIME), order_id)),
        OPEN: F.min(F.when(is_open, order_id)),
    }
    by_time = Window.partitionBy("customer_id").orderBy("event_at")
    first_id = F.least(*lowest)
    outcome = F.coalesce(
        *[F.when(F.col(name) == first_id, F.lit(name)) for name in lowest]
    )
    return (
        history.groupBy("customer_id", "event_at")
        .agg(*[low.alias(name) for name, low in lowest.items()])
        .withColumn("rn", F.row_number().over(by_time))
        .filter(F.col("rn") <= 2)
        .groupBy("customer_id")
        .agg(
            F.min("event_at").alias("first_at"),
            F.max(F.when(F.col("rn") == 1, outcome)).alias("first_outcome"),
            F.max(F.when(F.col("rn") == 2, F.col("event_at"))).alias("next_at"),
        )
    )


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def cohort_members(
    history: DataFrame, window_days: int = 90, open_outcome: str = "Delayed"
) -> DataFrame:
    """Customers with a full observation window, their cohort and their repeat flag.

    A customer is in when `first_at + window` is not after the last event of the data, and
    repeated when the next event lies in `(first_at, first_at + window]`. `open_outcome`
    names the cohort of a first order whose delivery outcome is not known.
    """
    last_event = history.agg(F.max("event_at")).scalar()
    return members_of(first_and_next(history), last_event, window_days, open_outcome)


def members_of(
    firsts: DataFrame, last_event: Column, window_days: int = 90, open_outcome: str = "Delayed"
) -> DataFrame:
    """The same from each customer's first and next event."""
    window_end = F.col("first_at") + _days(window_days)
    outcome = F.col("first_outcome")
    return firsts.filter(window_end <= last_event).select(
        "customer_id",
        "first_at",
        F.when(outcome == OPEN, F.lit(open_outcome)).otherwise(outcome).alias(FIRST_STATUS),
        F.coalesce(F.col("next_at") <= window_end, F.lit(False)).alias("repeated"),
        F.datediff("next_at", "first_at").alias("days_to_next"),
    )


def repeat_curve(history: DataFrame, window_days: int = 90) -> DataFrame:
    """Share of each cohort that has come back by each day after the first delivery.

    Days without a return have no row; the share on such a day is that of the day before.
    """
    members = cohort_members(history, window_days)
    per_day = members.groupBy(FIRST_STATUS, F.when(F.col("repeated"), F.col("days_to_next")).alias("day")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    # At most one row per day of the window in a cohort.
    cohort = Window.partitionBy(FIRST_STATUS)
    so_far = cohort.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("day").isNotNull(), F.col("customers")).otherwise(0)
    return (
        per_day.withColumn("in_cohort", F.sum("customers").over(cohort))
        .withColumn("repeated", F.sum(known).over(so_far))
        .filter(F.col("day").isNotNull())
        .select(
            FIRST_STATUS, "day", "repeated", rate(F.col("repeated"), F.col("in_cohort")).alias("share")
        )
    )


def repeat_curve_censored(
    history: DataFrame, max_days: int = 180, open_outcome: str = "Delayed"
) -> DataFrame:
    """The same share by the product-limit estimate, with customers of any observation time.

    A customer counts as long as seen: until the next delivery, or until the data end. On each
    day with returns the share of those still at risk who come back that day is taken off
    from what is left. Days are counted up to whole ones for returns (within `d` days means
    day `d` or earlier) and down for the end of the data. Where nobody's observation ends
    before, the share is that of `b2_first_delay_repeat` for the same window.
    """
    last_event = history.agg(F.max("event_at")).scalar()
    outcome = F.col("first_outcome")
    back = F.ceil(F.timestamp_diff("SECOND", "first_at", "next_at") / 86_400)
    seen = F.floor(F.timestamp_diff("SECOND", "first_at", F.col("last_event")) / 86_400)
    per_day = (
        first_and_next(history)
        .withColumn("last_event", last_event)
        .select(
            F.when(outcome == OPEN, F.lit(open_outcome)).otherwise(outcome).alias(FIRST_STATUS),
            F.coalesce(back, seen).cast("int").alias("day"),
            back.isNotNull().alias("came_back"),
        )
        .groupBy(FIRST_STATUS, "day")
        .agg(F.count_if("came_back").alias("repeated"), F.count(F.lit(1)).alias("gone"))
    )
    # At most one row per day in a cohort.
    cohort = Window.partitionBy(FIRST_STATUS)
    by_day = cohort.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = cohort.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("gone").over(cohort) - F.coalesce(F.sum("gone").over(earlier), F.lit(0))
    stays = F.col("at_risk") - F.col("repeated")
    log_share = F.when(stays > 0, F.log(stays / F.col("at_risk")))
    nobody = F.max(F.when(stays == 0, 1).otherwise(0)).over(by_day) == 1
    share = F.when(nobody, F.lit(1.0)).otherwise(1 - F.exp(F.sum(log_share).over(by_day)))
    return (
        per_day.withColumn("at_risk", left)
        .withColumn("share", F.round(share, 6))
        .filter((F.col("repeated") > 0) & (F.col("day") <= max_days))
        .select(FIRST_STATUS, "day", "at_risk", "repeated", "share")
    )


def b2_first_delay_repeat(
    history: DataFrame, window_days: int = 90, open_outcome: str = "Delayed"
) -> DataFrame:
    """Repeat rate within the window, by whether the first order was on time."""
    return b2_of_members(cohort_members(history, window_days, open_outcome), window_days)


def b2_of_members(members: DataFrame, window_days: int = 90) -> DataFrame:
    repeated = F.count_if("repeated")
    return (
        members.groupBy(FIRST_STATUS)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            repeated.alias("repeated"),
            F.round(rate(repeated, F.count(F.lit(1))), 4).alias(
                f"{window_days}_day_repeat_rate"
            ),
        )
        .orderBy(FIRST_STATUS)
    )


def b2_sensitivity(orders: DataFrame, shipments: DataFrame, window_days: int = 90) -> DataFrame:
    """The cohort by first non-cancelled order, whether or not it arrived.

    First order, repeat and cutoff all go by the time of placing; a first order that is
    still under way is reported as `Unknown`.
    """
    return b2_first_delay_repeat(
        placed_history(orders, shipments), window_days, open_outcome="Unknown"
    )


def cohort_spot_check(
    first_orders: DataFrame,
    delivered: DataFrame,
    n: int = 5,
    seed: int = 7,
    window_days: int = 90,
) -> DataFrame:
    """`n` eligible customers per cohort with the length of their delivery history.

    The sample is the `n` lowest hashes of (seed, customer), so it does not depend on the
    partitioning. `delivered` is a delivered history; only the sampled customers' rows of
    it leave the scan stage.
    """
    last_event = delivered.agg(F.max("event_at")).scalar()
    window_end = F.col("first_delivered_at") + _days(window_days)
    ticket = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("customer_id").cast("string")))
    drawn = Window.partitionBy(FIRST_STATUS).orderBy("ticket", "customer_id")
    sample = (
        first_orders.filter(F.col(FIRST_STATUS).isin("OnTime", "Delayed"))
        .filter(window_end <= last_event)
        .select("customer_id", FIRST_STATUS, "first_delivered_at", ticket.alias("ticket"))
        .withColumn("rn", F.row_number().over(drawn))
        .filter(F.col("rn") <= n)
    )
    event = F.col("event_at")
    return (
        delivered.select("customer_id", "event_at")
        .join(sample, "customer_id")
        .groupBy("customer_id", F.col(FIRST_STATUS).alias("cohort"), "first_delivered_at")
        .agg(
            F.count(F.lit(1)).alias("delivered_orders_total"),
            F.bool_or((event > F.col("first_delivered_at")) & (event <= window_end)).alias(
                "repeated_within_window"
            ),
        )
        .withColumn("first_delivered_at", F.to_date("first_delivered_at"))
    )
