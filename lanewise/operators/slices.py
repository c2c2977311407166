"""Reports on a filtered slice of the line mart.

Every operator takes line rows (`features.dashboard_lines`, usually after `slice_lines`).
Orders are counted once: the lines are reduced to one row per order, with only the order
columns that the report needs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.columns import (
    ARRIVED,
    OUTCOMES,
    all_present,
    count_where,
    delay_band,
    money_label,
    not_on_time,
    order_outcome,
    rate,
    severity,
)
from lanewise.functions.reshape import cells, domain, roll_up_dimensions
from lanewise.operators.features import LINE_ORDER_COLUMNS

LANE = ("carrier", "ship_to_city")


def slice_lines(
    lines: DataFrame,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    cities: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    carriers: Sequence[str] | None = None,
) -> DataFrame:
    """Lines in the date range (both days included) and lists. `None` does not filter.

    Lines without a carrier, that is of unshipped orders, pass the carrier filter.
    """
    kept = lines
    day = F.to_date("created_at")
    if date_from is not None:
        kept = kept.filter(day >= F.lit(date_from))
    if date_to is not None:
        kept = kept.filter(day <= F.lit(date_to))
    if cities is not None:
        kept = kept.filter(F.col("city").isin(*cities))
    if categories is not None:
        kept = kept.filter(F.col("category").isin(*categories))
    if carriers is not None:
        kept = kept.filter(F.col("carrier").isin(*carriers) | F.col("carrier").isNull())
    return kept


def order_level(lines: DataFrame, *columns: str) -> DataFrame:
    """One row per order of the slice with the given order columns and the slice's GMV.

    The order columns are equal on all lines of an order, so they can be group keys.
    """
    return lines.groupBy("order_id", *columns).agg(F.sum("gmv_line").alias("gmv"))


def order_lines(lines: DataFrame) -> DataFrame:
    """The slice with one line per order: its order columns and its GMV.

    Reports on orders give the same numbers on this frame as on the lines. It is laid out by
    order, so that where it is persisted they need no shuffle on the order of their own.
    """
    columns = [*LINE_ORDER_COLUMNS, "evaluable_delivery"]
    return (
        lines.repartition("order_id")
        .groupBy(*columns)
        .agg(F.sum("gmv_line").alias("gmv_line"))
    )


def _evaluable(lines: DataFrame, *columns: str) -> DataFrame:
    """Distinct orders with a known delivery outcome, with a `delayed` flag."""
    return (
        lines.filter("evaluable_delivery")
        .select("order_id", *columns, not_on_time(F.col("delivery_status")).alias("delayed"))
        .distinct()
    )


def _orders_and_rate() -> tuple[Column, Column]:
    orders = F.count(F.lit(1))
    return orders.alias("orders"), rate(count_where(F.col("delayed")), orders).alias("delayed_rate")


# KPI strip ---------------------------------------------------------------------------


def kpi_strip(lines: DataFrame) -> DataFrame:
    """Headline numbers of the slice as one row; rates are null on an empty slice.

    Lines are summed to orders, orders to customers and customers to the total, so that
    every distinct count is a plain count.
    """
    status = F.col("delivery_status")
    late = F.col("evaluable_delivery") & not_on_time(status)
    late_days = F.when(late, F.col("delivery_delay_days"))
    orders = order_level(
        lines, "customer_id", "delivery_status", "evaluable_delivery", "delivery_delay_days"
    )
    customers = orders.groupBy("customer_id").agg(
        F.sum("gmv").alias("gmv"),
        F.count("order_id").alias("orders"),
        count_where(F.col("evaluable_delivery")).alias("evaluable"),
        count_where(late).alias("delayed"),
        F.sum(late_days).alias("late_days"),
        F.count(late_days).alias("late_known"),
        count_where(status.isin(*ARRIVED)).alias("arrived"),
    )
    known = F.col("customer_id").isNotNull()
    buyers = count_where(known & (F.col("arrived") >= 1))
    loyal = count_where(known & (F.col("arrived") >= 2))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return customers.agg(
        total("gmv").alias("gmv"),
        total("orders").alias("n_orders"),
        count_where(known).alias("n_customers"),
        total("evaluable").alias("evaluable_orders"),
        total("delayed").alias("delayed_orders"),
        rate(loyal, buyers).alias("repeat_rate"),
        rate(F.sum("late_days"), F.sum("late_known")).alias("avg_delay_days"),
    ).select(*kpi_columns())


def kpi_columns() -> list[str | Column]:
    """The strip's columns from its sums."""
    return [
        "gmv",
        "n_orders",
        "n_customers",
        rate(F.col("gmv"), F.greatest(F.col("n_orders"), F.lit(1))).alias("avg_order"),
        "evaluable_orders",
        "delayed_orders",
        rate(F.col("delayed_orders"), F.col("evaluable_orders")).alias("delayed_rate"),
        "repeat_rate",
        "avg_delay_days",
    ]


def kpi_severity(
    kpi: DataFrame,
    on_time_bands: tuple[float, float] = (0.85, 0.70),
    repeat_bands: tuple[float, float] = (0.50, 0.30),
) -> DataFrame:
    return kpi.select(
        severity(1 - F.col("delayed_rate"), *on_time_bands).alias("delayed_class"),
        severity(F.col("repeat_rate"), *repeat_bands).alias("repeat_class"),
    )


def labelled_money(df: DataFrame, amount: str) -> DataFrame:
    """Add the display text of a money column."""
    return df.withColumn("label", money_label(F.col(amount)))


# trends ------------------------------------------------------------------------------


def _by_month(df: DataFrame, value: Column) -> DataFrame:
    return (
        df.filter(F.col("order_month").isNotNull())
        .groupBy(F.col("order_month").alias("month"))
        .agg(value.alias("value"))
        .orderBy("month")
    )


def trend_gmv(lines: DataFrame) -> DataFrame:
    return _by_month(lines, F.sum("gmv_line"))


def trend_orders(lines: DataFrame) -> DataFrame:
    return _by_month(lines.select("order_id", "order_month").distinct(), F.count("order_id"))


def trend_delayed_rate(lines: DataFrame) -> DataFrame:
    orders = _evaluable(lines, "order_month")
    return _by_month(orders, rate(count_where(F.col("delayed")), F.count(F.lit(1))))


def trend_repeat_share(lines: DataFrame) -> DataFrame:
    """Share of a month's customers who placed at least two orders in it, whatever became of them."""
    per_customer = (
        lines.filter(F.col("customer_id").isNotNull())
        .select("order_id", "order_month", "customer_id")
        .distinct()
        .groupBy("order_month", "customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _by_month(per_customer, rate(count_where(F.col("n") >= 2), F.count(F.lit(1))))


# breakdowns --------------------------------------------------------------------------


def breakdown_gmv(
    lines: DataFrame, dimensions: Sequence[str] = ("city", "category", "segment")
) -> DataFrame:
    """GMV per value of each dimension."""
    return roll_up_dimensions(
        lines.select(*dimensions, F.col("gmv_line").alias("gmv")), dimensions, ["gmv"]
    )


def breakdown_delay(
    lines: DataFrame, dimensions: Sequence[str] = ("carrier", "ship_to_city")
) -> DataFrame:
    """Evaluable orders, delay rate and colour band per value of each dimension."""
    orders = _evaluable(lines, *dimensions).select(
        *dimensions,
        F.lit(1).alias("orders"),
        F.when(F.col("delayed"), 1).otherwise(0).alias("delayed"),
    )
    counts = roll_up_dimensions(orders, dimensions, ["orders", "delayed"])
    delayed_rate = rate(F.col("delayed"), F.col("orders"))
    return counts.select(
        "dimension",
        "value",
        "orders",
        delayed_rate.alias("delayed_rate"),
        delay_band(delayed_rate).alias("band"),
    )


def outcome_rates(
    orders: DataFrame, dimensions: Sequence[str] = ("carrier", "city")
) -> DataFrame:
    """Cancellation, return and delay rate overall and per value of each dimension.

    Takes order rows (`features.order_facts`), not lines.
    """
    counts = roll_up_dimensions(
        orders.select(
            F.lit("all").alias("overall"),
            *dimensions,
            F.lit(1).alias("orders"),
            *[
                F.when(condition, 1).otherwise(0).alias(name)
                for name, condition in {
                    "cancelled": F.col("status") == "Cancelled",
                    "returned": F.col("status") == "Returned",
                    "evaluable": F.col("is_delayed").isNotNull(),
                    "delayed": F.col("is_delayed"),
                }.items()
            ],
        ),
        ["overall", *dimensions],
        ["orders", "cancelled", "returned", "evaluable", "delayed"],
    )
    return counts.select(
        "dimension",
        "value",
        "orders",
        rate(F.col("cancelled"), F.col("orders")).alias("cancelled_rate"),
        rate(F.col("returned"), F.col("orders")).alias("returned_rate"),
        rate(F.col("delayed"), F.col("evaluable")).alias("delayed_rate"),
    )


# lanes -------------------------------------------------------------------------------


def lane_grid(lines: DataFrame) -> DataFrame:
    """Evaluable orders and delay rate per carrier and destination."""
    return (
        _evaluable(lines, *LANE)
        .filter(all_present(LANE))
        .groupBy(*LANE)
        .agg(*_orders_and_rate())
    )


def lane_grid_pivot(lines: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """The grid with one row per carrier: rates null and orders 0 where there is no volume.

    Without a list the cities are those of the grid; a list must name all of them.
    """
    grid = cells(lane_grid(lines))
    cities = domain(grid, "ship_to_city", cities)
    wide = (
        grid.groupBy("carrier")
        .pivot("ship_to_city", cities)
        .agg(F.max("delayed_rate").alias("rate"), F.max("orders").alias("orders"))
    )
    # Names in back quotes: a dot in a city is no field access.
    orders = [F.coalesce(F.col(f"`{c}_orders`"), F.lit(0)).alias(f"{c}_orders") for c in cities]
    rates = [F.col(f"`{c}_rate`") for c in cities]
    return wide.select("carrier", *[column for pair in zip(rates, orders) for column in pair])


def worst_lanes(lines: DataFrame, min_orders: int = 100, k: int = 10) -> DataFrame:
    return worst_of(lane_grid(lines), min_orders, k)


def worst_of(grid: DataFrame, min_orders: int = 100, k: int = 10) -> DataFrame:
    """The lanes of a grid with the highest delay rates among those with volume."""
    return (
        grid.filter(F.col("orders") >= min_orders)
        .orderBy(F.desc("delayed_rate"), *LANE)
        .limit(k)
        .select(
            "*",
            F.concat_ws(" -> ", *LANE).alias("label"),
            delay_band(F.col("delayed_rate")).alias("band"),
        )
    )


# mixes -------------------------------------------------------------------------------


def category_contribution(lines: DataFrame) -> DataFrame:
    """GMV, orders, delay rate and GMV share per category.

    An order counts in every category it has a line of.
    """
    known = F.col("evaluable_delivery")
    per_category = (
        order_level(lines, "category", "delivery_status", "evaluable_delivery")
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.sum("gmv").alias("gmv"),
            F.count(F.lit(1)).alias("orders"),
            rate(
                count_where(known & not_on_time(F.col("delivery_status"))), count_where(known)
            ).alias("delayed_rate"),
        )
    )
    return with_share(per_category)


def with_share(per_category: DataFrame) -> DataFrame:
    # One row per category.
    everything = Window.partitionBy()
    return per_category.withColumn("share", rate(F.col("gmv"), F.sum("gmv").over(everything)))


def order_outcome_mix(lines: DataFrame) -> DataFrame:
    """Orders and share per outcome, in reporting order."""
    outcome = order_outcome(F.col("status"), F.col("delivery_status"))
    counts = (
        lines.select("order_id", "status", "delivery_status")
        .distinct()
        .groupBy(outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return outcome_shares(counts)


def outcome_shares(counts: DataFrame) -> DataFrame:
    """Position and share of the reported outcomes, from orders per outcome."""
    names = F.array(*[F.lit(name) for name in OUTCOMES])
    # At most one row per outcome.
    return counts.filter(F.col("outcome").isin(*OUTCOMES)).select(
        F.array_position(names, F.col("outcome")).cast("int").alias("position"),
        "outcome",
        "orders",
        rate(F.col("orders"), F.sum("orders").over(Window.partitionBy())).alias("share"),
    ).orderBy("position")


# read-outs ---------------------------------------------------------------------------


def readout_carrier_gap(lines: DataFrame) -> DataFrame:
    """Best and worst carrier and how far apart they are; empty with fewer than two."""
    carriers = (
        _evaluable(lines, "carrier")
        .filter(F.col("carrier").isNotNull())
        .groupBy("carrier")
        .agg(*_orders_and_rate())
    )
    return carrier_gap(carriers)


def carrier_gap(carriers: DataFrame) -> DataFrame:
    """Best and worst of carriers with their orders and delay rates."""
    row = F.struct("delayed_rate", "carrier", "orders")
    ends = carriers.agg(
        F.min(row).alias("best"), F.max(row).alias("worst"), F.count(F.lit(1)).alias("n")
    )
    return ends.filter(F.col("n") >= 2).select(
        *[
            F.col(f"{end}.{field}").alias(f"{end}_{field}")
            for end in ("best", "worst")
            for field in ("carrier", "delayed_rate", "orders")
        ],
        (
            F.col("worst.delayed_rate") / F.greatest(F.col("best.delayed_rate"), F.lit(1e-9))
        ).alias("multiple"),
    )


def readout_broken_lane(lines: DataFrame, min_orders: int = 200) -> DataFrame:
    """The lane with the worst rate among those with volume, against the market rate.

    The market rate covers the whole slice, small lanes included.
    """
    lanes = (
        _evaluable(lines, *LANE)
        .groupBy(*LANE)
        .agg(F.count(F.lit(1)).alias("orders"), count_where(F.col("delayed")).alias("delayed"))
    )
    return broken_lane(lanes, min_orders)


def broken_lane(lanes: DataFrame, min_orders: int = 200) -> DataFrame:
    """The worst of lanes with their evaluable and delayed orders, against all of them."""
    lane_rate = rate(F.col("delayed"), F.col("orders"))
    candidate = F.when(
        (F.col("orders") >= min_orders) & all_present(LANE),
        F.struct((-lane_rate).alias("order_key"), *LANE, "orders", lane_rate.alias("delayed_rate")),
    )
    worst = lanes.agg(
        F.min(candidate).alias("lane"),
        rate(F.sum("delayed"), F.sum("orders")).alias("market_rate"),
    )
    return worst.filter(F.col("lane").isNotNull()).select(
        *[f"lane.{c}" for c in (*LANE, "orders", "delayed_rate")],
        "market_rate",
        (F.col("lane.delayed_rate") / F.greatest(F.col("market_rate"), F.lit(1e-9))).alias(
            "times_market"
        ),
    )


def readout_top_category(lines: DataFrame) -> DataFrame:
    """The category with most GMV and its share; empty with fewer than two categories."""
    categories = (
        lines.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("gmv_line").alias("gmv"))
    )
    return top_category(categories)


def top_category(categories: DataFrame) -> DataFrame:
    """The first of categories by GMV."""
    top = categories.agg(
        F.min(F.struct((-F.col("gmv")).alias("order_key"), "category", "gmv")).alias("top"),
        F.sum("gmv").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    return top.filter(F.col("n") >= 2).select(
        "top.category", rate(F.col("top.gmv"), F.col("total")).alias("share")
    )
