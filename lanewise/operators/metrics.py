"""Monthly GMV, activity and repeat metrics, and delay rates by place, carrier and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.columns import (
    all_present,
    count_where,
    is_delayed,
    month_date,
    month_text,
    rate,
)
from lanewise.functions.reshape import cells as stored_cells
from lanewise.functions.reshape import domain

# GMV ---------------------------------------------------------------------------------


def gmv_month_city_category(
    items: DataFrame, orders: DataFrame, products: DataFrame
) -> DataFrame:
    """GMV per order month, customer city and product category."""
    keys = ["order_month", "city", "category"]
    return (
        items.select("order_id", "product_id", "gmv_line")
        .join(products.select("product_id", "category"), "product_id", "left")
        .join(orders.select("order_id", "city", "order_month"), "order_id", "left")
        .filter(all_present(keys))
        .groupBy(*keys)
        .agg(F.sum("gmv_line").alias("gmv"))
    )


def gmv_month_city(cells: DataFrame) -> DataFrame:
    return cells.groupBy("order_month", "city").agg(F.sum("gmv").alias("gmv"))


def gmv_month_category(cells: DataFrame) -> DataFrame:
    return cells.groupBy("order_month", "category").agg(F.sum("gmv").alias("gmv"))


def gmv_city_month_pivot(cells: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """City by month in millions, with the total of the rounded months.

    Without a list the months are those of the cells; a list must name all of them.
    """
    cells = stored_cells(cells)
    months = domain(cells, "order_month", months)
    in_millions = F.bround(F.col("gmv").cast("double") / 1e6, 2)
    # At most one row per month in a city.
    total = F.bround(F.sum("millions").over(Window.partitionBy("city")), 2)
    return (
        cells.select("city", "order_month", in_millions.alias("millions"))
        .withColumn("total", total)
        .groupBy("city", "total")
        .pivot("order_month", list(months))
        .agg(F.max("millions"))
        .select("city", *[F.col(f"`{month}`") for month in months], "total")
        .orderBy(F.desc("total"), "city")
    )


# activity and repeat -----------------------------------------------------------------


def customer_month_activity(orders: DataFrame) -> DataFrame:
    """Per customer and month: orders and GMV placed, and deliveries received so far.

    Input: `customer_id, created_at, delivered_at, order_gmv`, one row per order. An order
    counts in the month it was placed and its delivery in the month it arrived; both go
    through one aggregation. The running sum then sees at most one row per month for a
    customer, however many orders that customer has. Having two deliveries before the end
    of a month is the same as a running count of at least two at that month.
    """
    nothing = F.lit(None).cast(orders.schema["order_gmv"].dataType)
    placed = F.struct(
        month_date(F.col("created_at")).alias("month"),
        F.lit(1).alias("orders"),
        F.col("order_gmv").alias("gmv"),
        F.lit(0).alias("deliveries"),
    )
    arrived = F.struct(
        month_date(F.col("delivered_at")).alias("month"),
        F.lit(0).alias("orders"),
        nothing.alias("gmv"),
        F.lit(1).alias("deliveries"),
    )
    so_far = (
        Window.partitionBy("customer_id")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        orders.select("customer_id", F.inline(F.array(placed, arrived)))
        .filter(F.col("month").isNotNull())
        .groupBy("customer_id", "month")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("gmv").alias("gmv"),
            F.sum("deliveries").alias("deliveries"),
        )
        .withColumn("delivered_so_far", F.sum("deliveries").over(so_far))
        .filter(F.col("orders") > 0)
        .drop("deliveries")
    )


def fees_month_city(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items, GMV, GMV after discount and platform fee per order month and customer city."""
    return (
        items.select("order_id", "gmv_line", "gmv_after_disc", "platform_fee")
        .join(orders.select("order_id", "order_month", "city"), "order_id")
        .groupBy("order_month", "city")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum("gmv_line").alias("gmv"),
            F.sum("gmv_after_disc").alias("gmv_after_disc"),
            F.sum("platform_fee").alias("platform_fee"),
        )
    )


def orders_active_month(orders: DataFrame) -> DataFrame:
    """Orders, active customers, GMV and orders per customer by order month."""
    return (
        orders.select(month_text(F.col("created_at")).alias("order_month"), "customer_id", "order_gmv")
        .filter(F.col("order_month").isNotNull())
        .groupBy("order_month", "customer_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("order_gmv").alias("gmv"))
        .groupBy("order_month")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("customer_id").alias("active_customers"),
            F.coalesce(F.sum("gmv"), F.lit(0)).alias("gmv"),
        )
        .withColumn(
            "orders_per_customer", F.bround(rate(F.col("orders"), F.col("active_customers")), 3)
        )
    )


def repeat_rate_month(activity: DataFrame) -> DataFrame:
    """Customers active in a month, and how many of them had two deliveries by its end."""
    repeat = count_where((F.col("delivered_so_far") >= 2) & F.col("customer_id").isNotNull())
    return (
        activity.groupBy(F.date_format("month", "yyyy-MM").alias("order_month"))
        .agg(
            F.count("customer_id").alias("active_customers"),
            repeat.alias("repeat_customers_active"),
        )
        .withColumn(
            "repeat_rate",
            F.coalesce(
                F.bround(rate(F.col("repeat_customers_active"), F.col("active_customers")), 4),
                F.lit(0.0),
            ),
        )
    )


def b1_sums(activity: DataFrame, customers: DataFrame) -> DataFrame:
    """The sums behind the report; those of disjoint sets of customers add up.

    The city is joined to the customer-month rows, after the orders are summed up.
    """
    return (
        activity.join(customers.select("customer_id", "city"), "customer_id")
        .groupBy("month", "city")
        .agg(
            F.coalesce(F.sum("gmv"), F.lit(0)).alias("gmv"),
            F.count("gmv").alias("gmv_known"),
            F.sum("orders").alias("number_of_orders"),
            F.count(F.lit(1)).alias("unique_customers"),
            count_where(F.col("delivered_so_far") >= 2).alias("repeat_customers"),
        )
    )


def b1_of_sums(sums: DataFrame) -> DataFrame:
    return sums.select(
        "month",
        "city",
        F.round(F.when(F.col("gmv_known") > 0, F.col("gmv")), 2).alias("gmv"),
        "number_of_orders",
        "unique_customers",
        F.round(rate(F.col("repeat_customers"), F.col("unique_customers")), 4).alias(
            "repeat_purchase_rate"
        ),
    ).orderBy("month", "city")


def b1_city_month_metrics(activity: DataFrame, customers: DataFrame) -> DataFrame:
    """GMV, orders, customers and cumulative repeat rate per month and customer city."""
    return b1_of_sums(b1_sums(activity, customers))


def b1_month_totals(b1: DataFrame) -> DataFrame:
    return b1.groupBy("month").agg(
        F.sum("gmv").alias("gmv"),
        F.sum("number_of_orders").alias("orders"),
        F.sum("unique_customers").alias("customers"),
    )


# delay rates -------------------------------------------------------------------------


def delay_counts(shipments: DataFrame, *keys: str) -> DataFrame:
    """Evaluable shipments and delayed ones per key; only the shipment status is needed."""
    delayed = is_delayed(F.col("delivery_status"))
    return (
        shipments.filter(delayed.isNotNull() & all_present(keys))
        .groupBy(*keys)
        .agg(F.count("shipment_id").alias("shipments"), count_where(delayed).alias("delayed"))
    )


def delay_rates(shipments: DataFrame, *keys: str, digits: int | None = None) -> DataFrame:
    share = rate(F.col("delayed"), F.col("shipments"))
    return delay_counts(shipments, *keys).withColumn(
        "delayed_rate", share if digits is None else F.bround(share, digits)
    )


def delay_by_city(shipments: DataFrame) -> DataFrame:
    rates = delay_rates(shipments, "ship_to_city", digits=4)
    return rates.orderBy(F.desc("delayed_rate"), "ship_to_city")


def delay_by_carrier(shipments: DataFrame) -> DataFrame:
    rates = delay_rates(shipments, "carrier", digits=4)
    return rates.orderBy(F.desc("delayed_rate"), "carrier")


def delay_city_carrier(shipments: DataFrame) -> DataFrame:
    return delay_rates(shipments, "ship_to_city", "carrier")


def delay_city_carrier_pivot(
    shipments: DataFrame, carriers: Sequence[str] | None = None
) -> DataFrame:
    """Delay rate matrix, city by carrier; null where the carrier has no shipment.

    Without a list the carriers are those of the shipments; a list must name all of them.
    """
    rates = stored_cells(delay_rates(shipments, "ship_to_city", "carrier", digits=3))
    return (
        rates.groupBy("ship_to_city")
        .pivot("carrier", domain(rates, "carrier", carriers))
        .agg(F.max("delayed_rate"))
    )


def delay_trend_month(shipments: DataFrame) -> DataFrame:
    by_month = shipments.withColumn("shipped_month", month_text(F.col("shipped_at")))
    return delay_rates(by_month, "shipped_month")


def lane_month_stability(shipments: DataFrame) -> DataFrame:
    """Delay rate of every lane in every shipping month."""
    by_month = shipments.withColumn("shipped_month", month_text(F.col("shipped_at")))
    return delay_rates(by_month, "carrier", "ship_to_city", "shipped_month")


def lane_month_zscore(shipments: DataFrame) -> DataFrame:
    """How far a lane's delay rate of a month is from the lane's mean, in its deviations.

    Null for a lane with one month or without any spread. A lane has one row per month.
    """
    lane = Window.partitionBy("carrier", "ship_to_city")
    spread = F.stddev_samp("delayed_rate").over(lane)
    distance = F.col("delayed_rate") - F.avg("delayed_rate").over(lane)
    return lane_month_stability(shipments).withColumn(
        "zscore", F.round(F.when(spread > 0, distance / spread), 4)
    )


def shipments_per_day(shipments: DataFrame) -> DataFrame:
    """Shipments that each carrier sent off on each day."""
    day = F.to_date("shipped_at").alias("day")
    return shipments.groupBy("carrier", day).agg(F.count(F.lit(1)).alias("shipments"))


def carrier_load(shipments: DataFrame, days: int = 7) -> DataFrame:
    """Each carrier's load over the last days, and how much of it was late, for every day.

    Days without a shipment between a carrier's first and last are filled in. The frame is by
    time, not by rows, over one row per day and carrier.
    """
    delayed = is_delayed(F.col("delivery_status"))
    daily = (
        shipments.filter(F.col("shipped_at").isNotNull() & F.col("carrier").isNotNull())
        .groupBy("carrier", F.to_date("shipped_at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            count_where(delayed.isNotNull()).alias("known"),
            count_where(delayed).alias("late"),
        )
    )
    calendar = daily.groupBy("carrier").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = calendar.select("carrier", F.explode(F.sequence("first", "last")).alias("day"))
    filled = calendar.join(daily, ["carrier", "day"], "left").na.fill(0, ["shipments", "known", "late"])
    number = F.datediff("day", F.lit("1970-01-01"))
    lately = Window.partitionBy("carrier").orderBy(number).rangeBetween(1 - days, Window.currentRow)
    return filled.select(
        "carrier",
        "day",
        "shipments",
        F.sum("shipments").over(lately).alias("load"),
        rate(F.sum("late").over(lately), F.sum("known").over(lately)).alias("delayed_rate"),
    )


def lateness_mix(shipments: DataFrame) -> DataFrame:
    """How failed deliveries split over the lateness buckets, and their share of all known."""
    status = F.col("delivery_status")
    delayed = is_delayed(status)
    # One row per status from here on.
    counts = (
        shipments.filter(delayed.isNotNull())
        .groupBy("delivery_status")
        .agg(F.count(F.lit(1)).alias("shipments"))
        .withColumn("evaluable", F.sum("shipments").over(Window.partitionBy()))
        .filter(delayed)
        .withColumn("failed", F.sum("shipments").over(Window.partitionBy()))
    )
    return counts.select(
        "delivery_status",
        "shipments",
        rate(F.col("shipments"), F.col("failed")).alias("share_of_failures"),
        rate(F.col("shipments"), F.col("evaluable")).alias("share_of_evaluable"),
    )


def category_mix_month(cells: DataFrame) -> DataFrame:
    """Share of each category in the GMV of its month."""
    in_month = Window.partitionBy("order_month")
    return gmv_month_category(cells).withColumn(
        "share", rate(F.col("gmv"), F.sum("gmv").over(in_month))
    )
