"""Seller, carrier and destination performance, and the late-order listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import (
    all_present,
    count_where,
    days_between,
    is_delayed,
    is_evaluable,
    not_on_time,
    rate,
)

COMBO = ("seller_id", "carrier", "ship_to_city")
LANE = ("carrier", "ship_to_city")


def seller_orders(items: DataFrame) -> DataFrame:
    """`(order, seller, seller_gmv)`: the seller's share of each order."""
    return items.groupBy("order_id", "seller_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("seller_gmv")
    )


def delivered_orders(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Delivered shipments with their lane and whole days against the promise."""
    return (
        shipments.filter(F.col("delivered_at").isNotNull())
        .select("order_id", *LANE, "delivery_status", "delivered_at")
        .join(orders.select("order_id", "promised_delivery_date"), "order_id")
        .select(
            "order_id",
            *LANE,
            not_on_time(F.col("delivery_status")).alias("late"),
            days_between(F.col("delivered_at"), F.col("promised_delivery_date")).alias("days"),
        )
    )


def _late_sums() -> list[Column]:
    """Rows, late rows, and the days of the late rows where they are known."""
    late_days = F.when(F.col("late"), F.col("days"))
    return [
        F.count(F.lit(1)).alias("delivered_orders"),
        count_where(F.col("late")).alias("late"),
        F.coalesce(F.sum(late_days), F.lit(0)).alias("late_days"),
        F.count(late_days).alias("late_known"),
    ]


def _lateness() -> list[Column]:
    """Share of late rows, and mean days of the late rows, from those sums."""
    return [
        F.round(rate(F.col("late"), F.col("delivered_orders")), 4).alias("delayed_order_rate"),
        F.round(rate(F.col("late_days"), F.col("late_known")), 2).alias("avg_delay_days"),
    ]


def b3_sums(orders: DataFrame, items: DataFrame, shipments: DataFrame) -> DataFrame:
    """The sums behind the combinations; those of disjoint sets of orders add up."""
    return b3_sums_of(seller_orders(items), delivered_orders(orders, shipments))


def b3_sums_of(sellers: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same from the sellers' shares of the orders and the delivered shipments."""
    gmv = F.col("seller_gmv")
    return (
        sellers.join(delivered, "order_id")
        .groupBy(*COMBO)
        .agg(
            *_late_sums(),
            F.sum(gmv).alias("total_gmv"),
            F.sum(F.when(F.col("late"), gmv).otherwise(F.lit(0))).alias("delayed_gmv"),
        )
    )


def b3_of_sums(sums: DataFrame, min_orders: int = 100) -> DataFrame:
    return (
        sums.filter(F.col("delivered_orders") >= min_orders)
        .select(
            *COMBO,
            "delivered_orders",
            F.round("total_gmv", 2).alias("total_gmv"),
            F.round("delayed_gmv", 2).alias("delayed_gmv"),
            *_lateness(),
        )
        .orderBy(F.desc("delayed_gmv"), *COMBO)
    )


def b3_seller_carrier_city(
    orders: DataFrame, items: DataFrame, shipments: DataFrame, min_orders: int = 100
) -> DataFrame:
    """Delivered orders, GMV share, delayed GMV, delay rate per seller, carrier and city."""
    return b3_of_sums(b3_sums(orders, items, shipments), min_orders)


def b3_top_share(b3: DataFrame, k: int = 20) -> DataFrame:
    """Share of all flagged delayed GMV that the `k` worst combinations hold."""
    total = b3.agg(F.sum("delayed_gmv").alias("all")).scalar()
    worst = b3.orderBy(F.desc("delayed_gmv"), *COMBO).limit(k)
    return worst.agg(
        F.count(F.lit(1)).alias("top_combos"), F.sum("delayed_gmv").alias("top_delayed_gmv")
    ).select(
        "top_combos",
        "top_delayed_gmv",
        total.alias("total_delayed_gmv"),
        rate(F.col("top_delayed_gmv"), total).alias("top_share"),
    )


def combo_density(orders: DataFrame, items: DataFrame, shipments: DataFrame) -> DataFrame:
    """How thinly delivered orders spread over the seller, carrier, city combinations."""
    lanes = (
        shipments.filter(F.col("delivered_at").isNotNull())
        .select("order_id", *LANE)
        .join(orders.select("order_id"), "order_id", "left_semi")
    )
    return (
        items.select("order_id", "seller_id")
        .distinct()
        .join(lanes, "order_id")
        .groupBy(*COMBO)
        .agg(F.count(F.lit(1)).alias("orders"))
        .agg(
            F.max("orders").alias("max_orders"),
            rate(F.sum("orders"), F.count(F.lit(1))).alias("avg_orders"),
            F.count(F.lit(1)).alias("combinations"),
        )
    )


def lane_sums(orders: DataFrame, items: DataFrame, shipments: DataFrame) -> DataFrame:
    """The sums behind the lanes' performance; those of disjoint sets of orders add up."""
    gmv = items.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("gmv")
    )
    return lane_sums_of(delivered_orders(orders, shipments).join(gmv, "order_id", "left"))


def lane_sums_of(delivered: DataFrame) -> DataFrame:
    """The same from the delivered shipments with the `gmv` of their orders."""
    return delivered.groupBy(*LANE).agg(
        *_late_sums(),
        F.coalesce(F.sum("gmv"), F.lit(0)).alias("total_gmv"),
        F.count("gmv").alias("gmv_known"),
    )


def lanes_of_sums(sums: DataFrame) -> DataFrame:
    gmv = F.when(F.col("gmv_known") > 0, F.col("total_gmv"))
    return sums.select(
        *LANE, "delivered_orders", F.round(gmv, 2).alias("total_gmv"), *_lateness()
    ).orderBy(F.desc("delayed_order_rate"), *LANE)


def lane_performance(orders: DataFrame, items: DataFrame, shipments: DataFrame) -> DataFrame:
    """Delivered orders, GMV and delay per carrier and destination."""
    return lanes_of_sums(lane_sums(orders, items, shipments))


def lane_seller_mix(items: DataFrame, shipments: DataFrame) -> DataFrame:
    """Delay rate per seller within each lane, over orders with a known outcome."""
    delayed = is_delayed(F.col("delivery_status"))
    known = shipments.filter(delayed.isNotNull()).select(
        "order_id", *LANE, delayed.alias("delayed")
    )
    return (
        items.select("order_id", "seller_id")
        .distinct()
        .join(known, "order_id")
        .filter(all_present(COMBO))
        .groupBy(*LANE, "seller_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            count_where(F.col("delayed")).alias("delayed"),
        )
        .withColumn("delayed_rate", rate(F.col("delayed"), F.col("orders")))
    )


# late orders -------------------------------------------------------------------------


def b4_late_orders(
    orders: DataFrame, customers: DataFrame, shipments: DataFrame, evaluable_only: bool = False
) -> DataFrame:
    """Orders whose shipment is not on time, with the city.

    Shipments in transit are listed too, unless only known outcomes are asked for.
    """
    late = shipments.filter(not_on_time(F.col("delivery_status")))
    if evaluable_only:
        late = late.filter(is_evaluable(F.col("delivery_status")))
    return (
        orders.select("order_id", "customer_id", "created_at")
        .join(late.select("order_id", "delivered_at"), "order_id")
        .join(customers.select("customer_id", "city"), "customer_id")
        .select("order_id", "delivered_at", "created_at", "city")
    )


def b4_late_orders_correlated(
    orders: DataFrame, customers: DataFrame, shipments: DataFrame
) -> DataFrame:
    """The same listing in its original form: a scalar lookup and an existence test per order.

    Both subqueries are stated as the joins they amount to: the lookup is a left join to
    one value per order, the test a semi join.
    """
    lookup = shipments.groupBy("order_id").agg(F.max("delivered_at").alias("delivered_at"))
    some_late = shipments.filter(not_on_time(F.col("delivery_status"))).select("order_id")
    return (
        orders.select("order_id", "customer_id", "created_at")
        .join(some_late, "order_id", "left_semi")
        .join(lookup, "order_id", "left")
        .join(customers.select("customer_id", "city"), "customer_id")
        .select("order_id", "delivered_at", "created_at", "city")
    )


def b4_equivalence(rewrite: DataFrame, original: DataFrame) -> DataFrame:
    """Rows that only one of the two forms returns; both counts must be 0.

    Each row counts +1 from one side and -1 from the other, so a single aggregation by row
    compares the two multisets.
    """
    columns = rewrite.columns
    signed = rewrite.withColumn("side", F.lit(1)).unionByName(
        original.withColumn("side", F.lit(-1))
    )
    surplus = signed.groupBy(*columns).agg(F.sum("side").alias("surplus"))
    totals = surplus.agg(
        F.coalesce(F.sum(F.greatest(F.col("surplus"), F.lit(0))), F.lit(0)).alias("only_rewrite"),
        F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).alias("only_original"),
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("side"), F.col(c).cast("long").alias("n"))
                    for c in ("only_rewrite", "only_original")
                ]
            )
        )
    )
