"""Key, coverage and time-order checks on the source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import count_where


def _orphans(check: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` whose key is not in `parent`.

    Rows are counted per key before the join and the parent's keys are made distinct, so a
    key that fills much of either table enters the join as one row.
    """
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_key.join(parent.select(key).distinct(), key, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
        .select(F.lit(check).alias("check_name"), "n")
    )


def integrity_fk_orphans(
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    order_items: DataFrame,
    shipments: DataFrame,
) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            _orphans("orders without customer", orders, customers, "customer_id"),
            _orphans("items without order", order_items, orders, "order_id"),
            _orphans("items without product", order_items, products, "product_id"),
            _orphans("items without seller", order_items, sellers, "seller_id"),
            _orphans("shipments without order", shipments, orders, "order_id"),
            _orphans("orders missing a shipment", orders, shipments, "order_id"),
            _orphans("orders missing items", orders, order_items, "order_id"),
        ],
    )


def integrity_unshipped_by_status(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    return (
        orders.join(shipments.select("order_id").distinct(), "order_id", "left_anti")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def integrity_time_order(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """created <= shipped <= delivered over the delivered shipments."""
    return (
        shipments.filter(F.col("delivered_at").isNotNull())
        .join(orders.select("order_id", "created_at"), "order_id", "left")
        .agg(
            count_where(F.col("shipped_at") < F.col("created_at")).alias("shipped_before_created"),
            count_where(F.col("delivered_at") < F.col("shipped_at")).alias(
                "delivered_before_shipped"
            ),
            F.count(F.lit(1)).alias("delivered_rows"),
        )
    )


def integrity_shipments_per_order(shipments: DataFrame) -> DataFrame:
    """How many orders have how many shipments; a sound table has the row 1 only."""
    return (
        shipments.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n_shipments"))
        .groupBy("n_shipments")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
