"""Feature marts: item, shipment, order, first-order and line tables, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.columns import (
    count_where,
    days_between,
    is_delayed,
    is_evaluable,
    line_gmv,
    month_text,
)
from lanewise.functions.reshape import value_with_text

CUSTOMER_COLUMNS = ("customer_id", "city", "state", "segment", "signup_date")
SHIPMENT_COLUMNS = (
    "order_id",
    "carrier",
    "shipped_at",
    "delivered_at",
    "ship_from_city",
    "ship_to_city",
    "shipping_cost",
    "delivery_status",
)
SHIPMENT_FEATURES = ("delivery_delay_days", "is_delayed", "lane", "delivered_month")
# The published line mart has these item columns, in this order.
LINE_ITEM_COLUMNS = (
    "order_id",
    "product_id",
    "seller_id",
    "quantity",
    "unit_price",
    "gmv_line",
)
# The published line mart has these order columns, in this order.
LINE_ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "created_at",
    "order_month",
    "city",
    "segment",
    "carrier",
    "ship_to_city",
    "delivery_status",
    "is_delayed",
    "delivery_delay_days",
    "status",
)


def items_enriched(order_items: DataFrame) -> DataFrame:
    gmv = line_gmv()
    return order_items.select(
        "*",
        gmv.alias("gmv_line"),
        (gmv * (1 - F.col("discount_pct"))).alias("gmv_after_disc"),
        (gmv * F.col("platform_fee_pct")).alias("platform_fee"),
    )


def _with_shipment_features(df: DataFrame) -> DataFrame:
    """Add the shipment features to rows that hold the shipment and the promised date."""
    return df.withColumns(
        {
            "delivery_delay_days": days_between(
                F.col("delivered_at"), F.col("promised_delivery_date")
            ),
            "is_delayed": is_delayed(F.col("delivery_status")),
            "lane": F.concat(F.col("ship_from_city"), F.lit(" -> "), F.col("ship_to_city")),
            "delivered_month": month_text(F.col("delivered_at")),
        }
    )


def shipments_enriched(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    promised = orders.select("order_id", "promised_delivery_date")
    return _with_shipment_features(shipments.join(promised, "order_id", "left")).select(
        *shipments.columns, *SHIPMENT_FEATURES
    )


def order_seller_rollup(items: DataFrame) -> DataFrame:
    """Items summed to (order, seller).

    Shared by the order roll-up, where it makes the distinct seller count a plain count,
    and by the seller reports. An order with very many lines shrinks to its sellers here,
    before anything is joined on the order.
    """
    return items.groupBy("order_id", "seller_id").agg(
        F.sum("gmv_line").alias("seller_gmv"),
        F.sum("gmv_after_disc").alias("seller_gmv_after_disc"),
        F.sum("platform_fee").alias("seller_platform_fee"),
        F.count("order_item_id").alias("seller_items"),
        F.sum("quantity").alias("seller_units"),
    )


def order_rollup(items: DataFrame) -> DataFrame:
    """Six per-order aggregates of the enriched items."""
    return (
        order_seller_rollup(items)
        .filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.sum("seller_gmv").alias("order_gmv"),
            F.sum("seller_gmv_after_disc").alias("order_gmv_after_disc"),
            F.sum("seller_platform_fee").alias("order_platform_fee"),
            F.sum("seller_items").alias("order_items_count"),
            F.sum("seller_units").alias("order_units"),
            F.count("seller_id").alias("order_sellers_count"),
        )
    )


def order_rollup_of(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """The same aggregates where the (order, seller) pairs are at hand already.

    Items are summed to orders at once, in place where an order's items are stored together.
    """
    known = F.col("order_id").isNotNull()

    def money(column: str) -> Column:
        kind = items.schema[column].dataType
        # As wide as a sum of sums.
        return F.sum(column).cast(T.DecimalType(min(kind.precision + 20, 38), kind.scale))

    sums = items.where(known).groupBy("order_id").agg(
        money("gmv_line").alias("order_gmv"),
        money("gmv_after_disc").alias("order_gmv_after_disc"),
        money("platform_fee").alias("order_platform_fee"),
        F.count("order_item_id").alias("order_items_count"),
        F.sum("quantity").alias("order_units"),
    )
    counts = sellers.where(known).groupBy("order_id").agg(F.count("seller_id").alias("order_sellers_count"))
    return sums.join(counts, "order_id")


def order_gmv(order_items: DataFrame) -> DataFrame:
    """GMV per order only, for reports that need nothing else from the items."""
    return order_items.groupBy("order_id").agg(F.sum(line_gmv()).alias("order_gmv"))


def order_facts(orders: DataFrame, customers: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders with customer and shipment columns; everything of `orders_enriched` but the items.

    The customer join comes first: the rows are still narrow then, and the shuffle that
    follows is the one on the order key that all later joins share.
    """
    joined = orders.join(customers.select(*CUSTOMER_COLUMNS), "customer_id", "left").join(
        shipments.select(*SHIPMENT_COLUMNS), "order_id", "left"
    )
    return _with_shipment_features(joined).select(
        *orders.columns,
        *CUSTOMER_COLUMNS[1:],
        *SHIPMENT_COLUMNS[1:],
        *SHIPMENT_FEATURES,
        month_text(F.col("created_at")).alias("order_month"),
        days_between(F.col("promised_delivery_date"), F.col("created_at")).alias("promised_days"),
    )


def orders_enriched(facts: DataFrame, rollup: DataFrame) -> DataFrame:
    """The order-wide mart. Orders without items keep null item columns."""
    return facts.join(rollup, "order_id", "left")


def orders_with_gmv(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders and their GMV, the narrow form of the mart for time and money reports."""
    return orders.join(order_gmv(order_items), "order_id", "left")


def with_delivery(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders and the delivery columns of their shipment."""
    return orders.join(
        shipments.select(
            "order_id",
            "delivered_at",
            "delivery_status",
            is_delayed(F.col("delivery_status")).alias("is_delayed"),
        ),
        "order_id",
        "left",
    )


def with_city(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the customer's city and the order month."""
    return orders.join(customers.select("customer_id", "city"), "customer_id", "left").withColumn(
        "order_month", month_text(F.col("created_at"))
    )


def customer_first_order(orders: DataFrame) -> DataFrame:
    """First delivered order per customer and whether it was late.

    The rank filter is applied per map task before the shuffle, so a customer with very
    many orders sends one row per task. Equal delivery times are settled by order id.
    """
    by_delivery = Window.partitionBy("customer_id").orderBy("delivered_at", "order_id")
    delayed = F.col("is_delayed")
    return (
        orders.filter(F.col("delivered_at").isNotNull() & F.col("customer_id").isNotNull())
        .select("customer_id", "order_id", "delivered_at", "delivery_status", "is_delayed")
        .withColumn("rn", F.row_number().over(by_delivery))
        .filter(F.col("rn") == 1)
        .select(
            "customer_id",
            F.col("order_id").alias("first_order_id"),
            F.col("delivered_at").alias("first_delivered_at"),
            F.col("delivery_status").alias("first_delivery_status"),
            delayed.alias("first_is_delayed"),
            F.when(delayed, F.lit("Delayed"))
            .when(~delayed, F.lit("OnTime"))
            .otherwise(F.lit("Unknown"))
            .alias("first_order_delay_status"),
        )
    )


def dashboard_lines(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """One denormalised row per order item for the slice reports.

    The join on the order also compares a hash of it. That changes no match, but gives both
    sides a shuffle of their own where `orders` is itself the outcome of joins on the order,
    and only then can the runtime split the partition of an order with very many lines.
    """
    joined_on = ["order_id", "order_hash"]
    order_hash = F.hash("order_id").alias("order_hash")
    return (
        items.select(*LINE_ITEM_COLUMNS)
        .join(products.select("product_id", "category"), "product_id", "left")
        .select("*", order_hash)
        .join(orders.select(*LINE_ORDER_COLUMNS, order_hash), joined_on, "left")
        .select(
            *LINE_ITEM_COLUMNS,
            "category",
            *LINE_ORDER_COLUMNS[1:],
            is_evaluable(F.col("delivery_status")).alias("evaluable_delivery"),
        )
    )


# audits ------------------------------------------------------------------------------


def status_by_delayed(shipments: DataFrame) -> DataFrame:
    return (
        shipments.select("delivery_status", is_delayed(F.col("delivery_status")).alias("is_delayed"))
        .groupBy("delivery_status", "is_delayed")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def status_by_has_shipment(orders: DataFrame) -> DataFrame:
    """Order status against the absence of a shipment status."""
    return (
        orders.select("status", F.col("delivery_status").isNull().alias("no_shipment"))
        .groupBy("status", "no_shipment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def promised_days_by_fast(orders: DataFrame, k: int | None = None) -> DataFrame:
    """Promise lengths per fast-delivery flag by frequency; with `k` only the first rows."""
    counts = (
        orders.select(
            "is_fast_delivery_eligible",
            days_between(F.col("promised_delivery_date"), F.col("created_at")).alias(
                "promised_days"
            ),
        )
        .groupBy("is_fast_delivery_eligible", "promised_days")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("is_fast_delivery_eligible", F.desc("n"), "promised_days")
    )
    return counts if k is None else counts.limit(k)


def features_null_audit(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(F.col("order_gmv").isNull()).alias("null_order_gmv"),
        count_where(F.col("delivery_status").isNull()).alias("null_delivery_status"),
    )


def first_order_status_counts(first_orders: DataFrame) -> DataFrame:
    return (
        first_orders.select(
            value_with_text(
                ["first_order_delay_status", "first_delivery_status"], "column_name", "value"
            )
        )
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def order_status_totals(orders: DataFrame) -> DataFrame:
    """Orders by status, customers with a delivery, and GMV, as one row.

    Orders are counted per customer first; the number of customers is then a plain count.
    """
    per_customer = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        *[
            count_where(F.col("status") == status).alias(status.lower())
            for status in ("Delivered", "Returned", "Shipped", "Cancelled")
        ],
        F.count("delivered_at").alias("deliveries"),
        F.sum("order_gmv").alias("gmv"),
    )
    return per_customer.agg(
        *[
            F.sum(c).alias(c) for c in ("orders", "delivered", "returned", "shipped", "cancelled")
        ],
        count_where((F.col("deliveries") > 0) & F.col("customer_id").isNotNull()).alias(
            "customers_with_delivery"
        ),
        F.sum("gmv").alias("gmv"),
    )
