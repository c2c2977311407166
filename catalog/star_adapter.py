"""The test star schema (customer, orders, lineitem, ...) as the six marketplace tables.

The star schema has no carriers, promises, delivery times or statuses. They are derived
from the keys by integer arithmetic, the same way in `oracle.py`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import Marketplace

# Declared, so that opening a table does not run a job to read file footers.
STAR_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}

URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
PROMISE_DAYS = f"CASE WHEN {URGENT} THEN 4 ELSE 6 END"
STATUS = """
    CASE WHEN o_orderkey % 101 < 8 THEN 'Cancelled'
         WHEN o_orderkey % 101 < 13 THEN 'Shipped'
         WHEN o_orderkey % 101 < 18 THEN 'Returned'
         ELSE 'Delivered' END
"""
# Days against the promise; null when lost or still under way. Two lanes are planted bad.
DELAY = """
    CASE WHEN status = 'Shipped' OR r = 102 THEN NULL
         WHEN k = 0 AND nk IN (3, 7) THEN
              CASE WHEN r < 14 THEN -1 - r % 3 WHEN r < 60 THEN r % 2
                   WHEN r < 96 THEN 2 + r % 3 ELSE 5 END
         WHEN k = 3 THEN CASE WHEN r < 95 THEN -1 - r % 3 ELSE r % 2 END
         ELSE CASE WHEN r < 72 THEN -1 - r % 3 WHEN r < 96 THEN r % 2
                   WHEN r < 101 THEN 2 + r % 3 ELSE 5 END
    END
"""
CARRIERS = ("CarrierA", "CarrierB", "CarrierC", "InHouse")
CITIES = tuple(f"NATION_{i}" for i in range(25))
BROKEN_LANES = [("CarrierA", "NATION_3"), ("CarrierA", "NATION_7")]


def _customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("c_mktsegment").alias("segment"),
            F.expr("date_add(DATE '1995-01-01', CAST(c_custkey % 365 AS INT))").alias(
                "signup_date"
            ),
        )
    )


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
        F.expr(f"date_add(CAST(o_orderdate AS DATE), {PROMISE_DAYS})").alias(
            "promised_delivery_date"
        ),
        F.expr(STATUS).alias("status"),
        F.expr(
            "CASE o_orderkey % 3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Card' ELSE 'COD' END"
        ).alias("payment_method"),
        F.expr(URGENT).alias("is_fast_delivery_eligible"),
    )


def _order_items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount_pct"),
        F.col("l_tax").cast("decimal(4,2)").alias("platform_fee_pct"),
    )


def _shipments(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    origin = nation.select(
        F.col("n_nationkey").alias("origin_key"), F.col("n_name").alias("ship_from_city")
    )
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_nationkey").alias("nk"), F.col("n_name").alias("ship_to_city")
    )
    shipped = orders.withColumn("status", F.expr(STATUS)).filter("status <> 'Cancelled'")
    return (
        shipped.join(home, F.col("o_custkey") == F.col("c_custkey"))
        .join(origin, F.expr("(o_orderkey * 7) % 25 = origin_key"))
        .withColumns({"r": F.expr("o_orderkey % 103"), "k": F.expr("o_orderkey % 4")})
        .withColumn("delay", F.expr(DELAY))
        .select(
            F.col("o_orderkey").alias("shipment_id"),
            F.col("o_orderkey").alias("order_id"),
            F.element_at(F.array(*map(F.lit, CARRIERS)), (F.col("k") + 1).cast("int")).alias(
                "carrier"
            ),
            F.expr("o_orderdate + INTERVAL 12 HOURS").alias("shipped_at"),
            F.expr(
                f"o_orderdate + make_dt_interval(CAST(({PROMISE_DAYS}) + delay AS INT),"
                " CAST(12 + o_orderkey % 12 AS INT))"
            ).alias("delivered_at"),
            "ship_from_city",
            "ship_to_city",
            F.expr("CAST(40 + o_orderkey % 60 AS DECIMAL(8,2))").alias("shipping_cost"),
            F.expr(
                """CASE WHEN status = 'Shipped' THEN 'InTransit' WHEN delay IS NULL THEN 'Lost'
                        WHEN delay <= -1 THEN 'OnTime' WHEN delay <= 1 THEN 'Late_1_2d'
                        WHEN delay <= 4 THEN 'Late_3_5d' ELSE 'Late_5p' END"""
            ).alias("delivery_status"),
        )
    )


def star_market(spark: SparkSession, sf_dir: str) -> Marketplace:
    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    customer, nation, orders = table("customer"), table("nation"), table("orders")
    part = table("part")
    return Marketplace(
        customers=_customers(customer, nation, table("region")),
        sellers=table("supplier").select(F.col("s_suppkey").alias("seller_id")),
        products=part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category")
        ),
        orders=_orders(orders),
        order_items=_order_items(table("lineitem"), part),
        shipments=_shipments(orders, customer, nation),
    )


#: Orders placed from this day on, about one in a hundred, were in another state before.
CHANGED_SINCE = "2001-07-15"


def earlier_market(market: Marketplace) -> tuple[Marketplace, DataFrame]:
    """The six tables as they were before the last orders changed, and these orders' ids.

    A fifth of them had not been placed, the others were under way, some had other quantities,
    and some orders were there that have been removed since (with negative ids).
    """
    recent = F.col("created_at") >= F.lit(CHANGED_SINCE).cast("timestamp_ntz")
    placed, removed = F.col("order_id") % 5 > 0, F.col("order_id") % 7 == 3
    ids = market.orders.where(recent).select("order_id")
    known = ids.distinct().withColumn("is_last", F.lit(True))
    under_way = F.when(F.col("status").isin("Delivered", "Returned"), "Shipped").otherwise(F.col("status"))
    gone = market.orders.join(ids, "order_id", "left_semi").where(removed).select(market.orders.columns)
    there = market.orders.where(~recent | (recent & placed))
    orders = there.withColumn("status", F.when(recent, under_way).otherwise(F.col("status"))).unionByName(
        gone.withColumn("order_id", -F.col("order_id"))
    )

    def earlier(df: DataFrame, key: str, before: dict[str, Column]) -> DataFrame:
        """One pass: a row stays, is as it was before, has a negative copy, both, or is left out."""
        is_last, negative = F.col("is_last").isNotNull(), F.col("negative")
        copies = (
            F.when(~is_last | (placed & ~removed), F.array(F.lit(False)))
            .when(placed, F.array(F.lit(False), F.lit(True)))
            .when(removed, F.array(F.lit(True)))
        )
        columns = {c: F.col(c) for c in df.columns}
        columns |= {c: F.when(is_last & ~negative, was).otherwise(F.col(c)) for c, was in before.items()}
        columns |= {c: F.when(negative, -F.col(c)).otherwise(F.col(c)) for c in ("order_id", key)}
        copied = df.join(known, "order_id", "left").select("*", F.explode(copies).alias("negative"))
        return copied.select([column.alias(c) for c, column in columns.items()])

    quantity = (F.col("quantity") + (F.col("order_id") % 4 == 1).cast("int")).cast("int")
    nothing = {
        "delivered_at": F.lit(None).cast("timestamp_ntz"),
        "delivery_status": F.lit("InTransit"),
    }
    tables = {
        "orders": orders,
        "order_items": earlier(market.order_items, "order_item_id", {"quantity": quantity}),
        "shipments": earlier(market.shipments, "shipment_id", nothing),
    }
    changed = ids.union(ids.where(removed).select(-F.col("order_id")))
    return replace(market, **tables), changed
