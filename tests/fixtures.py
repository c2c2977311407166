"""Small hand-built marketplaces: only the columns a test is about are spelled out."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from lanewise import Marketplace
from lanewise.schemas import TABLES


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


DEFAULTS = {
    "customers": dict(city="Pune", state="MH", segment="Retail", signup_date=day("2024-01-01")),
    "sellers": {},
    "products": dict(category="Books"),
    "orders": dict(
        customer_id=1,
        created_at=ts("2024-07-01 10:00:00"),
        promised_delivery_date=day("2024-07-05"),
        status="Delivered",
        payment_method="UPI",
        is_fast_delivery_eligible=False,
    ),
    "order_items": dict(
        product_id=1,
        seller_id=1,
        quantity=1,
        unit_price=Decimal("100.00"),
        discount_pct=Decimal("0.10"),
        platform_fee_pct=Decimal("0.05"),
    ),
    "shipments": dict(
        carrier="CarrierA",
        shipped_at=ts("2024-07-02 10:00:00"),
        delivered_at=ts("2024-07-04 10:00:00"),
        ship_from_city="Delhi",
        ship_to_city="Pune",
        shipping_cost=Decimal("40.00"),
        delivery_status="OnTime",
    ),
}


def table(spark, name, rows):
    schema = TABLES[name]
    filled = [DEFAULTS[name] | row for row in rows]
    return spark.createDataFrame(
        [tuple(row.get(c) for c in schema.names) for row in filled], schema
    )


def market(spark, orders=(), items=(), shipments=(), customers=None, products=None):
    """Customers and products default to those the orders and items mention."""
    if customers is None:
        ids = {row.get("customer_id", 1) for row in orders} or {1}
        customers = [dict(customer_id=i) for i in sorted(ids)]
    if products is None:
        ids = {row.get("product_id", 1) for row in items} or {1}
        products = [dict(product_id=i) for i in sorted(ids)]
    sellers = sorted({row.get("seller_id", 1) for row in items} or {1})
    numbered = [dict(order_item_id=i) | row for i, row in enumerate(items, 1)]
    shipped = [dict(shipment_id=row["order_id"]) | row for row in shipments]
    return Marketplace(
        customers=table(spark, "customers", customers),
        sellers=table(spark, "sellers", [dict(seller_id=i) for i in sellers]),
        products=table(spark, "products", products),
        orders=table(spark, "orders", list(orders)),
        order_items=table(spark, "order_items", numbered),
        shipments=table(spark, "shipments", shipped),
    )


def rows(df):
    return [row.asDict() for row in df.collect()]


def only(df):
    (row,) = rows(df)
    return row
