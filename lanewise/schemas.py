"""Declared schemas of the six source tables and the column checks built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
FRACTION = T.DecimalType(4, 2)


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*column) for column in columns])


CUSTOMERS = _table(
    ("customer_id", T.LongType(), False),
    ("city", T.StringType(), False),
    ("state", T.StringType(), False),
    ("segment", T.StringType(), False),
    ("signup_date", T.DateType(), False),
)
SELLERS = _table(("seller_id", T.LongType(), False))
PRODUCTS = _table(
    ("product_id", T.LongType(), False),
    ("category", T.StringType(), False),
)
ORDERS = _table(
    ("order_id", T.LongType(), False),
    ("customer_id", T.LongType(), False),
    ("created_at", T.TimestampNTZType(), False),
    ("promised_delivery_date", T.DateType(), False),
    ("status", T.StringType(), False),
    ("payment_method", T.StringType(), False),
    ("is_fast_delivery_eligible", T.BooleanType(), False),
)
ORDER_ITEMS = _table(
    ("order_item_id", T.LongType(), False),
    ("order_id", T.LongType(), False),
    ("product_id", T.LongType(), False),
    ("seller_id", T.LongType(), False),
    ("quantity", T.IntegerType(), False),
    ("unit_price", MONEY, False),
    ("discount_pct", FRACTION, False),
    ("platform_fee_pct", FRACTION, False),
)
SHIPMENTS = _table(
    ("shipment_id", T.LongType(), False),
    ("order_id", T.LongType(), False),
    ("carrier", T.StringType(), False),
    ("shipped_at", T.TimestampNTZType(), False),
    ("delivered_at", T.TimestampNTZType(), True),
    ("ship_from_city", T.StringType(), False),
    ("ship_to_city", T.StringType(), False),
    ("shipping_cost", T.DecimalType(8, 2), False),
    ("delivery_status", T.StringType(), False),
)

TABLES: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "shipments": SHIPMENTS,
}

PROMISE_SUMMARY = _table(
    ("scenario", T.StringType(), True),
    ("ontime_rate", T.DoubleType(), True),
    ("delayed_gmv", T.DecimalType(38, 2), True),
    ("delayed_gmv_vs_today", T.DecimalType(38, 2), True),
    ("ontime_rate_vs_today", T.DoubleType(), True),
)


#: Scale of decimals that come as text or floating point, which have no scale of their own.
READ_SCALE = 6


def read_as(raw: DataFrame, field: T.StructField, key_type: T.DataType | None = None) -> Column:
    """A source column in its declared type, without loss.

    Keys take `key_type`, or keep their own type if that is None. Decimals keep their own
    scale; from text or floating point they get READ_SCALE digits, and a value with more
    digits is an error.
    """
    column, found, wanted = raw[field.name], raw.schema[field.name].dataType, field.dataType
    if field.name.endswith("_id"):
        wanted = key_type or found
    elif isinstance(wanted, T.DecimalType):
        if isinstance(found, T.DecimalType):
            return column.alias(field.name)
        wide = T.DecimalType(wanted.precision - wanted.scale + READ_SCALE, READ_SCALE)
        exact = column if isinstance(found, T.NumericType) else column.cast("decimal(38,18)")
        lost = F.raise_error(
            F.concat(F.lit(f"{field.name}: more digits than can be kept: "), column.cast("string"))
        )
        same = column.isNull() | (column.cast(wide).cast(exact_type(found)) == exact)
        return F.when(same, column.cast(wide)).otherwise(lost.cast(wide)).alias(field.name)
    return column.cast(wanted).alias(field.name)


def checked(field: T.StructField, key_type: T.DataType) -> tuple[Column, Column]:
    """A text column in its declared type, null if that cannot be, and why not, else null."""
    text, wanted = F.col(f"`{field.name}`"), field.dataType
    if field.name.endswith("_id"):
        wanted = key_type
    digits = F.lit(False)
    if isinstance(wanted, T.DecimalType):
        wanted = T.DecimalType(wanted.precision - wanted.scale + READ_SCALE, READ_SCALE)
        fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), "0+$", "")
        digits = F.length(fraction) > READ_SCALE
    value = text.try_cast(wanted)
    problem = F.when(text.isNotNull() & value.isNull(), F.lit(f"{field.name}: no {wanted.simpleString()}"))
    problem = problem.when(digits, F.lit(f"{field.name}: more digits than can be kept"))
    if not field.nullable:
        problem = problem.when(text.isNull(), F.lit(f"{field.name}: empty"))
    return value, problem


def exact_type(found: T.DataType) -> T.DataType:
    """The type in which a decimal is compared with the value that it was read from."""
    return found if isinstance(found, T.NumericType) else T.DecimalType(38, 18)


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Return `df`, or raise with the missing column names."""
    missing = [column for column in columns if column not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df
