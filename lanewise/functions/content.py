"""Order-free content hashes: equal for tables with the same rows, in any order and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of a row's md5 that are summed.
DIGITS = 15
MONEY_DIGITS, RATE_DIGITS = 4, 9
NULL = "~"
#: Below this a scaled amount is a whole number that a double holds to less than half.
EXACT = 10.0 ** (15 - MONEY_DIGITS)
#: A row's hash is summed in two halves of this many bits, each as a long.
HALF = 30


def value_text(column: Column, kind: T.DataType) -> Column:
    """A value as text that does not depend on the engine: scaled whole numbers, ISO times."""
    if isinstance(kind, T.DecimalType):
        scaled = F.round(column * F.lit(10**MONEY_DIGITS), 0).cast("decimal(38,0)").cast("string")
        if kind.scale <= MONEY_DIGITS:
            # The same digits; decimals are far slower to multiply.
            number = column.cast("double")
            quick = F.rint(number * F.lit(float(10**MONEY_DIGITS))).cast("long").cast("string")
            scaled = F.when(F.abs(number) < EXACT, quick).otherwise(scaled)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        scaled = F.round(column * F.lit(float(10**RATE_DIGITS))).cast("decimal(38,0)")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        scaled = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    else:
        scaled = column
    return F.coalesce(scaled.cast("string"), F.lit(NULL))


def row_hash(df: DataFrame, schema: T.StructType | None = None) -> Column:
    """A number per row, from its values in the order of the column names."""
    fields = sorted((schema or df.schema).fields, key=lambda f: f.name)
    text = F.concat_ws("|", *[value_text(df[f.name], f.dataType) for f in fields])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def hash_sum(hashes: Column) -> Column:
    """Sums of disjoint parts add up to that of the whole; repeated rows count."""
    high = F.sum(F.shiftright(hashes, HALF)).cast("decimal(28,0)")
    low = F.sum(hashes.bitwiseAND(F.lit(2**HALF - 1)))
    return F.coalesce(high * F.lit(2**HALF).cast("decimal(10,0)") + low, F.lit(0)).cast("decimal(38,0)")


def total(sums: Column) -> Column:
    """The sum of such sums."""
    return F.coalesce(F.sum(sums), F.lit(0)).cast("decimal(38,0)")
