"""Slice cube: bitmaps of orders per dimension value, and money per cell.

Orders get dense numbers, customer by customer. For every value of every dimension a bitmap
per 32,768 numbers tells which orders have it, so that a slice is an OR over the values of
each filter and an AND over the filters, whatever the number of lines. An order is counted
once, also where several of its lines match, and a customer is a run of neighbouring numbers.
Money adds up over lines, so it is kept per month and per day in cells of the filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.columns import ARRIVED, not_on_time, order_outcome
from lanewise.functions.reshape import roll_up_dimensions
from lanewise.operators.features import LINE_ORDER_COLUMNS

#: Orders in one bitmap: what the bitmap functions hold in their 4,096 bytes.
BUCKET_BITS = 15
#: Lines that one task groups to orders, about.
LINES_AT_ONCE = 250_000
FILTERS = ("city", "category", "carrier")
CELL = (*FILTERS, "segment")
#: Order columns with one bitmap per value. Lanes have two values.
VALUES = ("order_month", "day", "city", "carrier", "ship_to_city", "outcome", "late_days")
KEY = ("dimension", "value", "value2")
#: Equal on all lines of an order.
ORDER_COLUMNS = (*LINE_ORDER_COLUMNS, "evaluable_delivery")
BY_CUSTOMER = ("customer_id", "order_id")


# building ----------------------------------------------------------------------------


def cube_lines(lines: DataFrame) -> DataFrame:
    """The columns of the lines that the cube is built from. To be stored next."""
    return lines.select(*ORDER_COLUMNS, "category", "gmv_line")


def line_tasks(n_lines: int) -> int:
    """Ranges to cut the lines into, so that a task groups few enough to do it in memory."""
    return max(1, n_lines // LINES_AT_ONCE)


def order_profiles(lines: DataFrame, tasks: int) -> DataFrame:
    """One row per order with the columns that reports filter, group or count by, and its
    categories, in partitions that are ranges of customer and order."""
    late = F.col("evaluable_delivery") & not_on_time(F.col("delivery_status"))
    # Grouping on more columns keeps to this exchange, and so does the order of `in_order`.
    ranged = lines.where(F.col("order_id").isNotNull()).repartitionByRange(tasks, *BY_CUSTOMER)
    # Distinct rows first; a struct keeps a null among the categories.
    orders = ranged.select(*ORDER_COLUMNS, "category").distinct().groupBy(*ORDER_COLUMNS)
    return orders.agg(F.collect_list(F.struct("category")).alias("categories")).select(
        "order_id",
        "customer_id",
        "order_month",
        F.to_date("created_at").cast("string").alias("day"),
        "city",
        "carrier",
        "ship_to_city",
        order_outcome(F.col("status"), F.col("delivery_status")).alias("outcome"),
        F.when(late, F.col("delivery_delay_days")).cast("string").alias("late_days"),
        F.col("evaluable_delivery").alias("evaluable"),
        F.coalesce(late, F.lit(False)).alias("delayed"),
        F.coalesce(F.col("delivery_status").isin(*ARRIVED), F.lit(False)).alias("arrived"),
        F.col("customer_id").isNotNull().alias("known"),
        "categories",
    )


def in_order(profiles: DataFrame) -> DataFrame:
    """The profiles by customer, with each row's place in its partition. To be stored next."""
    return profiles.sortWithinPartitions(*BY_CUSTOMER).select(
        "*", F.monotonically_increasing_id().alias("at")
    )


def number_orders(placed: DataFrame) -> DataFrame:
    """Stored rows of `in_order` with a dense number, split into `bucket` and `bit`."""
    part = F.shiftright("at", 33).alias("part")
    # One row per partition of the range exchange.
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(sizes), "part")
        .withColumn("number", number)
        .select(
            *[c for c in placed.columns if c != "at"],
            F.shiftright("number", BUCKET_BITS).alias("bucket"),
            F.col("number").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bit"),
        )
    )


def bucket_tasks(n_orders: int) -> int:
    """Tasks to deal the buckets to, so that each gets about two however many there are."""
    return max(1, n_orders >> BUCKET_BITS + 1)


def dimension_bitmaps(orders: DataFrame, tasks: int) -> DataFrame:
    """`dimension, value, value2, bucket, bits`: the orders of each value, nulls being a value.

    An order has one value of each dimension but the category, where it has those of its lines.
    Bitmaps are built from rows that lie together by bucket: every bitmap in one task, which
    sorts the rows of a few buckets, and none is moved.
    """

    def entry(dimension: str, value: Column, value2: Column) -> Column:
        columns = F.lit(dimension), value.cast("string"), value2.cast("string")
        return F.struct(*[c.alias(name) for c, name in zip(columns, KEY)])

    nothing = F.lit(None)
    entries = [entry(c, F.col(c), nothing) for c in VALUES]
    entries.append(entry("lane", F.col("carrier"), F.col("ship_to_city")))
    categories = F.transform("categories", lambda c: entry("category", c["category"], nothing))
    dealt = orders.select("bucket", "bit", *VALUES, "categories").repartition(tasks, "bucket")
    rows = dealt.select("bucket", "bit", F.inline(F.concat(F.array(*entries), categories)))
    rows = rows.where("dimension <> 'late_days' OR value IS NOT NULL")
    bitmaps = rows.groupBy(*KEY, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # As the aggregate leaves them: readers skip the pages of other dimensions and values.
    return bitmaps.sortWithinPartitions(*KEY, "bucket")


def order_bitmaps(orders: DataFrame, tasks: int) -> DataFrame:
    """Per bucket the bitmaps of all orders, of their flags and of each customer's first order,
    and how many customers begin in earlier buckets."""

    def bits(condition: str) -> Column:
        return F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE {condition})").alias(condition)

    names = "evaluable", "delayed", "arrived", "known"
    dealt = orders.select("bucket", "bit", *names).repartition(tasks, "bucket")
    flags = dealt.groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("orders"),
        *[bits(c) for c in names],
    )
    number = F.shiftleft("bucket", BUCKET_BITS) + F.col("bit")
    first = orders.groupBy("customer_id").agg(F.min(number).alias("first")).select(
        F.shiftright("first", BUCKET_BITS).alias("bucket"),
        F.col("first").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("bit"),
    )
    starts = first.repartition(tasks, "bucket").groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("starts"), F.count(F.lit(1)).alias("n")
    )
    # One row per bucket.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(bytearray(1 << BUCKET_BITS - 3))
    return flags.join(starts, "bucket", "left").select(
        *flags.columns,
        F.coalesce("starts", none).alias("starts"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("customers_before"),
    )


def money_cells(lines: DataFrame) -> DataFrame:
    """GMV per day and cell; the monthly cells are sums of these."""
    day = F.to_date("created_at").alias("day")
    return lines.groupBy("order_month", day, *CELL).agg(F.sum("gmv_line").alias("gmv"))


def monthly(cells: DataFrame) -> DataFrame:
    return cells.groupBy("order_month", *CELL).agg(F.sum("gmv").alias("gmv"))


# bit operations ----------------------------------------------------------------------


def common_counts(rows: DataFrame) -> DataFrame:
    """Per row of `KEY, bits, slice, evaluable, delayed` how many bits the value has in common
    with the slice, and with its flags. Spark has AND as an aggregate only.

    Functions that run on executors are defined inside, so that these need not have the package.
    """
    key, names = KEY, ("bits", "slice", "evaluable", "delayed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = [b"".join(batch.column(c).to_pylist()) for c in names]
            bits, chosen, *flags = [
                np.frombuffer(b, np.uint64).reshape(batch.num_rows, -1) for b in joined
            ]
            common = bits & chosen
            counts = [
                pa.array(np.bitwise_count(words).sum(axis=1, dtype=np.int64))
                for words in (common, *[common & flag for flag in flags])
            ]
            columns = [*[batch.column(c) for c in key], *counts]
            yield pa.RecordBatch.from_arrays(columns, [*key, "orders", "evaluable", "delayed"])

    schema = ", ".join(f"{c} string" for c in KEY) + ", orders long, evaluable long, delayed long"
    return rows.select(*KEY, *names).mapInArrow(run, schema)


def customers_in(groups: DataFrame) -> DataFrame:
    """`group, customers, repeated`: customers with an order, and with at least two, per group.

    Takes `group, all_of, starts, customers_before`; a group's orders are those in each bitmap
    of the array `all_of`. Customers within a bucket are counted there; the first and the last
    may go on in other buckets and are summed over them.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda b: np.unpackbits(b, bitorder="little")
        words = lambda b: np.frombuffer(b, np.uint8)
        for batch in batches:
            out = []
            for group, bits, starts, before in zip(*[c.to_pylist() for c in batch.columns]):
                first = np.flatnonzero(unpack(words(starts)))
                goes_on = not len(first) or first[0] > 0
                first = np.concatenate(([0], first)) if goes_on else first
                orders = unpack(reduce(np.bitwise_and, map(words, bits)))
                found = np.add.reduceat(orders, first, dtype=np.int64)
                number = before - goes_on
                edges = {number: found[0], number + len(found) - 1: found[-1]}
                inner = found[1:-1]
                out.append((group, None, 0, int((inner >= 1).sum()), int((inner >= 2).sum())))
                out += [(group, customer, int(n), 0, 0) for customer, n in edges.items() if n]
            columns = list(zip(*out)) or [()] * 5
            types = [pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["group", "customer", "n", "one", "two"])

    schema = "group string, customer long, n long, one long, two long"
    found = groups.select("group", "all_of", "starts", "customers_before").mapInArrow(runs, schema)
    merged = found.groupBy("group", "customer").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    return merged.groupBy("group").agg(
        F.sum(F.col("one") + (F.col("n") >= 1).cast("int")).alias("customers"),
        F.sum(F.col("two") + (F.col("n") >= 2).cast("int")).alias("repeated"),
    )


# slicing -----------------------------------------------------------------------------


def _edge_months(date_from: dt.date | None, date_to: dt.date | None) -> list[str]:
    """Months of which the range covers a part only, at most two."""
    edges = set()
    if date_from is not None and date_from.day > 1:
        edges.add(f"{date_from:%Y-%m}")
    if date_to is not None and (date_to + dt.timedelta(days=1)).day > 1:
        edges.add(f"{date_to:%Y-%m}")
    return sorted(edges)


def _between(column: Column, low: str | None, high: str | None) -> Column:
    kept = column.isNotNull()
    if low is not None:
        kept = kept & (column >= F.lit(low))
    return kept if high is None else kept & (column <= F.lit(high))


def _date_conditions(date_from: dt.date | None, date_to: dt.date | None) -> tuple[Column, Column]:
    """Which whole months a range covers (on `order_month`), and which days beside (on `day`)."""
    edges = _edge_months(date_from, date_to)
    ends = (date_from, date_to)
    month, day = F.col("order_month"), F.col("day").cast("string")
    months = _between(month, *[d and f"{d:%Y-%m}" for d in ends])
    days = _between(day, *[d and d.isoformat() for d in ends])
    if not edges:
        return months, F.lit(False)
    return months & ~month.isin(edges), days & F.substring(day, 1, 7).isin(edges)


def slice_bitmaps(
    bitmaps: DataFrame,
    flags: DataFrame,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    cities: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    carriers: Sequence[str] | None = None,
) -> DataFrame:
    """Per bucket the bitmap `slice` of the slice's orders, and those of all orders' flags.

    Filters are those of `slices.slice_lines`. An order is in when one of its lines is: all
    filters but the category ask for the order's own values.
    """
    value, parts = F.col("value"), [flags.select("bucket", F.col("orders").alias("bits"))]

    def any_of(condition: Column) -> None:
        kept = bitmaps.where(condition)
        parts.append(kept.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    if date_from is not None or date_to is not None:
        edges = _edge_months(date_from, date_to)
        ends = (date_from, date_to)
        month = _between(value, *[d and f"{d:%Y-%m}" for d in ends]) & ~value.isin(edges)
        day = _between(value, *[d and d.isoformat() for d in ends])
        day = day & F.substring(value, 1, 7).isin(edges)
        any_of(
            ((F.col("dimension") == "order_month") & month) | ((F.col("dimension") == "day") & day)
            if edges
            else (F.col("dimension") == "order_month") & month
        )
    for dimension, listed in zip(FILTERS, (cities, categories, carriers)):
        if listed is not None:
            inside = value.isin(*listed)
            if dimension == "carrier":
                inside = inside | value.isNull()
            any_of((F.col("dimension") == dimension) & inside)
    kept = parts[0]
    if len(parts) > 1:
        all_parts = reduce(DataFrame.unionByName, parts).groupBy("bucket")
        # A bucket that a filter does not reach holds nothing of the slice.
        kept = all_parts.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
        kept = kept.where(F.col("n") == len(parts))
    return kept.select("bucket", F.col("bits").alias("slice")).join(flags, "bucket")


def slice_counts(bitmaps: DataFrame, chosen: DataFrame) -> DataFrame:
    """`dimension, value, value2, orders, evaluable, delayed`: the slice's orders per value.

    The dimension `all` has the slice as a whole.
    """
    columns = "bucket", "slice", "evaluable", "delayed"
    per_value = bitmaps.where("dimension NOT IN ('day', 'city')").join(chosen.select(*columns), "bucket")
    nothing = F.lit(None).cast("string")
    whole = chosen.select(*columns, F.lit("all").alias("dimension"), F.col("orders").alias("bits"))
    whole = whole.withColumns({"value": nothing, "value2": nothing})
    rows = per_value.select(*KEY, "bits", *columns[1:]).unionByName(whole.drop("bucket"))
    counts = "orders", "evaluable", "delayed"
    return common_counts(rows).groupBy(*KEY).agg(*[F.sum(name).alias(name) for name in counts])


def slice_customers(bitmaps: DataFrame, chosen: DataFrame) -> DataFrame:
    """`group, customers, repeated` of the slice (`all`), of its arrived orders (`arrived`),
    and of every month's orders (the month)."""
    starts = "starts", "customers_before"

    def group(frame: DataFrame, name: Column, *bits: str) -> DataFrame:
        return frame.select(name.alias("group"), F.array("slice", "known", *bits).alias("all_of"), *starts)

    months = bitmaps.where("dimension = 'order_month' AND value IS NOT NULL")
    by_month = chosen.join(months.select("bucket", "value", "bits"), "bucket")
    return customers_in(
        group(by_month, F.col("value"), "bits")
        .unionByName(group(chosen, F.lit("all")))
        .unionByName(group(chosen, F.lit("arrived"), "arrived"))
    )


def slice_money(
    months: DataFrame,
    days: DataFrame,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    cities: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    carriers: Sequence[str] | None = None,
) -> DataFrame:
    """`dimension, value, gmv` for the month, the cell's dimensions and all (`total`).

    Whole months come from the monthly cells, only those at the ends of the range from days.
    """
    cells = months
    if date_from is not None or date_to is not None:
        whole, beside = _date_conditions(date_from, date_to)
        cells = months.where(whole)
        if _edge_months(date_from, date_to):
            cells = cells.unionByName(days.where(beside).drop("day"))
    for dimension, listed in zip(FILTERS, (cities, categories, carriers)):
        if listed is not None:
            inside = F.col(dimension).isin(*listed)
            cells = cells.where(inside | F.col(dimension).isNull() if dimension == "carrier" else inside)
    dimensions = ["order_month", "city", "category", "segment", "total"]
    return roll_up_dimensions(cells.withColumn("total", F.lit("all")), dimensions, ["gmv"])
