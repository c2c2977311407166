"""Reports of the slice cube against the same reports from lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise.operators import cube, slices
from lanewise.plans.cube import SliceCube, cube_dashboard
from lanewise.plans.dashboard import reports
from lanewise.schemas import PROMISE_SUMMARY
from lanewise.sources.marts import shared_folder, write_mart
from tests.fixtures import rows

FILTERS = [
    {},
    dict(
        date_from=dt.date(2024, 1, 11),
        date_to=dt.date(2024, 4, 20),
        cities=["C0", "C2", "C3"],
        categories=["k1", "k.2"],
        carriers=["A", "B"],
    ),
    dict(date_from=dt.date(2024, 2, 3), date_to=dt.date(2024, 2, 20)),
    dict(date_to=dt.date(2024, 1, 31), categories=["k1"]),
    dict(cities=["nowhere"]),
]


@pytest.fixture(scope="module")
def lines(spark):
    """70,000 orders, of which one customer has 40,000; nulls in every column that may have them."""
    status = F.element_at(
        F.array(*map(F.lit, ("OnTime", "Late_1_2d", "Lost", "InTransit", "Late_5p"))), (F.col("o") % 5 + 1).cast("int")
    )
    shipped = F.col("o") % 11 > 0
    orders = spark.range(70_000).select(
        F.col("id").alias("o"),
        F.when(F.col("id") < 40_000, F.lit(7)).when(F.col("id") % 13 > 0, F.col("id") % 9_000).alias("customer_id"),
        F.when(
            F.col("id") % 17 > 0,
            F.expr("timestamp_ntz '2023-12-20 08:00:00' + make_dt_interval(cast(id % 150 AS INT), 0, 0, 0)"),
        ).alias("created_at"),
    )
    delivery = F.when(shipped, status)
    with_orders = orders.select(
        F.col("o").alias("order_id"),
        "customer_id",
        "created_at",
        F.date_format("created_at", "yyyy-MM").alias("order_month"),
        F.when(F.col("o") % 19 > 0, F.concat(F.lit("C"), F.col("o") % 4)).alias("city"),
        F.concat(F.lit("s"), F.col("o") % 3).alias("segment"),
        F.when(shipped, F.substring(F.lit("ABC"), (F.col("o") % 3 + 1).cast("int"), F.lit(1))).alias("carrier"),
        F.when(shipped, F.concat(F.lit("T"), F.col("o") % 5)).alias("ship_to_city"),
        delivery.alias("delivery_status"),
        F.when(delivery.isin("Late_1_2d", "Late_5p"), (F.col("o") % 7).cast("int")).alias("delivery_delay_days"),
        F.when(F.col("o") % 23 == 0, "Cancelled").otherwise("Delivered").alias("status"),
        F.coalesce(delivery != "InTransit", F.lit(False)).alias("evaluable_delivery"),
        (delivery != "OnTime").alias("is_delayed"),
        F.explode(F.sequence(F.lit(0), F.col("o") % 3)).alias("line"),
    )
    return with_orders.select(
        "*",
        F.element_at(F.array(F.lit("k1"), F.lit("k.2"), F.lit("k3"), F.lit(None)), ((F.col("order_id") + F.col("line")) % 4 + 1).cast("int")).alias("category"),
        (F.col("order_id") % 90 + F.col("line") + F.lit("0.25").cast("decimal(4,2)")).cast("decimal(12,2)").alias("gmv_line"),
    ).drop("line")


@pytest.fixture(scope="module")
def published(spark, lines, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("cube"))
    SliceCube.publish(lines, out)
    return SliceCube.read(spark, out)


def plain(report):
    return sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in (row[c] for c in sorted(report.columns)))
        for row in report.na.fill({c: "-" for c, t in report.dtypes if t == "string"}).collect()
    )


@pytest.mark.parametrize("filters", FILTERS)
def test_cube_gives_the_reports_of_the_lines(spark, lines, published, filters):
    flags = spark.createDataFrame([], PROMISE_SUMMARY)
    part = slices.slice_lines(lines, **filters).persist()
    wanted = reports(part, slices.order_lines(part), flags)
    with cube_dashboard(published, flags, **filters) as got:
        assert set(got) == set(wanted)
        for name in got:
            assert plain(got[name]) == plain(wanted[name]), name
    part.unpersist()


def test_bitmaps_hold_whole_customers_in_order(lines, published):
    """Numbers are dense, and the customer with most orders goes on over buckets."""
    buckets = sorted(rows(published.orders), key=lambda r: r["bucket"])
    n = 70_000
    full = [min(1 << 15, n - i * (1 << 15)) for i in range(len(buckets))]
    counted = published.orders.select("bucket", F.bitmap_count("orders").alias("n")).orderBy("bucket")
    assert [r["n"] for r in counted.collect()] == full
    starts = published.orders.agg(F.sum(F.bitmap_count("starts"))).first()[0]
    assert starts == lines.select("customer_id").distinct().count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_computed_once(spark, lines, tmp_path, monkeypatch):
    """Everything but the stored lines is built from tables that were stored before."""
    from lanewise.plans import cube as plan

    plans, write = {}, plan.write_mart

    def recorded(df, out_dir, name, *rest):
        plans[name] = plan_of(df)
        return write(df, out_dir, name, *rest)

    monkeypatch.setattr(plan, "write_mart", recorded)
    SliceCube.publish(lines.where("order_id < 3000"), str(tmp_path))
    assert {name for name, text in plans.items() if "Range (0, 70000" in text} == {"cube_lines"}


def test_bitmaps_are_built_where_their_orders_lie(spark, lines):
    """Orders are dealt by bucket, a few buckets to a task; no bitmap is moved, or merged with
    others of its bucket. Lines are grouped in as many tasks as their number asks for."""
    placed = cube.in_order(cube.order_profiles(lines.where("order_id < 3000"), 3))
    numbered = cube.number_orders(write_mart(placed, shared_folder(spark, "cube"), "placed"))
    plan = plan_of(cube.dimension_bitmaps(numbered, 2)).split("BroadcastExchange")[0]
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(bucket" in plan
    assert "rangepartitioning(customer_id" in plan_of(placed) and plan_of(placed).count("Exchange ") == 1
    assert cube.bucket_tasks(54_000_000) >= 54_000_000 / (1 << cube.BUCKET_BITS) / 2 - 1
    assert (cube.line_tasks(10), cube.line_tasks(216_000_000)) == (1, 864)


def test_ends_of_a_range():
    edges = cube._edge_months
    assert edges(dt.date(2024, 2, 1), dt.date(2024, 2, 29)) == []
    assert edges(dt.date(2024, 2, 2), dt.date(2024, 2, 28)) == ["2024-02"]
    assert edges(dt.date(2024, 1, 31), dt.date(2024, 3, 30)) == ["2024-01", "2024-03"]
    assert edges(None, None) == []


def test_days_are_read_for_the_ends_only(published):
    """Whole months come from monthly cells and bitmaps."""
    whole = dict(date_from=dt.date(2024, 1, 1), date_to=dt.date(2024, 3, 31))
    plan = cube.slice_money(published.months, published.days, **whole)._jdf.queryExecution().toString()
    assert "cube_days" not in plan
    ends = dict(date_from=dt.date(2024, 1, 2), date_to=dt.date(2024, 3, 31))
    plan = cube.slice_money(published.months, published.days, **ends)._jdf.queryExecution().toString()
    assert "cube_days" in plan
