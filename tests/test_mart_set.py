"""Mart sets: what readers see, refreshes against full publishes, content hashes."""

from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from catalog.star_adapter import earlier_market
from lanewise.functions.content import hash_sum, row_hash, value_text
from lanewise.operators import features
from lanewise.plans import publish
from lanewise.plans.mart_set import MartSet, MartSetWriter, PublishConflict
from lanewise.plans.publish import MARTS, publish_set, refresh_set
from tests.fixtures import day, market, only, rows, table, ts

LANES = [("CarrierA", "Pune")]


def order(i, customer=1, month=7, **more):
    return dict(order_id=i, customer_id=customer, created_at=ts(f"2024-{month:02}-01 10:00:00")) | more


def shipment(i, month=7, **more):
    return dict(order_id=i, delivered_at=ts(f"2024-{month:02}-04 10:00:00")) | more


@pytest.fixture(scope="module")
def before(spark):
    return market(
        spark,
        orders=[order(1), order(2, 2, 8), order(3, 2, 9), order(4, 3, 9), order(5, 4, 7), order(6, 1, 5)],
        items=[dict(order_id=i, seller_id=i % 2) for i in (1, 1, 2, 3, 5, 6, 9)],
        shipments=[shipment(1), shipment(2, 8, delivery_status="Late_3_5d"), shipment(3, 9), shipment(6, 5)],
        customers=[dict(customer_id=i) for i in range(1, 7)],
    )


@pytest.fixture(scope="module")
def after(spark, before):
    """Order 2 moves to another month and customer, 3 is late, 4 and its customer are gone, 5 loses
    its item, 9 is placed for items that were there, and 10 is a new customer's, not shipped."""
    orders = [order(1), order(2, 1, 6), order(3, 2, 9), order(5, 4, 7), order(6, 1, 5), order(9, 5, 9), order(10, 6, 10)]
    items = [dict(order_item_id=i, order_id=o, seller_id=o % 2) for i, o in enumerate((1, 1, 2, 3, 0, 6, 9, 10), 1) if o]
    shipments = [
        shipment(1),
        shipment(2, 6, carrier="CarrierB"),
        shipment(3, 9, delivery_status="Late_5p", delivered_at=ts("2024-09-20 10:00:00")),
        shipment(6, 5),
        shipment(9, 9, delivered_at=None, delivery_status="Lost"),
    ]
    return replace(
        before,
        orders=table(spark, "orders", orders),
        order_items=table(spark, "order_items", items),
        shipments=table(spark, "shipments", [dict(shipment_id=s["order_id"]) | s for s in shipments]),
    )


def hashes(published):
    return {r["name"]: (r["n_rows"], r["content_hash"]) for r in rows(published.listing())}


def test_refresh_and_readers(spark, before, after, tmp_path):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    first = publish_set(before, root, LANES, 1, 1)
    reader = MartSet.current(spark, root)
    assert reader.sequence == 1 and hashes(reader) == hashes(first)
    assert set(MARTS) <= set(hashes(reader))
    orders = sorted(map(str, reader.table("orders_enriched").collect()))

    # A publish that breaks off leaves nothing that a reader finds.
    broken = MartSetWriter(spark, root)
    broken.write("orders_enriched", before.orders.limit(1))
    assert MartSet.current(spark, root).sequence == 1

    changed = spark.createDataFrame([(i,) for i in (2, 3, 4, 5, 9, 10)], "order_id long")
    second = refresh_set(after, root, changed, LANES, 1, 1)
    full = publish_set(after, other, LANES, 1, 1)
    assert hashes(second) == hashes(full) != hashes(first)
    assert MartSet.current(spark, root).sequence == second.sequence == 2
    # The months of order 6 and of order 1 alone are as they were; the reader has its own set.
    kept = {e.part for e in second.entries_of("orders_enriched")} & {"2024-05"}
    assert kept and [e for e in second.entries_of("orders_enriched", kept)] == [
        e for e in first.entries_of("orders_enriched", kept)
    ]
    assert sorted(map(str, reader.table("orders_enriched").collect())) == orders
    assert "part" not in second.table("items_enriched").columns


def test_a_part_of_many_rows_is_split(spark, tmp_path):
    """Parts without columns to cluster by are dealt without a sample, a large one to several tasks."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64KB")
    try:
        out = MartSetWriter(spark, str(tmp_path))
        part = F.when(F.col("id") % 50 > 0, "2024-01").when(F.col("id") % 3 > 0, "2024-02")
        df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"), part.alias("part"))
        read = out.write("m", df.repartition(4))
    finally:
        spark.conf.set(name, before)
    assert {e.part: e.n_rows for e in out.entries} == {"2024-01": 196_000, "2024-02": 2_666, "none": 1_334}
    assert read.select("id").distinct().count() == 200_000
    files = read.select("_metadata.file_path").distinct()
    assert files.where(F.col("file_path").contains("2024-01")).count() > 2


def test_marts_are_built_from_those_written(spark, before, tmp_path, monkeypatch):
    plans, write = {}, publish.write_mart

    def recorded(df, out_dir, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, out_dir, name, *rest)

    monkeypatch.setattr(publish, "write_mart", recorded)
    publish.publish_marts(before, str(tmp_path), LANES, 1, 1)
    assert "Join" not in plans["q4_lane_scenarios"] + plans["q4_marketplace_summary"]
    # The source tables are rows of the test, and only marts are files.
    assert all("FileScan parquet" in plans[name] for name in ("b3_seller_carrier_city", "b3_lane_carrier_city"))


def test_two_publishes_of_one_number(spark, before, tmp_path):
    root = str(tmp_path)
    writers = [MartSetWriter(spark, root) for _ in range(2)]
    for i, writer in enumerate(writers):
        writer.write("m", spark.range(i + 1))
    first, second = sorted(writers, key=lambda w: w.folder)
    first.publish()
    with pytest.raises(PublishConflict):
        second.publish()
    assert MartSet.current(spark, root).entries == tuple(first.entries)
    with pytest.raises(ValueError, match="nothing is published"):
        MartSet.current(spark, str(tmp_path / "empty"))


def test_content_hash(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.5, day("2024-01-01"), None), (2, None, None, None, True), (2, None, None, None, True)],
        "i int, s string, x double, d date, b boolean",
    )
    hashed = lambda f: only(f.agg(hash_sum(row_hash(f)).alias("h")))["h"]
    assert hashed(df) == hashed(df.repartition(3)) == hashed(df.select("b", "d", "x", "s", "i"))
    assert hashed(df) != hashed(df.distinct())
    assert hashed(df.withColumn("s", F.coalesce("s", F.lit("")))) != hashed(df)
    assert hashed(df.limit(0)) == 0


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_earlier_tables_come_from_one_pass(spark):
    """Orders of the last days: 22 was under way, 24 had a copy too, 10 and 45 were only copies, 25 not there."""
    new, old = ts("2001-07-20 10:00:00"), ts("2001-07-01 10:00:00")
    orders = [dict(order_id=i, created_at=old if i == 3 else new) for i in (3, 22, 24, 25, 10, 45)]
    source = market(
        spark,
        orders=orders,
        items=[dict(order_id=i, quantity=2) for i in (3, 22, 24, 24, 25, 10, 45, 17)],
        shipments=[shipment(i) for i in (3, 22, 24, 10)],
    )
    nulls = table(spark, "order_items", [dict(order_item_id=0, order_id=17)]).withColumn("order_id", F.lit(None).cast("long"))
    source = replace(source, order_items=source.order_items.unionByName(nulls))
    earlier, changed = earlier_market(source)
    items = sorted((r["order_id"] or 0, r["order_item_id"], r["quantity"]) for r in rows(earlier.order_items))
    assert items == [
        (-45, -7, 2), (-24, -4, 2), (-24, -3, 2), (-10, -6, 2),
        (0, 0, 1), (3, 1, 2), (17, 8, 2), (22, 2, 2), (24, 3, 2), (24, 4, 2),
    ]
    assert sorted((r["order_id"], r["status"]) for r in rows(earlier.orders)) == [
        (-45, "Delivered"), (-24, "Delivered"), (-10, "Delivered"),
        (3, "Delivered"), (22, "Shipped"), (24, "Shipped"),
    ]
    ships = sorted((r["order_id"], r["shipment_id"], r["delivery_status"]) for r in rows(earlier.shipments))
    assert ships == [
        (-24, -24, "OnTime"), (-10, -10, "OnTime"), (3, 3, "OnTime"), (22, 22, "InTransit"), (24, 24, "InTransit"),
    ]
    assert sorted(r[0] for r in changed.collect()) == [-45, -24, -10, 10, 22, 24, 25, 45]
    # The tables themselves (items are two of the test's) and the last orders.
    assert [leaves(df) for df in (earlier.order_items, earlier.shipments)] == [3, 2]


def test_rollup_of_sellers_is_the_rollup(spark):
    kinds = "order_id long, seller_id long, order_item_id long, quantity int, gmv_line decimal(23,2), gmv_after_disc decimal(29,4), platform_fee decimal(28,4)"
    data = [(o, s, i, i % 3, Decimal(i), None if i % 4 else Decimal("0.5"), None) for i, (o, s) in enumerate(
        [(1, 1), (1, 1), (1, 2), (2, None), (2, None), (3, 1), (None, 1), (None, None), (3, None), (1, 1)])]
    items = spark.createDataFrame(data, kinds)
    sellers = items.groupBy("order_id", "seller_id").agg(F.sum("gmv_line").alias("seller_gmv"))
    was, now = features.order_rollup(items), features.order_rollup_of(items, sellers)
    assert [(f.name, f.dataType) for f in now.schema] == [(f.name, f.dataType) for f in was.schema]
    assert sorted(map(str, now.collect())) == sorted(map(str, was.collect()))


def test_sums_join_shipments_to_orders_once(spark, before, tmp_path, monkeypatch):
    plans, write = {}, MartSetWriter.write

    def recorded(self, name, df, *rest, **more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, name, df, *rest, **more)

    monkeypatch.setattr(MartSetWriter, "write", recorded)
    publish_set(before, str(tmp_path), LANES, 1, 1)
    assert not any("Join" in plans[name] for name in ("lane_sums", "scenario_sums"))
    # Amounts are worked out where the rows end up, and not carried there.
    assert "gmv_after_disc" not in plans["items_enriched"]


def test_amounts_as_text(spark):
    """Scaled whole numbers, whether or not a double can hold them."""
    for kind, texts in {
        "decimal(12,2)": ["0.00", "-0.01", "9999999999.99", "0.05"],
        "decimal(29,4)": ["99999999999.9999", "100000000000.0001", "-123456789012345678901.6789", "0.0003"],
        "decimal(20,6)": ["0.000050", "-0.000050", "12345678901234.123456"],
    }.items():
        df = spark.createDataFrame([(Decimal(t),) for t in texts] + [(None,)], f"x {kind}")
        found = [r[0] for r in df.select(value_text(df.x, df.schema["x"].dataType)).collect()]
        exact = [str(int((Decimal(t) * 10_000).quantize(Decimal(1), rounding=ROUND_HALF_UP))) for t in texts]
        assert found == [*exact, "~"]
