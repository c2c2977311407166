"""Interval join, grouped quantiles, table difference, top groups, sketches, buckets, rejects."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import grouped_quantiles as gq
from lanewise.operators import cohorts, intervals, metrics, sketches, table_diff, top_k
from lanewise.schemas import ORDER_ITEMS
from lanewise.sources import buckets
from lanewise.sources.buckets import BucketedMarts, buckets_for
from lanewise.sources.marts import shared_folder, size_on_storage, write_mart
from lanewise.sources.readers import read_csv_checked, reading_counts
from tests.fixtures import rows, ts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_before(spark):
    rng = random.Random(4)
    start = ts("2024-01-01 00:00:00")
    events = [(rng.choice([1, 1, 1, 2, 3, None]), start + dt.timedelta(hours=rng.randrange(0, 24 * 40, 6))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(events)), "id int, e struct<k: int, t: timestamp_ntz>").select("id", "e.k", "e.t")
    found = intervals.events_before(df, df, ["k"], "t", 7)
    got = sorted((r["id"], r["e_id"]) for r in found.collect())
    week = dt.timedelta(days=7)
    assert got == sorted(
        (i, j)
        for i, (k, t) in enumerate(events)
        for j, (k2, t2) in enumerate(events)
        if k is not None and k == k2 and t - week <= t2 < t
    )
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


@pytest.mark.parametrize("at_once", [50_000, 40])
def test_grouped_quantiles(spark, monkeypatch, at_once):
    """A group with a third of the rows, single values, ties and nulls, also through rounds."""
    monkeypatch.setattr(gq, "ORDERED_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    data = [("hot", float(v)) for v in rng.normal(size=4000)]
    data += [(f"g{i % 5}", float(v)) for i, v in enumerate(rng.integers(0, 6, 3000))]
    data += [(None, float(i)) for i in range(900)] + [("one", 3.0), ("none", None), ("g1", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    found = gq.grouped_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert len(found) == 5 * len(groups)
    for r in found:
        values = groups[r["k"]]
        assert r["n"] == len(values) and r["quantile"] == pytest.approx(np.quantile(values, r["p"]), abs=1e-12)


def test_three_rows_differ(spark):
    left = spark.range(40_000).selectExpr("id", "id % 7 AS a", "cast(id AS string) AS s").repartition(4)
    right = left.where("id <> 5").withColumn("a", F.when(F.col("id") == 77, 99).otherwise(F.col("a")))
    right = right.unionByName(left.where("id = 123"))
    found = sorted((r["side"], r["n"], r["id"]) for r in table_diff.table_diff(left, right, ["id"]).collect())
    assert found == [("only_left", 1, 5), ("only_left", 1, 77), ("only_right", 1, 77), ("only_right", 1, 123)]
    assert table_diff.table_diff(left, left.repartition(2), ["id"]).collect() == []
    folder = shared_folder(spark, "diff")
    digests = [
        write_mart(df.select(F.xxhash64("id").alias("_place"), table_diff.row_hash(df).alias("hash")), folder, str(i))
        for i, df in enumerate((left, right))
    ]
    level, ranges = table_diff.unequal_ranges(digests, folder)
    opened = ranges.agg(F.sum("rows")).first()[0]
    assert level > 1 and ranges.count() == 3 and opened < 400
    with pytest.raises(ValueError, match="columns differ"):
        table_diff.table_diff(left, right.drop("s"), ["id"])


@pytest.mark.parametrize("capacity", [5, 10_000])
def test_top_groups(spark, capacity):
    """Heavy groups among many light ones, ties, null keys and weights; tasks that drop groups."""
    data = [(f"h{i}", i % 3, 100.0 - i) for i in range(12) for _ in range(5)]
    data += [(f"x{i}", None, 1.0) for i in range(3000)] + [(None, 1, 400.0), ("t1", 1, 430.0), ("t2", 1, 430.0), ("n", 1, None)]
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "a string, b int, w double").repartition(3)
    got = [(r["a"], r["b"], r["w"]) for r in top_k.top_groups(df, ["a", "b"], "w", 9, capacity).collect()]
    sums = {}
    for a, b, w in data:
        if w is not None:
            sums[a, b] = sums.get((a, b), 0) + w
    wanted = sorted(sums, key=lambda k: (-sums[k], k[0] is not None, k[0] or "", k[1]))[:9]
    assert got == [(*k, sums[k]) for k in wanted]


def test_top_groups_that_are_alike(spark, monkeypatch):
    """Tasks never remember more groups than the bound; what they cannot tell apart is grouped."""
    capacities, summaries = [], top_k._summaries

    def recorded(rows, capacity):
        capacities.append(capacity)
        return summaries(rows, capacity)

    monkeypatch.setattr(top_k, "_summaries", recorded)
    monkeypatch.setattr(top_k, "MOST", 40)
    df = spark.range(6000).selectExpr(
        "id * 7 % 3000 AS a", "cast(if(id % 3000 < 9, null, id % 2) AS int) AS b", "1.0 + id % 3 AS w"
    )
    got = [tuple(r) for r in top_k.top_groups(df.repartition(3), ["a", "b"], "w", 30, 5).collect()]
    sums = {}
    for r in df.collect():
        sums[r["a"], r["b"]] = sums.get((r["a"], r["b"]), 0) + r["w"]
    wanted = sorted(sums, key=lambda k: (-sums[k], k[0], k[1] is not None, k[1] or 0))[:30]
    assert got == [(*k, sums[k]) for k in wanted]
    assert capacities == [5, 40]


def test_sketches_add_up(spark):
    lines = spark.range(60_000).selectExpr(
        "id % 20000 AS order_id", "id % 3000 AS customer_id", "cast(id % 12 AS string) AS order_month",
        "cast(id % 7 AS string) AS city", "'k' AS category", "'c' AS carrier",
    )
    cells = sketches.distinct_sketches(lines)
    found = rows(sketches.compared_counts(cells, lines, ["city"]))
    assert len(found) == 7 and all(r["orders_within"] and r["customers_within"] for r in found)
    (total,) = rows(sketches.approximate_counts(cells))
    assert total["orders"] == pytest.approx(20_000, rel=sketches.relative_error())


def test_bucketed_join_has_no_exchange_on_the_key(spark, tmp_path, monkeypatch):
    orders = spark.range(500).selectExpr("id AS order_id", "'2024-01' AS order_month", "cast(id % 3 AS string) AS city")
    items = spark.range(1500).selectExpr(
        "id % 500 AS order_id", "2.0 AS gmv_line", "1.5 AS gmv_after_disc", "0.1 AS platform_fee"
    )
    BucketedMarts.write({"orders": orders, "items": items}, str(tmp_path), "order_id", 4)
    stored = BucketedMarts.open(spark, str(tmp_path))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = metrics.fees_month_city(stored.table("items"), stored.table("orders"))
        assert "hashpartitioning(order_id" not in plan_of(joined)
        assert "SortMergeJoin" in plan_of(joined)
        assert sorted(r["items"] for r in joined.collect()) == [498, 501, 501]
        assert "hashpartitioning(order_id" in plan_of(metrics.fees_month_city(items, orders))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert buckets_for(0, 3) == 4 and buckets_for(1 << 40, 8) == 8192


def test_buckets_grow_with_the_sources(spark, tmp_path, monkeypatch):
    """As many buckets as the files behind the marts ask for, the same for all marts."""
    monkeypatch.setattr(buckets, "BUCKET_BYTES", 1 << 12)
    source = str(tmp_path / "a source")
    spark.range(3000).selectExpr("id % 900 AS k", "id AS v").repartition(2).write.parquet(source)
    read = spark.read.parquet(source)
    size = size_on_storage(spark, source)
    assert buckets.input_bytes(read.groupBy("k").count()) == size > 4 * buckets.BUCKET_BYTES
    marts = {"large": read, "small": spark.range(900).withColumnRenamed("id", "k")}
    BucketedMarts.write(marts, str(tmp_path / "out"), "k", 2)
    stored = BucketedMarts.open(spark, str(tmp_path / "out"))
    joined = stored.table("large").hint("merge").join(stored.table("small"), "k")
    assert joined.count() == 3000 and "hashpartitioning" not in plan_of(joined)
    numbers = spark.read.parquet(str(tmp_path / "out" / "buckets")).select("buckets").distinct().collect()
    assert [r[0] for r in numbers] == [buckets_for(buckets.MOVED * size, 2)] and numbers[0][0] > 4


def test_rejected_records(spark, tmp_path):
    header = "order_item_id,order_id,product_id,seller_id,quantity,unit_price,discount_pct,platform_fee_pct,note"
    good = ["1,10,5,7,2,19.90,0.10,0.05,fine", '2,10,5,7,1,"1.5",0.10,0.05,"a ""b"", c"']
    bad = {
        "3,10,5,7,2,19.90,0.10": "not as many fields as the header",
        "4,10,5,7,2,19.90,0.10,0.05,x,y,z": "not as many fields as the header",
        "5,10,5,7,two,19.90,0.10,0.05,x": "quantity: no int",
        "6,,5,7,2,19.90,0.10,0.05,x": "order_id: empty",
        "7,10,5,7,2,19.12345678,0.10,0.05,x": "unit_price: more digits than can be kept",
        "8,abc,5,7,2,19.90,0.10,0.05,x": "order_id: no bigint",
    }
    (tmp_path / "items.csv").write_text("\n".join([header, *good, *bad]) + "\n")
    kept, rejected = read_csv_checked(spark, str(tmp_path / "items.csv"), ORDER_ITEMS)
    assert sorted((r["order_item_id"], float(r["unit_price"])) for r in kept.collect()) == [(1, 19.9), (2, 1.5)]
    found = {r["line"]: r["reason"] for r in rejected.collect()}
    assert found == bad
    assert all(r["file"].endswith("items.csv") for r in rejected.collect())
    counts = rows(reading_counts(kept, rejected, "items"))
    assert counts == [dict(table_name="items", n_records=8, n_good=2, n_rejected=6)]


def test_censored_curve(spark):
    """With everyone seen long enough it is the plain share; a customer seen briefly counts as long."""
    start = ts("2024-01-01 08:00:00")
    at = lambda c, days, status="OnTime": (c, c * 1000 + days, start + dt.timedelta(days=days), status)
    schema = "customer_id int, order_id int, event_at timestamp_ntz, delivery_status string"
    seen = [at(c, 0) for c in range(1, 9)] + [at(1, 10), at(2, 10), at(3, 50), at(4, 90), at(5, 91)]
    end = [at(99, 400, "Lost")]
    history = spark.createDataFrame(seen + end, schema)
    curve = {r["day"]: r for r in rows(cohorts.repeat_curve_censored(history))}
    b2 = next(r for r in rows(cohorts.b2_first_delay_repeat(history)) if r["first_order_delay_status"] == "OnTime")
    assert curve[90]["share"] == b2["90_day_repeat_rate"] == 0.5 and curve[91]["share"] == 0.625
    # Two more customers who are seen for twenty days are at risk on day 10 only.
    late = [at(c, 380) for c in (20, 21)]
    curve = {r["day"]: r for r in rows(cohorts.repeat_curve_censored(spark.createDataFrame(seen + late + end, schema)))}
    assert (curve[10]["at_risk"], curve[10]["share"]) == (10, 0.2) and curve[50]["at_risk"] == 6
    assert curve[50]["share"] == pytest.approx(1 - 0.8 * 5 / 6, abs=1e-6)
