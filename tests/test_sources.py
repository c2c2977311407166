from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from lanewise import Marketplace
from lanewise.operators import cohorts, metrics, slices
from lanewise.plans.publish import MARTS, publish_marts
from lanewise.schemas import PROMISE_SUMMARY, TABLES
from lanewise.sources.marts import shared_folder, write_mart
from lanewise.sources.readers import (
    read_csv_table,
    read_optional,
    read_parquet_table,
    read_tables,
    register_views,
)
from tests.fixtures import market, rows


@pytest.fixture()
def shop(spark):
    return market(
        spark,
        orders=[dict(order_id=1), dict(order_id=2, status="Cancelled")],
        items=[dict(order_id=1), dict(order_id=2)],
        shipments=[dict(order_id=1)],
    )


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_round_trip(spark, shop, tmp_path, fmt):
    for name, df in shop.tables.items():
        path = f"{tmp_path}/{name}.{fmt}"
        df.write.option("header", True).format(fmt).save(path)
    again = Marketplace.read(spark, str(tmp_path), fmt)
    for name, df in shop.tables.items():
        found = getattr(again, name)
        for got, declared in zip(found.schema, TABLES[name]):
            decimal = isinstance(declared.dataType, DecimalType)
            assert isinstance(got.dataType, DecimalType) if decimal else got.dataType == declared.dataType
        key = df.columns[0]
        assert rows(found.orderBy(key)) == rows(df.orderBy(key))


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "products.csv").write_text("category,note,product_id\nBooks,x,4\nToys,y,5\n")
    df = read_csv_table(spark, str(tmp_path / "products.csv"), TABLES["products"])
    assert sorted((r["product_id"], r["category"]) for r in rows(df)) == [(4, "Books"), (5, "Toys")]
    with pytest.raises(ValueError, match="seller_id"):
        read_csv_table(spark, str(tmp_path / "products.csv"), TABLES["sellers"])


ITEM_HEADER = (
    "order_item_id,order_id,product_id,seller_id,quantity,unit_price,discount_pct,platform_fee_pct\n"
)


def test_no_digits_are_lost(spark, shop, tmp_path):
    path = str(tmp_path / "items.csv")
    (tmp_path / "items.csv").write_text(ITEM_HEADER + "1,1,1,1,1,19.995,0.125,0.0175\n")
    row = rows(read_csv_table(spark, path, TABLES["order_items"]))[0]
    assert [row[c] for c in ("unit_price", "discount_pct", "platform_fee_pct")] == [
        Decimal("19.995"), Decimal("0.125"), Decimal("0.0175")
    ]
    fine = shop.order_items.selectExpr(
        "* EXCEPT (unit_price, discount_pct, platform_fee_pct)", "19.995D AS unit_price",
        "CAST(0.125 AS DECIMAL(5,3)) AS discount_pct", "0.0175D AS platform_fee_pct",
    )
    fine.write.parquet(str(tmp_path / "items"))
    row = rows(read_parquet_table(spark, str(tmp_path / "items"), TABLES["order_items"]))[0]
    assert [row[c] for c in ("unit_price", "discount_pct", "platform_fee_pct")] == [
        Decimal("19.995"), Decimal("0.125"), Decimal("0.0175")
    ]
    (tmp_path / "items.csv").write_text(ITEM_HEADER + "1,1,1,1,1,19.99999999,0.1,0.1\n")
    with pytest.raises(PySparkException, match="more digits"):
        rows(read_csv_table(spark, path, TABLES["order_items"]))


def test_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text('product_id,category\n1,"Home, ""Deco"" & Co"\n2,"two\nlines"\n')
    found = read_csv_table(spark, str(path), TABLES["products"], multi_line=True)
    assert sorted(tuple(r.values()) for r in rows(found)) == [(1, 'Home, "Deco" & Co'), (2, "two\nlines")]


def test_text_keys(spark, shop, tmp_path):
    """Text ids give the same report as numbers; ties of text go by text order."""
    for name, df in shop.tables.items():
        ids = [c for c in df.columns if c.endswith("_id")]
        named = df.withColumns({c: F.concat(F.lit(c[:3].upper()), F.col(c).cast("string")) for c in ids})
        named.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    text = Marketplace.read(spark, str(tmp_path), "csv", key_type=StringType())
    assert text.orders.schema["order_id"].dataType == StringType()
    wanted = rows(metrics.b1_city_month_metrics(shop.activity, shop.customers))
    assert rows(metrics.b1_city_month_metrics(text.activity, text.customers)) == wanted
    assert rows(cohorts.b2_first_delay_repeat(text.delivered_history)) == rows(
        cohorts.b2_first_delay_repeat(shop.delivered_history)
    )
    assert rows(text.customer_first_order)[0]["customer_id"].startswith("CUS")


def test_views(spark, shop):
    register_views(shop.tables, "shop_")
    assert spark.sql("SELECT count(*) AS n FROM shop_orders").first()["n"] == 2


def test_optional_source(spark, shop, tmp_path):
    path = str(tmp_path / "q4")
    assert rows(read_optional(spark, path, PROMISE_SUMMARY)) == []
    shop.products.write.parquet(path)
    with pytest.raises(ValueError, match="scenario"):
        read_optional(spark, path, PROMISE_SUMMARY)
    assert len(rows(read_optional(spark, path, TABLES["products"]))) == 1


def test_publish_writes_all_marts(spark, shop, tmp_path):
    out = str(tmp_path / "marts")
    listed = {r["name"]: r for r in rows(publish_marts(shop, out, [("CarrierA", "Pune")]))}
    assert set(listed) == set(MARTS)
    assert listed["orders_enriched"]["n_rows"] == 2
    assert listed["q4_marketplace_summary"]["n_rows"] == 7
    assert all(r["size_bytes"] > 0 for r in listed.values())
    lines = spark.read.parquet(f"{out}/dashboard_lines")
    assert rows(slices.kpi_strip(lines)) == rows(slices.kpi_strip(shop.dashboard_lines))
    # A second run replaces the first.
    again = publish_marts(shop, out, [("CarrierA", "Pune")])
    assert {r["name"]: r["n_rows"] for r in rows(again)} == {
        name: r["n_rows"] for name, r in listed.items()
    }


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root)


def test_clustered_files_hold_disjoint_ranges(spark, tmp_path):
    df = spark.range(0, 40_000).selectExpr("id", "id % 7 AS k").repartition(5)
    write_mart(df, str(tmp_path), "m", ["id"])
    ends = spark.sql(
        "SELECT min(id) AS lo, max(id) AS hi FROM parquet.`%s` "
        "GROUP BY _metadata.file_path ORDER BY lo" % (tmp_path / "m")
    ).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))


def test_read_tables_names(spark, shop, tmp_path):
    for name, df in shop.tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert list(read_tables(spark, str(tmp_path))) == list(TABLES)
