import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanewise.functions.columns import delay_band, money_label, month_range, severity
from lanewise.operators import lanes, metrics, scenarios, slices
from lanewise.plans.dashboard import dashboard
from tests.fixtures import market, only, rows, ts


@pytest.fixture()
def shop(spark):
    """Two carriers, a cancelled order, one order that spans two categories."""
    return market(
        spark,
        orders=[
            dict(order_id=1),
            dict(order_id=2, customer_id=2),
            dict(order_id=3, status="Cancelled"),
            dict(order_id=4, created_at=ts("2024-08-03 23:59:59")),
        ],
        items=[
            dict(order_id=1, product_id=1),
            dict(order_id=1, product_id=2, quantity=2),
            dict(order_id=2, product_id=1),
            dict(order_id=3, product_id=1, quantity=5),
            dict(order_id=4, product_id=2),
        ],
        products=[dict(product_id=1), dict(product_id=2, category="Toys")],
        shipments=[
            dict(order_id=1),
            dict(
                order_id=2,
                carrier="InHouse",
                delivery_status="Late_1_2d",
                delivered_at=ts("2024-07-06 10:00:00"),
            ),
            dict(order_id=4, delivery_status="Lost", delivered_at=None),
        ],
    )


def test_carrier_filter_keeps_unshipped_orders(shop):
    kept = slices.slice_lines(shop.dashboard_lines, carriers=["InHouse"])
    assert {r["order_id"] for r in rows(kept)} == {2, 3}
    kpi = only(slices.kpi_strip(kept))
    assert (kpi["n_orders"], kpi["evaluable_orders"]) == (2, 1)
    assert float(kpi["gmv"]) == 600.0


def test_dates_are_inclusive_days(shop):
    kept = slices.slice_lines(
        shop.dashboard_lines, date_from=dt.date(2024, 8, 3), date_to=dt.date(2024, 8, 3)
    )
    assert {r["order_id"] for r in rows(kept)} == {4}


def test_category_filter_is_on_lines_but_orders_count_once(shop):
    kept = slices.slice_lines(shop.dashboard_lines, categories=["Toys"])
    kpi = only(slices.kpi_strip(kept))
    assert float(kpi["gmv"]) == 300.0
    assert kpi["n_orders"] == 2
    both = {r["category"]: r["orders"] for r in rows(slices.category_contribution(shop.dashboard_lines))}
    assert both == {"Books": 3, "Toys": 2}


def test_kpi_values(shop):
    kpi = only(slices.kpi_strip(shop.dashboard_lines))
    assert kpi["n_customers"] == 2
    assert kpi["avg_order"] == 1000.0 / 4
    assert (kpi["delayed_orders"], kpi["evaluable_orders"]) == (2, 3)
    assert kpi["repeat_rate"] == 0.0
    # The lost parcel has no delay and does not enter the mean.
    assert kpi["avg_delay_days"] == 1.0


def test_empty_slice_is_empty_not_an_error(shop):
    nothing = slices.slice_lines(shop.dashboard_lines, cities=["Nowhere"])
    kpi = slices.kpi_strip(nothing)
    row = only(kpi)
    assert (row["n_orders"], row["avg_order"], row["delayed_rate"]) == (0, 0.0, None)
    assert only(slices.kpi_severity(kpi)) == {"delayed_class": "info", "repeat_class": "info"}
    for report in (
        slices.trend_gmv,
        slices.trend_orders,
        slices.trend_delayed_rate,
        slices.trend_repeat_share,
        slices.breakdown_gmv,
        slices.breakdown_delay,
        slices.worst_lanes,
        slices.lane_grid,
        slices.category_contribution,
        slices.order_outcome_mix,
        slices.readout_carrier_gap,
        slices.readout_broken_lane,
        slices.readout_top_category,
    ):
        assert rows(report(nothing)) == [], report.__name__


def test_all_carriers_null(spark):
    m = market(spark, orders=[dict(order_id=1, status="Cancelled")], items=[dict(order_id=1)])
    lines = m.dashboard_lines
    assert rows(slices.lane_grid(lines)) == []
    assert only(slices.order_outcome_mix(lines))["share"] == 1.0
    assert only(slices.kpi_strip(lines))["repeat_rate"] is None


def test_readouts(shop):
    lines = shop.dashboard_lines
    gap = only(slices.readout_carrier_gap(lines))
    assert (gap["best_carrier"], gap["worst_carrier"]) == ("CarrierA", "InHouse")
    assert gap["multiple"] == 2.0
    lane = only(slices.readout_broken_lane(lines, min_orders=2))
    assert (lane["carrier"], lane["orders"]) == ("CarrierA", 2)
    assert lane["market_rate"] == pytest.approx(2 / 3)
    assert only(slices.readout_top_category(lines))["category"] == "Books"
    one = slices.slice_lines(lines, categories=["Toys"])
    assert rows(slices.readout_top_category(one)) == []


def test_grid_pivot_fills_orders_only(shop):
    wide = {
        r["carrier"]: r for r in rows(slices.lane_grid_pivot(shop.dashboard_lines, ["Pune", "Goa"]))
    }
    assert wide["InHouse"]["Goa_orders"] == 0 and wide["InHouse"]["Goa_rate"] is None
    assert wide["InHouse"]["Pune_orders"] == 1 and wide["InHouse"]["Pune_rate"] == 1.0


def test_b3_attributes_gmv_per_seller(spark):
    m = market(
        spark,
        orders=[dict(order_id=1)],
        items=[
            dict(order_id=1, seller_id=1),
            dict(order_id=1, seller_id=1),
            dict(order_id=1, seller_id=2, quantity=3),
            dict(order_id=1, seller_id=2),
        ],
        shipments=[
            dict(order_id=1, delivery_status="Late_1_2d", delivered_at=ts("2024-07-05 10:00:00"))
        ],
    )
    found = {
        r["seller_id"]: (r["delivered_orders"], float(r["total_gmv"]), r["avg_delay_days"])
        for r in rows(lanes.b3_seller_carrier_city(m.orders, m.order_items, m.shipments, 1))
    }
    assert found == {1: (1, 200.0, 0.0), 2: (1, 400.0, 0.0)}
    top = lanes.b3_seller_carrier_city(m.orders, m.order_items, m.shipments, 1)
    assert only(lanes.b3_top_share(top, 1))["top_share"] == pytest.approx(400 / 600)
    none = lanes.b3_seller_carrier_city(m.orders, m.order_items, m.shipments, 100)
    assert only(lanes.b3_top_share(none, 20))["top_share"] is None


def test_scenarios_never_recover_a_lost_parcel(shop):
    rates = {r["scenario"]: r["ontime_rate"] for r in rows(scenarios.scenario_rates(shop.shipments_timed))}
    assert rates["current"] == pytest.approx(1 / 3)
    assert rates["relax +3d"] == pytest.approx(2 / 3)
    assert rates["tighten -1d"] == 0.0


def test_targeted_policy_moves_target_lanes_only(shop):
    summary = {
        r["scenario"]: r for r in rows(scenarios.scenario_summary(shop.scenario_flags, [("CarrierA", "Pune")]))
    }
    assert summary["widen_broken_lanes_+3d"]["ontime_rate_vs_today"] == 0.0
    assert summary["widen_all_lanes_+2d"]["delayed_gmv_vs_today"] == Decimal("-100.00")
    lever = only(
        scenarios.readout_definition_lever(
            scenarios.scenario_summary(shop.scenario_flags, [("CarrierA", "Pune")])
        )
    )
    assert lever["current_ontime_rate"] == pytest.approx(1 / 3)


def test_dashboard_reports_and_releases_the_slice(spark, shop):
    summary = scenarios.scenario_summary(shop.scenario_flags, [("CarrierA", "Pune")])
    with dashboard(shop.dashboard_lines, summary, categories=["Books"]) as reports:
        assert only(reports["kpi_strip"])["n_orders"] == 3
        assert {name for name, df in reports.items() if df.columns} == set(reports)


def test_money_labels(spark):
    amounts = [0.0, 99_999.0, 1e5, 9_999_999.0, 1e7, 123_456_789.0]
    df = spark.createDataFrame([(a,) for a in amounts], "amount double")
    labels = [r["label"] for r in rows(df.select(money_label(F.col("amount")).alias("label")))]
    assert labels == [
        "Rs 0",
        "Rs 99,999",
        "Rs 1.00 L",
        "Rs 100.00 L",
        "Rs 1.00 Cr",
        "Rs 12.35 Cr",
    ]


def test_bands(spark):
    df = spark.createDataFrame([(0.31,), (0.32,), (0.5,), (None,)], "v double")
    bands = rows(df.select(delay_band(F.col("v")).alias("b"), severity(F.col("v"), 0.5, 0.3).alias("s")))
    assert [r["b"] for r in bands][:3] == ["success", "warning", "danger"]
    assert [r["s"] for r in bands] == ["warn", "warn", "good", "info"]


def test_pivots_keep_every_value(spark):
    cells = spark.createDataFrame(
        [("2024-01", "Goa", 5e6), ("2024-02", "Goa", 7e6)], "order_month string, city string, gmv double"
    )
    assert [tuple(r.values()) for r in rows(metrics.gmv_city_month_pivot(cells))] == [("Goa", 5.0, 7.0, 12.0)]
    with pytest.raises(ValueError, match="2024-02"):
        metrics.gmv_city_month_pivot(cells, ["2024-01"])
    ships = spark.createDataFrame(
        [(1, "A", "St. Louis", "OnTime"), (2, "B", "St. Louis", "Late_1_2d")],
        "shipment_id long, carrier string, ship_to_city string, delivery_status string",
    )
    assert rows(metrics.delay_city_carrier_pivot(ships))[0].keys() == {"ship_to_city", "A", "B"}
    with pytest.raises(ValueError, match="B"):
        metrics.delay_city_carrier_pivot(ships, ["A"])


def test_grid_with_a_dot_in_a_city(spark):
    shop = market(
        spark,
        orders=[dict(order_id=1)],
        items=[dict(order_id=1)],
        shipments=[dict(order_id=1, ship_to_city="St. Louis")],
    )
    row = rows(slices.lane_grid_pivot(shop.dashboard_lines))[0]
    assert row["St. Louis_orders"] == 1
    with pytest.raises(ValueError, match="St. Louis"):
        slices.lane_grid_pivot(shop.dashboard_lines, ["Pune"])


def test_month_range():
    assert month_range("2024-11", "2025-02") == ["2024-11", "2024-12", "2025-01", "2025-02"]
