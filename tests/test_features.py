from decimal import Decimal

import pytest

from lanewise.operators import features, integrity, reconcile, scenarios, slices
from lanewise.schemas import require_columns
from tests.fixtures import day, market, only, rows, ts


def test_item_features_are_exact(spark):
    m = market(
        spark,
        orders=[dict(order_id=1)],
        items=[dict(order_id=1, quantity=3, unit_price=Decimal("19.99"))],
    )
    row = only(m.items_enriched)
    assert row["gmv_line"] == Decimal("59.97")
    assert row["gmv_after_disc"] == Decimal("53.973")
    assert row["platform_fee"] == Decimal("2.9985")


def test_delay_is_counted_on_date_parts(spark):
    """23:59 on the promised day is a delay of 0 days, one minute later of 1."""
    m = market(
        spark,
        orders=[dict(order_id=1), dict(order_id=2)],
        shipments=[
            dict(order_id=1, delivered_at=ts("2024-07-05 23:59:00"), delivery_status="Late_1_2d"),
            dict(order_id=2, delivered_at=ts("2024-07-06 00:00:00"), delivery_status="Late_1_2d"),
        ],
    )
    days = {r["order_id"]: r["delivery_delay_days"] for r in rows(m.shipments_enriched)}
    assert days == {1: 0, 2: 1}


def lost_in_transit_late(spark):
    return market(
        spark,
        orders=[dict(order_id=i) for i in (1, 2, 3, 4)],
        items=[dict(order_id=i) for i in (1, 2, 3, 4)],
        shipments=[
            dict(order_id=1, delivery_status="Lost", delivered_at=None),
            dict(order_id=2, delivery_status="InTransit", delivered_at=None),
            dict(order_id=3, delivery_status="Late_1_2d", delivered_at=ts("2024-07-05 09:00:00")),
            dict(order_id=4),
        ],
    )


def test_tri_state_delay_flag(spark):
    m = lost_in_transit_late(spark)
    flags = {r["order_id"]: r["is_delayed"] for r in rows(m.shipments_enriched)}
    assert flags == {1: True, 2: None, 3: True, 4: False}
    months = {r["order_id"]: r["delivered_month"] for r in rows(m.shipments_enriched)}
    assert months == {1: None, 2: None, 3: "2024-07", 4: "2024-07"}


def test_delayed_populations_differ(spark):
    """The four reports of lateness each have their own population."""
    from lanewise.operators import lanes, metrics

    m = lost_in_transit_late(spark)
    assert only(metrics.delay_by_carrier(m.shipments))["shipments"] == 3
    assert only(metrics.delay_by_carrier(m.shipments))["delayed"] == 2
    lane = only(lanes.lane_performance(m.orders, m.order_items, m.shipments))
    assert lane["delivered_orders"] == 2 and lane["delayed_order_rate"] == 0.5
    late = lanes.b4_late_orders(m.orders, m.customers, m.shipments)
    assert {r["order_id"] for r in rows(late)} == {1, 2, 3}
    assert only(lanes.b4_equivalence(late, lanes.b4_late_orders_correlated(
        m.orders, m.customers, m.shipments)).filter("side = 'only_original'"))["n"] == 0


def test_order_without_items_keeps_null_gmv(spark):
    m = market(spark, orders=[dict(order_id=1), dict(order_id=2)], items=[dict(order_id=1)])
    gmv = {r["order_id"]: r["order_gmv"] for r in rows(m.orders_enriched)}
    assert gmv == {1: Decimal("100.00"), 2: None}
    audit = only(
        features.features_null_audit(features.with_delivery(m.orders_gmv, m.shipments))
    )
    assert audit == {"n_rows": 2, "null_order_gmv": 1, "null_delivery_status": 2}


def test_rollup_counts_distinct_sellers(spark):
    m = market(
        spark,
        orders=[dict(order_id=1)],
        items=[
            dict(order_id=1, seller_id=1),
            dict(order_id=1, seller_id=1, quantity=2),
            dict(order_id=1, seller_id=2),
            dict(order_id=1, seller_id=2, quantity=4),
        ],
    )
    row = only(m.order_rollup)
    assert row["order_sellers_count"] == 2
    assert row["order_items_count"] == 4
    assert row["order_units"] == 8
    assert row["order_gmv"] == Decimal("800.00")


def test_tie_on_first_delivery_goes_to_lowest_order(spark):
    same = ts("2024-07-04 10:00:00")
    m = market(
        spark,
        orders=[dict(order_id=8), dict(order_id=5)],
        shipments=[
            dict(order_id=8, delivered_at=same),
            dict(order_id=5, delivered_at=same, delivery_status="Late_1_2d"),
        ],
    )
    row = only(m.customer_first_order)
    assert row["first_order_id"] == 5
    assert row["first_order_delay_status"] == "Delayed"


def test_all_promise_lengths_are_listed(spark):
    lengths = spark.sql(
        "SELECT id < 12 AS is_fast_delivery_eligible, timestamp_ntz'2024-07-01 10:00:00' AS created_at,"
        " date_add(DATE'2024-07-01', CAST(id % 12 AS INT)) AS promised_delivery_date FROM range(24)"
    )
    assert len(rows(features.promised_days_by_fast(lengths))) == 24
    assert len(rows(features.promised_days_by_fast(lengths, 10))) == 10


def test_promised_days_and_month(spark):
    m = market(
        spark,
        orders=[
            dict(
                order_id=1,
                created_at=ts("2024-07-31 23:59:59"),
                promised_delivery_date=day("2024-08-02"),
            )
        ],
    )
    row = only(m.orders_enriched)
    assert (row["order_month"], row["promised_days"]) == ("2024-07", 2)


def test_lines_flag_evaluable_never_null(spark):
    m = market(
        spark,
        orders=[dict(order_id=1, status="Cancelled")],
        items=[dict(order_id=1), dict(order_id=99)],
    )
    assert {r["order_id"]: r["evaluable_delivery"] for r in rows(m.dashboard_lines)} == {
        1: False,
        99: False,
    }


def test_orphans_are_counted_per_row(spark):
    m = market(
        spark,
        orders=[dict(order_id=1, customer_id=7)],
        customers=[dict(customer_id=1)],
        items=[dict(order_id=2), dict(order_id=2), dict(order_id=1)],
        shipments=[dict(order_id=3)],
    )
    found = {r["check_name"]: r["n"] for r in rows(integrity.integrity_fk_orphans(**m.tables))}
    assert found == {
        "orders without customer": 1,
        "items without order": 2,
        "items without product": 0,
        "items without seller": 0,
        "shipments without order": 1,
        "orders missing a shipment": 1,
        "orders missing items": 0,
    }


def test_time_order_violations(spark):
    m = market(
        spark,
        orders=[dict(order_id=1), dict(order_id=2)],
        shipments=[
            dict(order_id=1, shipped_at=ts("2024-06-30 00:00:00")),
            dict(order_id=2, delivered_at=ts("2024-07-01 12:00:00")),
        ],
    )
    assert only(integrity.integrity_time_order(m.orders, m.shipments)) == {
        "shipped_before_created": 1,
        "delivered_before_shipped": 1,
        "delivered_rows": 2,
    }


def test_reconcile_finds_a_broken_mart(spark):
    m = lost_in_transit_late(spark)
    orders = m.orders_enriched
    good = reconcile.reconcile_features(
        m.items_enriched, m.shipments_enriched, orders, m.customer_first_order
    )
    assert all(r["ok"] for r in rows(good))
    bad = reconcile.reconcile_features(
        m.items_enriched.limit(2), m.shipments_enriched, orders, m.customer_first_order
    )
    assert [r["check_name"] for r in rows(bad) if not r["ok"]] == ["gmv items = orders"]


def test_reconcile_cells_shows_missing_cells(spark):
    m = lost_in_transit_late(spark)
    cells = reconcile.gmv_cells_sql(m.orders, m.customers, m.order_items)
    assert all(r["ok"] for r in rows(reconcile.reconcile_b1_cells(m.orders_enriched, cells)))
    missing = reconcile.reconcile_b1_cells(m.orders_enriched, cells.limit(0))
    assert [r["ok"] for r in rows(missing)] == [False]


def test_missing_column_is_an_error(spark):
    m = market(spark, orders=[dict(order_id=1)])
    with pytest.raises(ValueError, match="created_at"):
        require_columns(m.orders.drop("created_at"), ["created_at"], "orders")


def test_label_rule_matches_label(spark):
    m = lost_in_transit_late(spark)
    assert only(scenarios.scenario_label_mismatch(m.shipments_timed)) == {"n_mismatch": 0}


def test_outcome_status_wins_over_shipment(spark):
    """A returned order whose parcel is marked lost is an order returned."""
    m = market(
        spark,
        orders=[dict(order_id=1, status="Returned")],
        items=[dict(order_id=1)],
        shipments=[dict(order_id=1, delivery_status="Lost", delivered_at=None)],
    )
    assert only(slices.order_outcome_mix(m.dashboard_lines))["outcome"] == "Returned"
