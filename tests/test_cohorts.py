import datetime as dt

import pytest

from lanewise.operators import cohorts, metrics
from tests.fixtures import market, only, rows, ts

FIRST = ts("2024-07-04 10:00:00")
WINDOW = dt.timedelta(days=90)
SECOND = dt.timedelta(seconds=1)


def with_deliveries(spark, times, cutoff=None):
    """One customer with deliveries at `times`; another customer's delivery sets the cutoff."""
    events = [(1, t) for t in times]
    if cutoff is not None:
        events.append((2, cutoff))
    orders = [dict(order_id=i, customer_id=c) for i, (c, _) in enumerate(events, 1)]
    shipments = [dict(order_id=i, delivered_at=t) for i, (_, t) in enumerate(events, 1)]
    return market(spark, orders=orders, shipments=shipments)


def repeated(spark, times, cutoff):
    m = with_deliveries(spark, times, cutoff)
    members = cohorts.cohort_members(m.delivered_history)
    return [r["repeated"] for r in rows(members) if r["customer_id"] == 1]


@pytest.mark.parametrize(
    "gap, expected",
    [
        (dt.timedelta(0), False),
        (SECOND, True),
        (WINDOW, True),
        (WINDOW + SECOND, False),
    ],
)
def test_window_is_open_left_closed_right(spark, gap, expected):
    assert repeated(spark, [FIRST, FIRST + gap], FIRST + 3 * WINDOW) == [expected]


def test_tie_at_first_does_not_hide_a_later_repeat(spark):
    times = [FIRST, FIRST, FIRST, FIRST + SECOND]
    assert repeated(spark, times, FIRST + 3 * WINDOW) == [True]


@pytest.mark.parametrize("late_by, members", [(dt.timedelta(0), [False]), (SECOND, [])])
def test_eligibility_includes_the_edge(spark, late_by, members):
    assert repeated(spark, [FIRST + late_by], FIRST + WINDOW) == members


def test_cohort_label_of_tie_follows_lowest_order(spark):
    m = market(
        spark,
        orders=[dict(order_id=i) for i in (4, 3)] + [dict(order_id=9, customer_id=2)],
        shipments=[
            dict(order_id=4, delivered_at=FIRST),
            dict(order_id=3, delivered_at=FIRST, delivery_status="Late_1_2d"),
            dict(order_id=9, delivered_at=FIRST + 2 * WINDOW),
        ],
    )
    row = only(cohorts.b2_first_delay_repeat(m.delivered_history))
    assert row["first_order_delay_status"] == "Delayed"
    assert row["90_day_repeat_rate"] == 0.0


def test_shipment_without_order_does_not_move_the_cutoff(spark):
    m = market(
        spark,
        orders=[dict(order_id=1)],
        shipments=[
            dict(order_id=1, delivered_at=FIRST),
            dict(order_id=77, delivered_at=FIRST + 9 * WINDOW),
        ],
    )
    assert rows(cohorts.b2_first_delay_repeat(m.delivered_history)) == []


def test_mart_history_equals_raw_history(spark):
    m = with_deliveries(spark, [FIRST, FIRST + SECOND], FIRST + 3 * WINDOW)
    raw = cohorts.b2_first_delay_repeat(m.delivered_history)
    mart = cohorts.b2_first_delay_repeat(cohorts.history_of_mart(m.orders_enriched))
    assert rows(raw) == rows(mart)


def test_sensitivity_keeps_lost_and_open_first_orders(spark):
    later = FIRST + 2 * WINDOW
    m = market(
        spark,
        orders=[
            dict(order_id=1, customer_id=1, created_at=FIRST, status="Cancelled"),
            dict(order_id=2, customer_id=1, created_at=FIRST + SECOND),
            dict(order_id=3, customer_id=1, created_at=FIRST + WINDOW),
            dict(order_id=4, customer_id=2, created_at=FIRST),
            dict(order_id=5, customer_id=3, created_at=later),
        ],
        shipments=[
            dict(order_id=2, delivery_status="Lost", delivered_at=None),
            dict(order_id=3),
            dict(order_id=4, delivery_status="InTransit", delivered_at=None),
            dict(order_id=5),
        ],
    )
    found = {
        r["first_order_delay_status"]: (r["customers"], r["repeated"])
        for r in rows(cohorts.b2_sensitivity(m.orders, m.shipments))
    }
    assert found == {"Delayed": (1, 1), "Unknown": (1, 0)}


def repeat_months(spark, second):
    orders = [
        dict(order_id=1, created_at=ts("2024-07-01 10:00:00")),
        dict(order_id=2, created_at=ts("2024-07-02 10:00:00")),
        dict(order_id=3, created_at=ts("2024-08-20 10:00:00")),
    ]
    shipments = [
        dict(order_id=1, delivered_at=ts("2024-07-04 10:00:00")),
        dict(order_id=2, delivered_at=second),
    ]
    m = market(spark, orders=orders, items=[dict(order_id=1)], shipments=shipments)
    return {r["order_month"]: r["repeat_rate"] for r in rows(metrics.repeat_rate_month(m.activity))}


@pytest.mark.parametrize(
    "second, july", [("2024-07-31 23:59:59", 1.0), ("2024-08-01 00:00:00", 0.0)]
)
def test_repeat_counts_to_the_end_of_the_month(spark, second, july):
    assert repeat_months(spark, ts(second)) == {"2024-07": july, "2024-08": 1.0}


def test_b1_counts_orders_of_all_statuses(spark):
    m = market(
        spark,
        orders=[dict(order_id=1, status="Cancelled"), dict(order_id=2)],
        items=[dict(order_id=1), dict(order_id=2, quantity=2)],
        shipments=[dict(order_id=2)],
    )
    row = only(metrics.b1_city_month_metrics(m.activity, m.customers))
    assert (float(row["gmv"]), row["number_of_orders"], row["unique_customers"]) == (300.0, 2, 1)


def test_spot_check_does_not_depend_on_partitioning(spark, sf001):
    from catalog.star_adapter import star_market

    m = star_market(spark, sf001)
    drawn = []
    for parts in (1, 13):
        first = m.customer_first_order.repartition(parts)
        check = cohorts.cohort_spot_check(first, m.delivered_history, n=3, seed=7)
        drawn.append(sorted(r["customer_id"] for r in rows(check)))
    assert drawn[0] == drawn[1] and len(drawn[0]) == 6
