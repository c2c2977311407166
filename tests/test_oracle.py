"""Every registered query against its DuckDB form, and the recorded golden numbers."""

import pytest

import __spark_entry__ as registry
import check_oracle
from catalog.oracle import build_oracle
from catalog.spark_queries import build_queries
from catalog.star_adapter import star_market
from lanewise.operators import features, scenarios, slices
from tests.fixtures import only, rows

# The text operators have tests of their own.
ORACLE = build_oracle()
QUERIES = {name: query for name, query in registry.queries().items() if name in ORACLE}


@pytest.fixture(scope="module")
def duck(sf001):
    return check_oracle.connect(sf001)


def test_every_query_has_a_sql_form():
    assert set(build_queries()) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_duckdb(spark, duck, sf001, name):
    ok, note = check_oracle.compare(spark, duck, name, sf001, QUERIES, ORACLE)
    assert ok, note


def test_entry(spark):
    assert registry.entry(spark).count() > 0


# Golden numbers of the sf0.01 data.


@pytest.fixture(scope="module")
def shop(spark, sf001):
    return star_market(spark, sf001)


def test_golden_totals(shop):
    totals = only(features.order_status_totals(features.with_delivery(shop.orders_gmv, shop.shipments)))
    assert (totals["orders"], totals["cancelled"], totals["delivered"]) == (15_000, 1_192, 12_318)
    assert (totals["returned"], totals["shipped"]) == (745, 745)
    assert float(totals["gmv"]) == 1_447_849_638.00


def test_golden_b2(spark, sf001):
    found = {
        r["first_order_delay_status"]: (r["customers"], r["repeated"], r["90_day_repeat_rate"])
        for r in rows(QUERIES["b2_first_delay_repeat"](spark, sf001))
    }
    assert found == {"Delayed": (350, 90, 0.2571), "OnTime": (1_148, 326, 0.2840)}


def test_golden_scenarios(shop):
    summary = scenarios.scenario_summary(
        shop.scenario_flags, [("CarrierA", "NATION_3"), ("CarrierA", "NATION_7")]
    )
    found = {
        r["scenario"]: (round(r["ontime_rate"], 6), round(float(r["delayed_gmv"]), 1))
        for r in rows(summary)
    }
    assert found == {
        "current": (0.742938, 321_532_282.3),
        "widen_broken_lanes_+1d": (0.748756, 313_915_270.2),
        "widen_broken_lanes_+2d": (0.754038, 307_527_012.5),
        "widen_broken_lanes_+3d": (0.756794, 304_370_439.1),
        "widen_all_lanes_+1d": (0.840772, 195_044_818.2),
        "widen_all_lanes_+2d": (0.939371, 74_602_841.2),
        "tighten_all_lanes_-1d": (0.494833, 636_178_481.4),
    }


def test_golden_outcomes_and_slice(spark, sf001, shop):
    mix = {r["outcome"]: r["orders"] for r in rows(slices.order_outcome_mix(shop.dashboard_lines))}
    assert mix == {
        "OnTime": 9_012,
        "Late 1-2d": 2_363,
        "Late 3-5d": 518,
        "Late 5d+": 100,
        "Lost": 116,
        "Returned": 732,
        "InTransit": 728,
        "Cancelled": 1_174,
    }
    kpi = only(QUERIES["kpi_strip_sliced"](spark, sf001))
    assert round(kpi["gmv"], 1) == 88_912_745.4
    assert (kpi["n_orders"], kpi["n_customers"]) == (1_595, 674)
