"""One entry per operator: a function of the six tables.

Parameters that are data of the reporting period (the month columns of a pivot, carriers,
cities, the lanes under review) are stated here, as a user of the library would.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalog.star_adapter import BROKEN_LANES, CITIES, earlier_market, star_market
from lanewise import Marketplace
from lanewise.functions.columns import decimals_as_double
from lanewise.functions.grouped_quantiles import grouped_quantiles
from lanewise.operators import (
    cohorts,
    features,
    integrity,
    intervals,
    lanes,
    metrics,
    profile,
    reconcile,
    scenarios,
    sketches,
    slices,
)
from lanewise.operators.table_diff import table_diff
from lanewise.operators.top_k import top_groups
from lanewise.plans.cube import Slice, SliceCube
from lanewise.plans.dashboard import reports
from lanewise.plans.mart_set import MartSet
from lanewise.plans.publish import MARTS, publish_marts, publish_set, refresh_set
from lanewise.session import tune
from lanewise.sources.buckets import BucketedMarts
from lanewise.sources.marts import shared_folder, write_mart


def _publish(m: Marketplace) -> DataFrame:
    out_dir = shared_folder(m.orders.sparkSession, "marts")
    # Bytes on storage depend on the file layout, so they are left out of the comparison.
    return publish_marts(m, out_dir, BROKEN_LANES).drop("size_bytes")


def _mart_set(m: Marketplace) -> DataFrame:
    root = shared_folder(m.orders.sparkSession, "mart-set")
    return _listed(publish_set(m, root, BROKEN_LANES))


def _mart_set_refreshed(m: Marketplace) -> DataFrame:
    """The set as it was before the last orders changed, brought up to date."""
    earlier, changed = earlier_market(m)
    folder = shared_folder(m.orders.sparkSession, "earlier")
    # Read several times, and derived from the tables by joins.
    stored = {n: write_mart(getattr(earlier, n), folder, n) for n in ("orders", "shipments")}
    earlier = replace(earlier, **stored)
    root = shared_folder(m.orders.sparkSession, "mart-set")
    publish_set(earlier, root, BROKEN_LANES)
    return _listed(refresh_set(m, root, changed, BROKEN_LANES))


def _bucketed_fees(m: Marketplace) -> DataFrame:
    """Items joined to their orders on marts that are bucketed by order."""
    spark = m.orders.sparkSession
    marts = {"orders_enriched": m.orders_enriched, "items_enriched": m.items_enriched}
    folder = shared_folder(spark, "bucketed")
    BucketedMarts.write(marts, folder, "order_id", buckets=8)
    stored = BucketedMarts.open(spark, folder)
    return metrics.fees_month_city(stored.table("items_enriched"), stored.table("orders_enriched"))


def _approx_distincts(m: Marketplace) -> DataFrame:
    """Estimates per city from sketches stored per month, city, category and carrier."""
    folder = shared_folder(m.orders.sparkSession, "sketches")
    cells = write_mart(sketches.distinct_sketches(m.dashboard_lines), folder, "distinct_sketches")
    return sketches.compared_counts(cells, m.dashboard_lines, ["city"])


def _orders_diff(m: Marketplace) -> DataFrame:
    """The orders against a copy that lacks one, has one changed and one twice."""
    order_id = F.col("order_id")
    status = F.when(order_id == 202, "Changed").otherwise(F.col("status"))
    other = m.orders.where(order_id != 101).withColumn("status", status)
    return table_diff(m.orders, other.unionByName(m.orders.where(order_id == 303)), ["order_id"])


def _from_csv(m: Marketplace) -> Marketplace:
    """The six tables written as CSV with text ids, and read as the library reads them."""
    spark = m.orders.sparkSession
    root = shared_folder(spark, "csv")
    for name, df in m.tables.items():
        ids = [c for c in df.columns if c.endswith("_id")]
        text = df.withColumns({c: F.concat(F.lit(c[:3]), F.col(c).cast("string")) for c in ids})
        text.write.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
    return Marketplace.read(spark, root, "csv", key_type=StringType())


def _b1_from_csv(m: Marketplace) -> DataFrame:
    read = _from_csv(m)
    return metrics.b1_city_month_metrics(read.activity, read.customers)


def _listed(published: MartSet) -> DataFrame:
    return published.listing().where(F.col("name").isin(*MARTS)).drop("size_bytes")


def _money_labels(m: Marketplace) -> DataFrame:
    by_city = (
        metrics.gmv_month_city(m.gmv_cells)
        .groupBy("city")
        .agg(F.sum("gmv").alias("amount"))
        .select(F.lit("city").alias("level"), F.col("city").alias("item"), "amount")
    )
    by_order = features.order_gmv(m.order_items).select(
        F.lit("order").alias("level"),
        F.col("order_id").cast("string").alias("item"),
        F.col("order_gmv").alias("amount"),
    )
    return slices.labelled_money(by_city.unionByName(by_order), "amount")


def _slice(m: Marketplace) -> DataFrame:
    return slices.slice_lines(
        m.dashboard_lines,
        date_from=dt.date(1996, 1, 1),
        date_to=dt.date(1998, 12, 31),
        cities=CITIES[::2],
        categories=("ECONOMY", "LARGE", "PROMO"),
        carriers=("CarrierA", "InHouse"),
    )


def _report(name: str) -> Callable[[Marketplace], DataFrame]:
    """A report as the dashboard gives it, on its order frame."""

    def of(m: Marketplace) -> DataFrame:
        lines = m.dashboard_lines
        return reports(lines, slices.order_lines(lines), _summary(m))[name]

    return of


def _b3(m: Marketplace, min_orders: int) -> DataFrame:
    return lanes.b3_seller_carrier_city(m.orders, m.order_items, m.shipments, min_orders)


def _b4(m: Marketplace) -> DataFrame:
    return lanes.b4_late_orders(m.orders, m.customers, m.shipments)


def _b4_original(m: Marketplace) -> DataFrame:
    return lanes.b4_late_orders_correlated(m.orders, m.customers, m.shipments)


def _summary(m: Marketplace) -> DataFrame:
    return scenarios.scenario_summary(m.scenario_flags, BROKEN_LANES)


OPERATORS: dict[str, Callable[[Marketplace], DataFrame]] = {
    # profiling
    "profile_row_counts": lambda m: profile.profile_row_counts(m.tables),
    "profile_schema": lambda m: profile.profile_schema(m.tables),
    "profile_null_counts": lambda m: profile.profile_null_counts(m.tables),
    "profile_time_ranges": lambda m: profile.profile_time_ranges(m.tables),
    "profile_value_counts": lambda m: profile.profile_value_counts(m.tables),
    "profile_item_describe": lambda m: profile.profile_item_describe(m.items_enriched),
    "profile_delay_describe": lambda m: profile.profile_delay_describe(m.shipments_timed),
    "filter_domains": lambda m: profile.filter_domains(m.dashboard_lines),
    # integrity
    "integrity_fk_orphans": lambda m: integrity.integrity_fk_orphans(**m.tables),
    "integrity_unshipped_by_status": lambda m: integrity.integrity_unshipped_by_status(
        m.orders, m.shipments
    ),
    "integrity_time_order": lambda m: integrity.integrity_time_order(m.orders, m.shipments),
    "integrity_shipments_per_order": lambda m: integrity.integrity_shipments_per_order(
        m.shipments
    ),
    # feature marts
    "items_enriched": lambda m: m.items_enriched,
    "shipments_enriched": lambda m: m.shipments_enriched,
    "order_rollup": lambda m: m.order_rollup,
    "orders_enriched": lambda m: m.orders_enriched,
    "customer_first_order": lambda m: m.customer_first_order,
    "dashboard_lines": lambda m: m.dashboard_lines,
    "status_by_delayed": lambda m: features.status_by_delayed(m.shipments),
    "status_by_has_shipment": lambda m: features.status_by_has_shipment(m.orders_shipped),
    "promised_days_by_fast": lambda m: features.promised_days_by_fast(m.orders),
    "features_null_audit": lambda m: features.features_null_audit(
        features.with_delivery(m.orders_gmv, m.shipments)
    ),
    "first_order_status_counts": lambda m: features.first_order_status_counts(
        m.customer_first_order
    ),
    "order_status_totals": lambda m: features.order_status_totals(
        features.with_delivery(m.orders_gmv, m.shipments)
    ),
    "publish_marts": _publish,
    "mart_set": _mart_set,
    "mart_set_refreshed": _mart_set_refreshed,
    "bucketed_fees_month_city": _bucketed_fees,
    "orders_diff": _orders_diff,
    "csv_b1_city_month_metrics": _b1_from_csv,
    "csv_customer_first_order": lambda m: _from_csv(m).customer_first_order,
    # monthly and delay metrics
    "gmv_month_city_category": lambda m: m.gmv_cells,
    "gmv_month_city": lambda m: metrics.gmv_month_city(m.gmv_cells),
    "gmv_month_category": lambda m: metrics.gmv_month_category(m.gmv_cells),
    "gmv_city_month_pivot": lambda m: metrics.gmv_city_month_pivot(
        metrics.gmv_month_city(m.gmv_cells)
    ),
    "orders_active_month": lambda m: metrics.orders_active_month(m.orders_gmv),
    "repeat_rate_month": lambda m: metrics.repeat_rate_month(
        metrics.customer_month_activity(
            m.orders_shipped.withColumn("order_gmv", F.lit(0).cast("decimal(12,2)"))
        )
    ),
    "delay_by_city": lambda m: metrics.delay_by_city(m.shipments),
    "delay_by_carrier": lambda m: metrics.delay_by_carrier(m.shipments),
    "delay_city_carrier": lambda m: metrics.delay_city_carrier(m.shipments),
    "delay_city_carrier_pivot": lambda m: metrics.delay_city_carrier_pivot(m.shipments),
    "delay_trend_month": lambda m: metrics.delay_trend_month(m.shipments),
    # marketplace SQL
    "b1_city_month_metrics": lambda m: metrics.b1_city_month_metrics(m.activity, m.customers),
    "b1_month_totals": lambda m: metrics.b1_month_totals(
        metrics.b1_city_month_metrics(m.activity, m.customers)
    ),
    "b2_first_delay_repeat": lambda m: cohorts.b2_first_delay_repeat(m.delivered_history),
    "b3_seller_carrier_city": lambda m: _b3(m, 100),
    "b3_relaxed": lambda m: _b3(m, 30),
    "b3_min_10": lambda m: _b3(m, 10),
    "b3_top_share": lambda m: lanes.b3_top_share(_b3(m, 10), 20),
    "lane_performance": lambda m: lanes.lane_performance(m.orders, m.order_items, m.shipments),
    "b4_late_orders": _b4,
    "b4_late_orders_correlated": _b4_original,
    "b4_late_orders_evaluable": lambda m: lanes.b4_late_orders(
        m.orders, m.customers, m.shipments, evaluable_only=True
    ),
    "b4_equivalence": lambda m: lanes.b4_equivalence(_b4(m), _b4_original(m)),
    # promise scenarios
    "scenario_flags": lambda m: m.scenario_flags,
    "scenario_label_mismatch": lambda m: scenarios.scenario_label_mismatch(m.shipments_timed),
    "scenario_rates": lambda m: scenarios.scenario_rates(m.shipments_timed),
    "scenario_lanes": lambda m: scenarios.scenario_lanes(m.scenario_flags),
    "scenario_lanes_top": lambda m: scenarios.scenario_lanes_top(
        scenarios.scenario_lanes(m.scenario_flags), 10
    ),
    "scenario_target_lanes": lambda m: scenarios.scenario_target_lanes(
        scenarios.scenario_lanes(m.scenario_flags), BROKEN_LANES
    ),
    "scenario_delay_crosstab": lambda m: scenarios.scenario_delay_crosstab(
        m.shipments_timed, BROKEN_LANES
    ),
    "scenario_summary": _summary,
    # slice analytics; the slice of the dashboard's start page is all lines
    "slice_lines": _slice,
    "kpi_strip": lambda m: slices.kpi_strip(m.dashboard_lines),
    "kpi_strip_sliced": lambda m: slices.kpi_strip(_slice(m)),
    "kpi_severity": lambda m: slices.kpi_severity(slices.kpi_strip(m.dashboard_lines)),
    "trend_gmv": lambda m: slices.trend_gmv(m.dashboard_lines),
    "trend_orders": lambda m: slices.trend_orders(m.dashboard_lines),
    "trend_delayed_rate": lambda m: slices.trend_delayed_rate(m.dashboard_lines),
    "trend_repeat_share": lambda m: slices.trend_repeat_share(m.dashboard_lines),
    "breakdown_gmv": lambda m: slices.breakdown_gmv(m.dashboard_lines),
    "breakdown_delay": lambda m: slices.breakdown_delay(m.dashboard_lines),
    "worst_lanes": lambda m: slices.worst_lanes(m.dashboard_lines),
    "lane_grid": lambda m: slices.lane_grid(m.dashboard_lines),
    "lane_grid_pivot": lambda m: slices.lane_grid_pivot(m.dashboard_lines),
    "category_contribution": lambda m: slices.category_contribution(m.dashboard_lines),
    "order_outcome_mix": lambda m: slices.order_outcome_mix(m.dashboard_lines),
    "readout_carrier_gap": lambda m: slices.readout_carrier_gap(m.dashboard_lines),
    "readout_broken_lane": lambda m: slices.readout_broken_lane(m.dashboard_lines, 200),
    "readout_broken_lane_min_100": lambda m: slices.readout_broken_lane(m.dashboard_lines, 100),
    "readout_top_category": lambda m: slices.readout_top_category(m.dashboard_lines),
    "readout_definition_lever": lambda m: scenarios.readout_definition_lever(_summary(m)),
    "money_label": _money_labels,
    **{
        f"dashboard_{name}": _report(name)
        for name in ("kpi_strip", "trend_repeat_share", "worst_lanes", "order_outcome_mix")
    },
    # validation
    "reconcile_features": lambda m: reconcile.reconcile_features(
        m.items_enriched,
        m.shipments_enriched,
        features.with_delivery(m.orders_gmv, m.shipments),
        m.customer_first_order,
    ),
    "reconcile_raw_vs_marts": lambda m: reconcile.reconcile_raw_vs_marts(
        m.tables, m.items_enriched, m.shipments_enriched, m.orders_enriched
    ),
    "reconcile_b1_cells": lambda m: reconcile.reconcile_b1_cells(
        m.orders_enriched, reconcile.gmv_cells_sql(m.orders, m.customers, m.order_items)
    ),
    "reconcile_status_coverage": lambda m: reconcile.reconcile_status_coverage(
        m.orders, m.shipments
    ),
    "cohort_spot_check": lambda m: cohorts.cohort_spot_check(
        m.customer_first_order, m.delivered_history
    ),
    "edge_case_counts": lambda m: reconcile.edge_case_counts(m.orders_shipped, m.shipments),
    # analyses stated in prose
    "label_audit": lambda m: reconcile.label_audit(m.shipments_timed),
    "combo_density": lambda m: lanes.combo_density(m.orders, m.order_items, m.shipments),
    "b2_sensitivity": lambda m: cohorts.b2_sensitivity(m.orders, m.shipments),
    "b2_window_180": lambda m: cohorts.b2_first_delay_repeat(m.delivered_history, 180),
    "outcome_rates": lambda m: slices.outcome_rates(m.order_facts),
    "lateness_mix": lambda m: metrics.lateness_mix(m.shipments),
    "lane_month_zscore": lambda m: metrics.lane_month_zscore(m.shipments),
    "shipments_per_day": lambda m: metrics.shipments_per_day(m.shipments),
    "carrier_load_week": lambda m: metrics.carrier_load(m.shipments),
    "repeat_curve_censored": lambda m: cohorts.repeat_curve_censored(m.delivered_history),
    "deliveries_before": lambda m: intervals.deliveries_before(m.delivered_history),
    "lane_delay_quartiles": lambda m: grouped_quantiles(
        m.shipments_timed, ("carrier", "ship_to_city"), "delivery_delay_days", (0.25, 0.5, 0.75)
    ),
    "seller_gmv_quartiles": lambda m: grouped_quantiles(
        m.items_enriched, ("seller_id",), "gmv_line", (0.25, 0.5, 0.75)
    ),
    "top_seller_products": lambda m: top_groups(
        m.items_enriched, ("seller_id", "product_id"), "gmv_line", 20
    ),
    "approx_distincts": _approx_distincts,
    "repeat_curve": lambda m: cohorts.repeat_curve(m.delivered_history),
    "lane_month_stability": lambda m: metrics.lane_month_stability(m.shipments),
    "lane_seller_mix": lambda m: lanes.lane_seller_mix(m.order_items, m.shipments),
    "category_mix_month": lambda m: metrics.category_mix_month(m.gmv_cells),
}


#: A slice whose first and last month are covered in part.
CUBE_FILTERS = dict(
    date_from=dt.date(1996, 1, 10),
    date_to=dt.date(1998, 11, 20),
    cities=CITIES[::2],
    categories=("ECONOMY", "LARGE", "PROMO"),
    carriers=("CarrierA", "InHouse"),
)

CUBE_REPORTS: dict[str, Callable[[Slice], DataFrame]] = {
    **{
        name: (lambda part, name=name: getattr(part, name)())
        for name in (
            "kpi_strip",
            "trend_gmv",
            "trend_orders",
            "trend_delayed_rate",
            "trend_repeat_share",
            "breakdown_gmv",
            "breakdown_delay",
            "lane_grid",
            "category_contribution",
            "order_outcome_mix",
            "readout_carrier_gap",
            "readout_top_category",
        )
    },
    "worst_lanes": lambda part: part.worst_lanes(min_orders=20),
    "readout_broken_lane": lambda part: part.readout_broken_lane(min_orders=20),
}


_published: dict[tuple, SliceCube] = {}


def _cube(spark: SparkSession, sf_dir: str) -> SliceCube:
    """The cube of the line mart, published once per application and input."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _published:
        lines = star_market(tune(spark), sf_dir).dashboard_lines
        _published[key] = SliceCube.publish(lines, shared_folder(spark, "cube"))
    return _published[key]


def build_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def query(operator: Callable[[Marketplace], DataFrame]):
        return lambda spark, sf_dir: decimals_as_double(
            operator(star_market(tune(spark), sf_dir))
        )

    def cube_query(report: Callable[[Slice], DataFrame]):
        return lambda spark, sf_dir: decimals_as_double(
            report(_cube(spark, sf_dir).slice(**CUBE_FILTERS))
        )

    found = {name: query(operator) for name, operator in OPERATORS.items()}
    return found | {f"cube_{name}": cube_query(r) for name, r in CUBE_REPORTS.items()}
