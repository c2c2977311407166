"""Time the headline queries. Prints one JSON line.

The reference starts from six stored tables and from stored marts, so the star schema is
first written as those (reported apart as `setup`); the timed part is the queries.
Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from catalog.star_adapter import BROKEN_LANES, CHANGED_SINCE, star_market
from lanewise import Marketplace
from lanewise.operators import (
    cohorts,
    features,
    integrity,
    lanes,
    metrics,
    profile,
    reconcile,
    scenarios,
    slices,
)
from lanewise.plans.cube import SliceCube, cube_dashboard
from lanewise.plans.publish import publish_marts, publish_set, refresh_set
from lanewise.schemas import PROMISE_SUMMARY
from lanewise.session import build_session
from lanewise.sources.marts import shared_folder, write_mart

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def headline(m: Marketplace, lines, orders, ships) -> dict:
    """Name to a function that builds the query; marts are used where the reference does."""
    b3 = lambda n: lanes.b3_seller_carrier_city(m.orders, m.order_items, m.shipments, n)
    flags = lambda: scenarios.scenario_flags(scenarios.with_order_gmv(ships, orders))
    return {
        # on the six tables
        "profile_value_counts": lambda: profile.profile_value_counts(m.tables),
        "profile_item_describe": lambda: profile.profile_item_describe(m.items_enriched),
        "integrity_fk_orphans": lambda: integrity.integrity_fk_orphans(**m.tables),
        "order_rollup": lambda: m.order_rollup,
        "orders_enriched": lambda: m.orders_enriched,
        "dashboard_lines": lambda: m.dashboard_lines,
        "gmv_month_city_category": lambda: m.gmv_cells,
        "gmv_city_month_pivot": lambda: metrics.gmv_city_month_pivot(
            metrics.gmv_month_city(m.gmv_cells)
        ),
        "b1_city_month_metrics": lambda: metrics.b1_city_month_metrics(m.activity, m.customers),
        "b2_first_delay_repeat": lambda: cohorts.b2_first_delay_repeat(m.delivered_history),
        "b3_seller_carrier_city": lambda: b3(100),
        "b3_top_share": lambda: lanes.b3_top_share(b3(10)),
        "lane_performance": lambda: lanes.lane_performance(m.orders, m.order_items, m.shipments),
        "b4_late_orders": lambda: lanes.b4_late_orders(m.orders, m.customers, m.shipments),
        "b4_late_orders_correlated": lambda: lanes.b4_late_orders_correlated(
            m.orders, m.customers, m.shipments
        ),
        # on the marts
        "customer_first_order": lambda: features.customer_first_order(orders),
        "repeat_rate_month": lambda: metrics.repeat_rate_month(
            metrics.customer_month_activity(orders)
        ),
        "delay_city_carrier_pivot": lambda: metrics.delay_city_carrier_pivot(ships),
        "scenario_lanes": lambda: scenarios.scenario_lanes(flags()),
        "scenario_summary": lambda: scenarios.scenario_summary(flags(), BROKEN_LANES),
        "kpi_strip": lambda: slices.kpi_strip(lines),
        "trend_repeat_share": lambda: slices.trend_repeat_share(lines),
        "breakdown_gmv": lambda: slices.breakdown_gmv(lines),
        "worst_lanes": lambda: slices.worst_lanes(lines),
        "category_contribution": lambda: slices.category_contribution(lines),
        "order_outcome_mix": lambda: slices.order_outcome_mix(lines),
        "reconcile_b1_cells": lambda: reconcile.reconcile_b1_cells(
            orders, reconcile.gmv_cells_sql(m.orders, m.customers, m.order_items)
        ),
        "edge_case_counts": lambda: reconcile.edge_case_counts(orders, ships),
    }


def render(published: SliceCube) -> float:
    """Seconds for all reports of one re-render, the slice's first read included.

    The reports are independent charts, so they are drawn side by side.
    """
    filters = dict(date_from=dt.date(1995, 1, 1), date_to=dt.date(2001, 12, 31))
    start = time.perf_counter()
    flags = published.months.sparkSession.createDataFrame([], PROMISE_SUMMARY)
    with cube_dashboard(published, flags, **filters) as reports, ThreadPoolExecutor(int(CPUS)) as pool:
        list(pool.map(lambda r: r.write.format("noop").mode("overwrite").save(), reports.values()))
    return time.perf_counter() - start


def mart_set_times(m: Marketplace) -> dict[str, float]:
    """Seconds to publish all marts as a set, and to refresh it after 1 % of the orders changed."""
    root = shared_folder(m.orders.sparkSession, "bench-set")
    start = time.perf_counter()
    publish_set(m, root, BROKEN_LANES)
    published = time.perf_counter()
    changed = m.orders.where(F.col("created_at") >= F.lit(CHANGED_SINCE).cast("timestamp_ntz"))
    refresh_set(m, root, changed.select("order_id"), BROKEN_LANES)
    return {"mart_set": published - start, "mart_set_refresh": time.perf_counter() - published}


def timed(build) -> float:
    """Seconds from building the query to its last row, read and discarded by the executors."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=CPUS,
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    source = shared_folder(spark, "bench-tables")
    star = star_market(spark, SF_DIR)
    m = Marketplace(
        **{name: write_mart(df.repartition(int(CPUS)), source, name) for name, df in star.tables.items()}
    )
    tables_at = time.perf_counter()
    out = shared_folder(spark, "bench-marts")
    publish_marts(m, out, BROKEN_LANES)
    setup = {"tables": tables_at - start, "publish_marts": time.perf_counter() - tables_at}

    queries = headline(
        m,
        *[
            spark.read.parquet(f"{out}/{mart}")
            for mart in ("dashboard_lines", "orders_enriched", "shipments_enriched")
        ],
    )
    # The best of the runs: the first one of each query also compiles its code.
    seconds = {name: min(timed(build) for _ in range(RUNS)) for name, build in queries.items()}
    subtotal = sum(seconds.values())
    lines, start = spark.read.parquet(f"{out}/dashboard_lines"), time.perf_counter()
    published = SliceCube.publish(lines, out)
    seconds["publish_cube"] = time.perf_counter() - start
    seconds["dashboard_rerender"] = min(render(published) for _ in range(RUNS))
    seconds |= mart_set_times(m)
    seconds["publish_marts"] = setup.pop("publish_marts")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries_only": round(subtotal, 3),
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "setup": {name: round(value, 3) for name, value in setup.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
