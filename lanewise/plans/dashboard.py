"""All reports of one filtered slice, with the slice read once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from lanewise.operators import scenarios, slices


def reports(lines: DataFrame, orders: DataFrame, promise_summary: DataFrame) -> dict[str, DataFrame]:
    """Reports by name, from the lines of a slice and the same slice with one line per order."""
    kpi = slices.kpi_strip(orders)
    return {
        "kpi_strip": kpi,
        "kpi_severity": slices.kpi_severity(kpi),
        "trend_gmv": slices.trend_gmv(orders),
        "trend_orders": slices.trend_orders(orders),
        "trend_delayed_rate": slices.trend_delayed_rate(orders),
        "trend_repeat_share": slices.trend_repeat_share(orders),
        "breakdown_gmv": slices.labelled_money(slices.breakdown_gmv(lines), "gmv"),
        "breakdown_delay": slices.breakdown_delay(orders),
        "worst_lanes": slices.worst_lanes(orders),
        "lane_grid": slices.lane_grid(orders),
        "category_contribution": slices.category_contribution(lines),
        "order_outcome_mix": slices.order_outcome_mix(orders),
        "readout_carrier_gap": slices.readout_carrier_gap(orders),
        "readout_broken_lane": slices.readout_broken_lane(orders),
        "readout_top_category": slices.readout_top_category(lines),
        "readout_definition_lever": scenarios.readout_definition_lever(promise_summary),
    }


@contextmanager
def dashboard(
    lines: DataFrame, promise_summary: DataFrame, **filters
) -> Iterator[dict[str, DataFrame]]:
    """Reports by name, over a slice that stays persisted until the block ends.

    Kept on memory and disk are the slice's lines, for what is told apart by category, and
    its orders, for all else. Blocks lost with an executor are read again from `lines`.
    `filters` are those of `slices.slice_lines`.
    """
    part = slices.slice_lines(lines, **filters).persist(StorageLevel.MEMORY_AND_DISK)
    orders = slices.order_lines(part).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield reports(part, orders, promise_summary)
    finally:
        orders.unpersist()
        part.unpersist()
