"""The slice cube as published tables, and the dashboard's reports from it."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.columns import delay_band, rate
from lanewise.operators import cube, scenarios, slices
from lanewise.sources.marts import write_mart

TABLES = ("cube_bitmaps", "cube_orders", "cube_months", "cube_days")


@dataclass(frozen=True)
class SliceCube:
    """Bitmaps per dimension value, flags per bucket, and money per month and per day."""

    bitmaps: DataFrame
    orders: DataFrame
    months: DataFrame
    days: DataFrame

    @classmethod
    def publish(cls, lines: DataFrame, out_dir: str) -> SliceCube:
        """Build the cube of the line mart and write it under `out_dir`."""

        def write(name: str, df: DataFrame, *cluster_by: str) -> DataFrame:
            return write_mart(df, out_dir, name, cluster_by)

        # The lines are joined once, the orders laid out by customer once.
        stored = write("cube_lines", cube.cube_lines(lines))
        profiles = cube.order_profiles(stored, cube.line_tasks(stored.count()))
        placed = write("cube_placed", cube.in_order(profiles))
        numbered, tasks = cube.number_orders(placed), cube.bucket_tasks(placed.count())
        days = write("cube_days", cube.money_cells(stored), "day", *cube.CELL)
        return cls(
            write("cube_bitmaps", cube.dimension_bitmaps(numbered, tasks)),
            write("cube_orders", cube.order_bitmaps(numbered, tasks)),
            write("cube_months", cube.monthly(days)),
            days,
        )

    @classmethod
    def read(cls, spark: SparkSession, out_dir: str) -> SliceCube:
        return cls(*[spark.read.parquet(posixpath.join(out_dir, name)) for name in TABLES])

    def slice(self, **filters) -> Slice:
        """Frames of one slice; the filters are those of `slices.slice_lines`."""
        chosen = cube.slice_bitmaps(self.bitmaps, self.orders, **filters)
        return Slice(
            cube.slice_counts(self.bitmaps, chosen),
            cube.slice_customers(self.bitmaps, chosen),
            cube.slice_money(self.months, self.days, **filters),
        )


@dataclass(frozen=True)
class Slice:
    """What the reports of a slice need, in rows per dimension value."""

    counts: DataFrame
    customers: DataFrame
    money: DataFrame

    def _counts(self, dimension: str, *names: str) -> DataFrame:
        values = [F.col(v).alias(n) for v, n in zip(cube.KEY[1:], names)]
        kept = self.counts.where((F.col("dimension") == dimension) & (F.col("orders") > 0))
        return kept.select(*values, "orders", "evaluable", "delayed")

    def _money(self, dimension: str, name: str) -> DataFrame:
        return self.money.where(F.col("dimension") == dimension).select(F.col("value").alias(name), "gmv")

    def _delay_rates(self, dimension: str, *names: str) -> DataFrame:
        return self._counts(dimension, *names).where("evaluable > 0").select(
            *names, F.col("evaluable").alias("orders"), _delayed_rate().alias("delayed_rate")
        )

    def kpi_strip(self) -> DataFrame:
        """The headline numbers as one row; rates are null on an empty slice."""
        is_late = F.col("dimension") == "late_days"
        amounts = {"days": F.when(is_late, F.col("value")).cast("int") * F.col("delayed"), "delayed": F.col("delayed")}
        late = lambda c: F.sum(F.when(is_late, amounts[c]))
        customer = lambda group, c: F.sum(F.when(F.col("group") == group, F.col(c)))
        customers = self.customers.agg(
            F.coalesce(customer("all", "customers"), F.lit(0)).alias("n_customers"),
            rate(customer("arrived", "repeated"), customer("arrived", "customers")).alias("repeat_rate"),
        )
        money = self._money("total", "all").agg(F.coalesce(F.sum("gmv"), F.lit(0)).alias("gmv"))
        whole = lambda c: F.coalesce(F.sum(F.when(F.col("dimension") == "all", F.col(c))), F.lit(0))
        totals = self.counts.agg(
            whole("orders").alias("n_orders"),
            whole("evaluable").alias("evaluable_orders"),
            whole("delayed").alias("delayed_orders"),
            rate(late("days"), late("delayed")).alias("avg_delay_days"),
        )
        # Three frames of one row with different columns, laid over each other.
        rows = [totals, customers, money]
        merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
        one = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
        return one.select(*slices.kpi_columns())

    def trend_gmv(self) -> DataFrame:
        months = self._money("order_month", "month")
        return months.select("month", F.col("gmv").alias("value")).orderBy("month")

    def trend_orders(self) -> DataFrame:
        return self._trend(self._counts("order_month", "month"), F.col("orders"))

    def trend_delayed_rate(self) -> DataFrame:
        months = self._counts("order_month", "month").where("evaluable > 0")
        return self._trend(months, _delayed_rate())

    def trend_repeat_share(self) -> DataFrame:
        months = self.customers.where("group NOT IN ('all', 'arrived') AND customers > 0")
        share = rate(F.col("repeated"), F.col("customers"))
        return self._trend(months.withColumnRenamed("group", "month"), share)

    @staticmethod
    def _trend(months: DataFrame, value: Column) -> DataFrame:
        return months.where("month IS NOT NULL").select("month", value.alias("value")).orderBy("month")

    def breakdown_gmv(self) -> DataFrame:
        return self.money.where("dimension IN ('city', 'category', 'segment')")

    def breakdown_delay(self) -> DataFrame:
        rates = self.counts.where(
            "dimension IN ('carrier', 'ship_to_city') AND value IS NOT NULL AND evaluable > 0"
        )
        return rates.select(
            "dimension",
            "value",
            F.col("evaluable").alias("orders"),
            _delayed_rate().alias("delayed_rate"),
            delay_band(_delayed_rate()).alias("band"),
        )

    def lane_grid(self) -> DataFrame:
        rates = self._delay_rates("lane", *slices.LANE)
        return rates.where("carrier IS NOT NULL AND ship_to_city IS NOT NULL")

    def worst_lanes(self, min_orders: int = 100, k: int = 10) -> DataFrame:
        return slices.worst_of(self.lane_grid(), min_orders, k)

    def category_contribution(self) -> DataFrame:
        """A category outside the slice's categories has orders in common with it, but no money."""
        counts = self._counts("category", "category").select(
            "category", "orders", _delayed_rate().alias("delayed_rate")
        )
        joined = self._money("category", "category").join(counts, "category")
        return slices.with_share(joined.select("category", "gmv", "orders", "delayed_rate"))

    def order_outcome_mix(self) -> DataFrame:
        return slices.outcome_shares(self._counts("outcome", "outcome"))

    def readout_carrier_gap(self) -> DataFrame:
        return slices.carrier_gap(self._delay_rates("carrier", "carrier").where("carrier IS NOT NULL"))

    def readout_broken_lane(self, min_orders: int = 200) -> DataFrame:
        lanes = self._counts("lane", *slices.LANE).where("evaluable > 0")
        return slices.broken_lane(
            lanes.select(*slices.LANE, F.col("evaluable").alias("orders"), "delayed"), min_orders
        )

    def readout_top_category(self) -> DataFrame:
        return slices.top_category(self._money("category", "category"))

    def reports(self, promise_summary: DataFrame) -> dict[str, DataFrame]:
        """The same reports, by the same names, as `dashboard.reports` gives from lines."""
        kpi = self.kpi_strip()
        return {
            "kpi_strip": kpi,
            "kpi_severity": slices.kpi_severity(kpi),
            "trend_gmv": self.trend_gmv(),
            "trend_orders": self.trend_orders(),
            "trend_delayed_rate": self.trend_delayed_rate(),
            "trend_repeat_share": self.trend_repeat_share(),
            "breakdown_gmv": slices.labelled_money(self.breakdown_gmv(), "gmv"),
            "breakdown_delay": self.breakdown_delay(),
            "worst_lanes": self.worst_lanes(),
            "lane_grid": self.lane_grid(),
            "category_contribution": self.category_contribution(),
            "order_outcome_mix": self.order_outcome_mix(),
            "readout_carrier_gap": self.readout_carrier_gap(),
            "readout_broken_lane": self.readout_broken_lane(),
            "readout_top_category": self.readout_top_category(),
            "readout_definition_lever": scenarios.readout_definition_lever(promise_summary),
        }


def _delayed_rate() -> Column:
    return rate(F.col("delayed"), F.col("evaluable"))


@contextmanager
def cube_dashboard(
    published: SliceCube, promise_summary: DataFrame, **filters
) -> Iterator[dict[str, DataFrame]]:
    """Reports by name over one slice of the cube, whose small frames stay persisted.

    They have a row per dimension value, so one partition each serves all reports. They are
    computed side by side: each is a small job of its own.
    """
    chosen = cube.slice_bitmaps(published.bitmaps, published.orders, **filters)
    chosen = chosen.persist(StorageLevel.MEMORY_AND_DISK)
    frames = [
        frame.coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
        for frame in (
            cube.slice_counts(published.bitmaps, chosen),
            cube.slice_customers(published.bitmaps, chosen),
            cube.slice_money(published.months, published.days, **filters),
        )
    ]
    try:
        with ThreadPoolExecutor(len(frames)) as pool:
            list(pool.map(DataFrame.count, frames))
        yield Slice(*frames).reports(promise_summary)
    finally:
        for frame in (*frames, chosen):
            frame.unpersist()
