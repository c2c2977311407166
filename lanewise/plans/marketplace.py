"""The six source tables as one object, with the shared intermediate frames."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lanewise.operators import cohorts, features, metrics, scenarios
from lanewise.schemas import TABLES, require_columns
from lanewise.session import tune
from lanewise.sources.readers import read_tables


@dataclass(frozen=True)
class Marketplace:
    """Lazy bundle: nothing here runs a job, every property only extends a plan.

    Each property is the narrowest frame its reports need. Catalyst does not drop an outer
    join whose columns go unused, so a report that reads the full order mart would also
    pay for the joins it has no use for.
    """

    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    shipments: DataFrame

    def __post_init__(self) -> None:
        for name, schema in TABLES.items():
            require_columns(getattr(self, name), schema.names, name)

    @classmethod
    def read(cls, spark: SparkSession, root: str, fmt: str = "parquet", **options) -> Marketplace:
        """Tables as `read_tables` reads them, in a session set up for hot keys."""
        return cls(**read_tables(tune(spark), root, fmt, **options))

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    # marts

    @cached_property
    def items_enriched(self) -> DataFrame:
        return features.items_enriched(self.order_items)

    @cached_property
    def shipments_enriched(self) -> DataFrame:
        return features.shipments_enriched(self.shipments, self.orders)

    @cached_property
    def order_rollup(self) -> DataFrame:
        return features.order_rollup(self.items_enriched)

    @cached_property
    def order_facts(self) -> DataFrame:
        return features.order_facts(self.orders, self.customers, self.shipments)

    @cached_property
    def orders_enriched(self) -> DataFrame:
        return features.orders_enriched(self.order_facts, self.order_rollup)

    @cached_property
    def customer_first_order(self) -> DataFrame:
        return features.customer_first_order(self.orders_shipped)

    @cached_property
    def dashboard_lines(self) -> DataFrame:
        return features.dashboard_lines(self.items_enriched, self.products, self.order_facts)

    # narrow frames

    @cached_property
    def orders_shipped(self) -> DataFrame:
        """Orders with their shipment's delivery columns, without customer columns."""
        return features.with_delivery(self.orders, self.shipments)

    @cached_property
    def orders_city(self) -> DataFrame:
        """Orders with customer city and order month."""
        return features.with_city(self.orders, self.customers)

    @cached_property
    def orders_gmv(self) -> DataFrame:
        return features.orders_with_gmv(self.orders, self.order_items)

    @cached_property
    def gmv_cells(self) -> DataFrame:
        return metrics.gmv_month_city_category(
            self.items_enriched, self.orders_city, self.products
        )

    @cached_property
    def activity(self) -> DataFrame:
        """Customer-month activity with GMV."""
        return metrics.customer_month_activity(
            features.with_delivery(self.orders_gmv, self.shipments)
        )

    @cached_property
    def shipments_timed(self) -> DataFrame:
        """Shipments with days against the promise."""
        return scenarios.with_delay_days(self.shipments, self.orders)

    @cached_property
    def scenario_flags(self) -> DataFrame:
        return scenarios.scenario_flags(
            scenarios.with_delay_days(self.shipments, self.orders_gmv)
        )

    @cached_property
    def delivered_history(self) -> DataFrame:
        return cohorts.delivered_history(self.orders, self.shipments)
