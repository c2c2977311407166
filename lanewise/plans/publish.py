"""Build and write all marts, each from the ones already written; refresh a published set."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import days_between, month_text, not_on_time
from lanewise.functions.reshape import few_rows
from lanewise.operators import cohorts, features, lanes, metrics, scenarios
from lanewise.plans.mart_set import NO_PART, PART, MartSet, MartSetWriter
from lanewise.plans.marketplace import Marketplace
from lanewise.sources.marts import manifest, shared_folder, write_mart

MARTS = (
    "items_enriched",
    "shipments_enriched",
    "orders_enriched",
    "customer_first_order",
    "dashboard_lines",
    "b1_monthly_city_metrics",
    "b2_first_order_delay_repeat",
    "b3_seller_carrier_city",
    "b3_seller_carrier_city_relaxed",
    "b3_lane_carrier_city",
    "q4_lane_scenarios",
    "q4_marketplace_summary",
)


#: Published beside the marts in a set: what a refresh adds to, without reading all orders.
SUMS = (
    "customer_activity",
    "customer_firsts",
    "b1_sums",
    "b3_sums",
    "lane_sums",
    "scenario_sums",
)
#: The columns of the order mart that the tables with rows per customer are built from.
CUSTOMERS_ORDERS = (
    "customer_id",
    "order_id",
    "created_at",
    "delivered_at",
    "delivery_status",
    "is_delayed",
    "order_gmv",
)
#: Range keys of the order-time marts. The further ones split an instant that very many orders
#: share, and an order that has very many lines.
BY_TIME = ("created_at", "order_id")
BY_LINE = (*BY_TIME, "product_id", "seller_id")


def publish_marts(
    market: Marketplace,
    out_dir: str,
    target_lanes: list[tuple[str, str]],
    min_orders: int = 100,
    min_orders_relaxed: int = 30,
) -> DataFrame:
    """Write every mart under `out_dir`, in place of an earlier one, and return the manifest.

    The two order-time marts are clustered by creation time, the column that slices filter on.
    """

    def write(name: str, df: DataFrame, cluster_by: tuple[str, ...] = ()) -> DataFrame:
        return write_mart(df, out_dir, name, cluster_by)

    m = market
    items = write("items_enriched", m.items_enriched)
    ships = write("shipments_enriched", m.shipments_enriched)
    facts = features.order_facts(m.orders, m.customers, m.shipments)
    orders = write(
        "orders_enriched",
        features.orders_enriched(facts, features.order_rollup(items)),
        BY_TIME,
    )
    write("customer_first_order", features.customer_first_order(orders))
    write("dashboard_lines", features.dashboard_lines(items, m.products, orders), BY_LINE)

    activity = metrics.customer_month_activity(orders)
    write("b1_monthly_city_metrics", metrics.b1_city_month_metrics(activity, m.customers))
    write(
        "b2_first_order_delay_repeat",
        cohorts.b2_first_delay_repeat(cohorts.history_of_mart(orders)),
    )
    # Built once, for the lower threshold; the stricter mart is a filter on it as written.
    thresholds = {
        "b3_seller_carrier_city": min_orders,
        "b3_seller_carrier_city_relaxed": min_orders_relaxed,
    }
    first, second = sorted(thresholds, key=thresholds.get)
    combinations = write(
        first,
        lanes.b3_seller_carrier_city(m.orders, items, m.shipments, thresholds[first]),
    )
    write(second, combinations.where(F.col("delivered_orders") >= thresholds[second]))
    write("b3_lane_carrier_city", lanes.lane_performance(m.orders, items, m.shipments))

    flags = scenarios.scenario_flags(scenarios.with_order_gmv(ships, orders))
    # Read by two marts, and no mart itself.
    flags = write_mart(flags, shared_folder(m.orders.sparkSession, "publish"), "scenario_flags")
    write("q4_lane_scenarios", scenarios.scenario_lanes(flags))
    write("q4_marketplace_summary", scenarios.scenario_summary(flags, target_lanes))
    return manifest(m.orders.sparkSession, out_dir, MARTS)


# sets --------------------------------------------------------------------------------


def _order_marts(
    m: Marketplace, write: Callable[..., DataFrame], store: Callable[..., DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marts with rows per item, shipment, order and line, in parts by order month.

    An item or shipment without an order has no month. Returns the orders, the sellers' shares
    of them, which are no mart, and the lines, which are left to be written beside the tables
    that are not built from them. What does not wait for the items is built beside them.
    """
    months = m.orders.select("order_id", month_text(F.col("created_at")).alias(PART))
    month = F.col("order_month").alias(PART)
    ships = m.shipments_enriched.join(months, "order_id", "left")
    items = m.order_items.join(months, "order_id", "left")
    with ThreadPoolExecutor(1) as beside:
        done = beside.submit(write, "shipments_enriched", ships)
        items = write("items_enriched", items, finish=features.items_enriched)
        sellers = store("order_sellers", lanes.seller_orders(items))
        rollup = store("order_rollup", features.order_rollup_of(items, sellers))
        done.result()
    facts = features.order_facts(m.orders, m.customers, m.shipments)
    orders = features.orders_enriched(facts, rollup)
    orders = write("orders_enriched", orders.select("*", month), BY_TIME)
    lines = features.dashboard_lines(items, m.products, orders)
    return orders, sellers, lines.select("*", month)


def _outcomes(orders: DataFrame, ships: DataFrame) -> DataFrame:
    """Shipments with what the sums need of their orders, from one join."""
    known = orders.select("order_id", "promised_delivery_date", "order_gmv", F.lit(True).alias("known"))
    return ships.join(known, "order_id", "left").select(
        "shipment_id",
        "order_id",
        *lanes.LANE,
        "delivery_status",
        "delivery_delay_days",
        "order_gmv",
        not_on_time(F.col("delivery_status")).alias("late"),
        days_between(F.col("delivered_at"), F.col("promised_delivery_date")).alias("days"),
        (F.col("known") & F.col("delivered_at").isNotNull()).alias("delivered"),
    )


def _order_sums(outcomes: DataFrame, sellers: DataFrame) -> dict[str, DataFrame]:
    """The sums over orders, from all orders' shipments and sellers or from some of them."""
    delivered = outcomes.where("delivered").select(
        "order_id", *lanes.LANE, "late", "days", F.col("order_gmv").alias("gmv")
    )
    return {
        "b3_sums": lanes.b3_sums_of(sellers, delivered.drop("gmv")),
        "lane_sums": lanes.lane_sums_of(delivered),
        "scenario_sums": scenarios.scenario_sums(scenarios.scenario_flags(outcomes)),
    }


def _customer_tables(orders: DataFrame) -> dict[str, DataFrame]:
    """The tables with rows per customer, from all orders of the customers."""
    return {
        "customer_first_order": features.customer_first_order(orders),
        "customer_activity": metrics.customer_month_activity(orders),
        "customer_firsts": cohorts.first_and_next(cohorts.history_of_mart(orders)),
    }


def _reports(
    tables: dict[str, DataFrame], target_lanes: list[tuple[str, str]], min_orders: int, relaxed: int
) -> dict[str, DataFrame]:
    """The marts that are reports, from the sums and the customers' first events."""
    last_event = tables["orders_enriched"].agg(F.max("delivered_at")).scalar()
    members = cohorts.members_of(tables["customer_firsts"], last_event)
    return {
        "b1_monthly_city_metrics": metrics.b1_of_sums(tables["b1_sums"]),
        "b2_first_order_delay_repeat": cohorts.b2_of_members(members),
        "b3_seller_carrier_city": lanes.b3_of_sums(tables["b3_sums"], min_orders),
        "b3_seller_carrier_city_relaxed": lanes.b3_of_sums(tables["b3_sums"], relaxed),
        "b3_lane_carrier_city": lanes.lanes_of_sums(tables["lane_sums"]),
        "q4_lane_scenarios": scenarios.lanes_of_sums(tables["scenario_sums"]),
        "q4_marketplace_summary": scenarios.summary_of_sums(tables["scenario_sums"], target_lanes),
    }


def publish_set(
    market: Marketplace,
    root: str,
    target_lanes: list[tuple[str, str]],
    min_orders: int = 100,
    min_orders_relaxed: int = 30,
) -> MartSet:
    """Build all marts and publish them under `root` as one set.

    Readers keep the set that they have resolved until they resolve the pointer again.
    """
    out = MartSetWriter(market.orders.sparkSession, root)
    scratch = shared_folder(out.spark, "publish")
    tables: dict[str, DataFrame] = {}

    def write(name: str, df: DataFrame, *layout: Any, **more: Any) -> DataFrame:
        tables[name] = out.write(name, df, *layout, **more)
        return tables[name]

    def store(name: str, df: DataFrame) -> DataFrame:
        return write_mart(df, scratch, name)

    orders, sellers, lines = _order_marts(market, write, store)
    sums = _order_sums(store("outcomes", _outcomes(orders, tables["shipments_enriched"])), sellers)
    independent = {"dashboard_lines": lines} | sums | _customer_tables(orders)
    tables |= out.write_all(independent, {"dashboard_lines": BY_LINE})
    write("b1_sums", metrics.b1_sums(tables["customer_activity"], market.customers))
    out.write_all(_reports(tables, target_lanes, min_orders, min_orders_relaxed))
    return out.publish()


def _merged(
    old: DataFrame, removed: DataFrame, added: DataFrame, keys: tuple[str, ...], count: str
) -> DataFrame:
    """Sums after taking out and adding some rows' sums; groups without rows left are gone."""
    sums = [c for c in old.columns if c not in keys]
    negative = removed.select(*keys, *[(-F.col(c)).alias(c) for c in sums])
    parts = old.unionByName(negative).unionByName(added)
    kept = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(count) > 0)
    return kept.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def _of_customers(df: DataFrame, customers: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by customer; no customer is a customer like any other."""
    same = F.col("d.customer_id").eqNullSafe(F.col("c.customer_id"))
    return df.alias("d").join(customers.alias("c"), same, how)


def refresh_set(
    market: Marketplace,
    root: str,
    changed_orders: DataFrame,
    target_lanes: list[tuple[str, str]],
    min_orders: int = 100,
    min_orders_relaxed: int = 30,
) -> MartSet:
    """Publish the set that `market` gives, from the current one and the orders that changed.

    `changed_orders` has the `order_id` of every order whose own row, items or shipments were
    added, changed or removed since. Of the marts with rows per order only the months of these
    orders are written anew; the rows of other orders in them are copied, not computed. Rows
    per customer are computed for the customers of changed orders only. Sums lose what these
    orders or customers had added and gain what they add now. The new manifest takes over the
    parts of all other months as they are.

    A change of a customer or product changes orders too: their orders belong in the list.
    Thresholds and lanes may differ from those of the current set.
    """
    spark, key = market.orders.sparkSession, "order_id"
    old, out = MartSet.current(spark, root), MartSetWriter(spark, root)
    scratch = shared_folder(spark, "refresh")
    changed = write_mart(changed_orders.select(key).distinct(), scratch, "changed")

    def changed_in(df: DataFrame, name: str) -> DataFrame:
        return write_mart(df.join(changed, key, "left_semi"), scratch, name)

    before = changed_in(old.table("orders_enriched"), "orders_before")
    part = replace(
        market,
        orders=changed_in(market.orders, "orders"),
        order_items=changed_in(market.order_items, "order_items"),
        shipments=changed_in(market.shipments, "shipments"),
    )
    month = month_text(F.col("created_at")).alias(PART)
    months = before.select(month).union(part.orders.select(month)).distinct()
    # One row per month. Items and shipments without an order may have got one.
    touched = {row[0] for row in few_rows(months) if row[0]} | {NO_PART}

    removed: dict[str, DataFrame] = {}
    added: dict[str, DataFrame] = {}

    def write_touched(
        name: str,
        df: DataFrame,
        cluster_by: tuple[str, ...] = (),
        finish: Callable[[DataFrame], DataFrame] = lambda df: df,
    ) -> DataFrame:
        df = finish(df)
        now = write_mart(df, scratch, name)
        there = old.table(name, touched, with_part=True)
        out.keep(e for e in old.entries_of(name) if e.part not in touched)
        kept = there.join(changed, key, "left_anti").select(*df.columns)
        out.write(name, kept.unionByName(now), cluster_by)
        removed[name] = there.join(changed, key, "left_semi").drop(PART)
        added[name] = now.drop(PART)
        return added[name]

    def store(name: str, df: DataFrame) -> DataFrame:
        return write_mart(df, scratch, name)

    orders, sellers, lines = _order_marts(part, write_touched, store)
    write_touched("dashboard_lines", lines, BY_LINE)
    tables = {"orders_enriched": out.table("orders_enriched")}

    customers = before.select("customer_id").union(part.orders.select("customer_id")).distinct()
    customers = write_mart(customers, scratch, "customers")
    theirs = _of_customers(tables["orders_enriched"], customers, "left_semi")
    # Read by three tables.
    theirs = store("orders_of_customers", theirs.select(*CUSTOMERS_ORDERS))
    for name, df in _customer_tables(theirs).items():
        added[name] = write_mart(df, scratch, name)
        removed[name] = _of_customers(old.table(name), customers, "left_semi")
        kept = _of_customers(old.table(name), customers, "left_anti")
        tables[name] = kept.unionByName(added[name])

    sums = []
    no_more = lanes.seller_orders(removed["items_enriched"])
    for side, rows, shares in ((removed, before, no_more), (added, orders, sellers)):
        b1 = {"b1_sums": metrics.b1_sums(side["customer_activity"], market.customers)}
        sums.append(b1 | _order_sums(_outcomes(rows, side["shipments_enriched"]), shares))
    groups = {
        "b1_sums": (("month", "city"), "unique_customers"),
        "b3_sums": (lanes.COMBO, "delivered_orders"),
        "lane_sums": (lanes.LANE, "delivered_orders"),
        "scenario_sums": (scenarios.LANE, "shipments"),
    }
    for name, (keys, count) in groups.items():
        tables[name] = _merged(old.table(name), sums[0][name], sums[1][name], keys, count)
    tables |= out.write_all({n: df for n, df in tables.items() if n != "orders_enriched"})
    out.write_all(_reports(tables, target_lanes, min_orders, min_orders_relaxed))
    return out.publish()
