"""Results on data where single keys hold a third of the rows, and plan shapes that cope."""

import contextlib
import os

import duckdb
import pytest

import check_oracle
from catalog.oracle import build_oracle
from catalog.spark_queries import build_queries
from catalog.star_adapter import star_market
from lanewise.operators import cohorts, metrics

QUERIES = build_queries()
ORACLE = build_oracle()
AFFECTED = [
    "integrity_fk_orphans",
    "order_rollup",
    "orders_enriched",
    "customer_first_order",
    "gmv_month_city_category",
    "orders_active_month",
    "repeat_rate_month",
    "b1_city_month_metrics",
    "b2_first_delay_repeat",
    "b2_sensitivity",
    "b3_min_10",
    "b4_equivalence",
    "lane_seller_mix",
    "scenario_lanes",
    "kpi_strip",
    "category_contribution",
    "trend_repeat_share",
    "money_label",
    "profile_item_describe",
]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory, sf001):
    """A copy of the tables with one hot customer, order, product and seller."""
    out = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    changes = {
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
        "lineitem": "* EXCLUDE (rn) REPLACE ("
        "CASE WHEN rn % 3 = 0 THEN 11 ELSE l_orderkey END AS l_orderkey,"
        "CASE WHEN rn % 3 = 1 THEN 9 ELSE l_partkey END AS l_partkey,"
        "CASE WHEN rn % 3 = 2 THEN 5 ELSE l_suppkey END AS l_suppkey)",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        columns = changes.get(name, "*")
        source = f"'{sf001}/{name}.parquet'"
        if name == "lineitem":
            source = f"(SELECT *, row_number() OVER () AS rn FROM {source})"
        con.execute(f"COPY (SELECT {columns} FROM {source}) TO '{out}/{name}.parquet'")
    return out


@contextlib.contextmanager
def settings(spark, **values):
    keys = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@pytest.mark.parametrize("name", AFFECTED)
def test_hot_keys_agree_with_duckdb(spark, hot_dir, name):
    """With joins shuffled and the skew split set to act on these small sizes."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
    ):
        duck = check_oracle.connect(hot_dir)
        ok, note = check_oracle.compare(spark, duck, name, hot_dir, QUERIES, ORACLE)
    assert ok, note


@pytest.mark.parametrize("name", ["b1_city_month_metrics", "b2_first_delay_repeat", "kpi_strip"])
@pytest.mark.parametrize("partitions", ["1", "8", "200"])
def test_shuffle_partitions_do_not_matter(spark, sf001, name, partitions):
    duck = check_oracle.connect(sf001)
    with settings(spark, spark__sql__shuffle__partitions=partitions):
        ok, note = check_oracle.compare(spark, duck, name, sf001, QUERIES, ORACLE)
    assert ok, note


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customer_ranks_are_cut_before_the_shuffle(spark, sf001):
    m = star_market(spark, sf001)
    for df in (m.customer_first_order, cohorts.first_and_next(m.delivered_history)):
        lines = plan_of(df).splitlines()
        partial = next(i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l)
        assert any("Exchange hashpartitioning(customer_id" in l for l in lines[:partial])


def test_city_is_joined_after_the_orders_are_summed(spark, sf001):
    m = star_market(spark, sf001)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(metrics.b1_city_month_metrics(m.activity, m.customers))
    join = plan.index("SortMergeJoin [customer_id")
    summed = plan.index("HashAggregate(keys=[customer_id")
    assert join < summed


def test_both_sides_of_the_line_join_have_their_own_shuffle(spark, sf001):
    """The runtime splits a skewed partition only where a join reads two shuffles."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(star_market(spark, sf001).dashboard_lines)
    exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning(order_id" in l]
    assert sum("order_hash" in line for line in exchanges) == 2


def test_date_filter_reaches_the_scan(spark, sf001):
    from catalog.spark_queries import OPERATORS

    plan = plan_of(OPERATORS["slice_lines"](star_market(spark, sf001)))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan


def test_no_plan_has_a_cross_join_or_python(spark, sf001):
    bad = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython")
    for name, query in QUERIES.items():
        if name == "publish_marts":
            continue
        plan = plan_of(query(spark, sf001))
        assert not [word for word in bad if word in plan], name


#: Files that bring rows to the driver: pivots and ranks of quantiles, the values of a pivot's
#: column. Their numbers do not grow with the rows.
BOUNDED = ("quantiles.py", "reshape.py")


def test_repository_sources_keep_to_the_rules():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("lanewise", "catalog"):
        for path, folders, files in os.walk(os.path.join(root, folder)):
            folders[:] = [name for name in folders if name != "llm"]  # which has its own tests
            for file in files:
                if file.endswith(".py"):
                    text = open(os.path.join(path, file)).read()
                    for word in (".collect(", ".toPandas(", "localCheckpoint", ".crossJoin("):
                        allowed = word == ".collect(" and file in BOUNDED
                        assert allowed or word not in text, f"{file}: {word}"
