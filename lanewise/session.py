"""Session defaults for running the operators outside a managed cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does the physical tuning: small shuffles are coalesced, a join
# side is broadcast only once its measured size is under the threshold, and a join
# partition that is far above the median is split. The split is forced also where an
# aggregation after the join would have used the join's partitioning; the extra shuffle
# is then added only when a partition is in fact skewed.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
STATIC = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Recording a call site for every column expression costs several JVM round trips.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "lanewise", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = RUNTIME | STATIC | {key.replace("__", "."): v for key, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was built elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark
