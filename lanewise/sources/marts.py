"""Published marts: parquet tables under one folder, and their manifest."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's checkpoint folder, so that every executor sees it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return posixpath.join(root, f"{purpose}-{uuid.uuid4().hex}")


def write_mart(
    df: DataFrame, out_dir: str, name: str, cluster_by: Iterable[str] = ()
) -> DataFrame:
    """Overwrite `<out_dir>/<name>` and return the table as read back.

    With `cluster_by` the files hold disjoint ranges of those columns, which lets a range
    filter skip files by their parquet statistics. Reading back cuts the lineage: a lost
    executor costs a re-read, not the whole upstream plan.
    """
    keys = list(cluster_by)
    path = posixpath.join(out_dir, name)
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    laid_out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_on_storage(spark: SparkSession, path: str) -> int:
    """Bytes of the parquet files under a folder, from their listing; nothing is read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup=True)
    return files.load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def manifest(spark: SparkSession, out_dir: str, names: Iterable[str]) -> DataFrame:
    """`(name, n_rows, n_cols, size_bytes)` of the marts written to `out_dir`."""
    parts = []
    for name in names:
        path = posixpath.join(out_dir, name)
        mart = spark.read.parquet(path)
        parts.append(
            mart.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("name"),
                "n_rows",
                F.lit(len(mart.columns)).alias("n_cols"),
                F.lit(size_on_storage(spark, path)).cast("long").alias("size_bytes"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
