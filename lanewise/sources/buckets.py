"""Marts bucketed by a key, so that joins and sums on it need no exchange."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.reshape import few_rows

#: Bytes that one bucket of the largest mart holds, about; a bucket is written and read by one task.
BUCKET_BYTES = 128 << 20
#: Bytes of a mart in motion for a byte of its source files, about: files are encoded by column,
#: and marts have columns that are computed from others.
MOVED = 8
MANIFEST = (
    T.StructType()
    .add("name", "string")
    .add("folder", "string")
    .add("key", "string")
    .add("buckets", "integer")
    .add("schema", "string")
)


def buckets_for(size_bytes: int, at_least: int) -> int:
    """A power of two, so that marts of other sizes divide evenly."""
    wanted = max(at_least, -(-size_bytes // BUCKET_BYTES))
    return 1 << (wanted - 1).bit_length()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, from their listing; nothing is computed."""
    files = [unquote(path) for path in df.inputFiles()]
    if not files:
        return 0
    listed = df.sparkSession.read.format("binaryFile").load(files)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class BucketedMarts:
    """Tables that are bucketed and sorted by one key, all with the same number of buckets.

    A table's layout lives in the catalog. The manifest beside the files keeps key and number,
    so that any session can put the tables in its catalog again.
    """

    tables: Mapping[str, str]
    spark: SparkSession

    @classmethod
    def write(
        cls, marts: Mapping[str, DataFrame], out_dir: str, key: str, buckets: int
    ) -> BucketedMarts:
        """Write the marts by `key`. The rows of one key are in one bucket, however many.

        There are at least `buckets`, and more where the files that a mart is made from are
        large, so that a bucket stays of one size while the marts grow.
        """
        spark = next(iter(marts.values())).sparkSession
        buckets = buckets_for(MOVED * max(input_bytes(df) for df in marts.values()), buckets)
        rows = []
        for name, df in marts.items():
            folder = posixpath.join(out_dir, name)
            table = f"{_word(name)}_{uuid.uuid4().hex}"
            # Dealt by the hash that buckets go by: each task writes one file of one bucket.
            dealt = df.repartition(buckets, key)
            dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(table)
            rows.append((name, folder, key, buckets, df.schema.json(), table))
        manifest = spark.createDataFrame([row[:5] for row in rows], MANIFEST)
        manifest.coalesce(1).write.parquet(posixpath.join(out_dir, "buckets"))
        return cls({row[0]: row[5] for row in rows}, spark)

    @classmethod
    def open(cls, spark: SparkSession, out_dir: str) -> BucketedMarts:
        """Put tables that another session has written into this session's catalog."""
        tables = {}
        for r in few_rows(spark.read.schema(MANIFEST).parquet(posixpath.join(out_dir, "buckets"))):
            table = f"{_word(r['name'])}_{uuid.uuid4().hex}"
            fields = T.StructType.fromJson(json.loads(r["schema"]))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{r['key']}`)"
                f" SORTED BY (`{r['key']}`) INTO {r['buckets']} BUCKETS LOCATION '{r['folder']}'"
            )
            tables[r["name"]] = table
        return cls(tables, spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])


def _word(name: str) -> str:
    return re.sub(r"\W", "_", name)
