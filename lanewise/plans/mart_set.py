"""Marts published as one set: version folders, a manifest, and a pointer that is written last.

A set is a list of parts, each a folder of parquet files with its rows, bytes and content
hash. A publish writes new folders only, then its manifest, then one row to the log of
pointers, which a committed file makes visible at once. A reader that has resolved the pointer
keeps its set, whatever is published meanwhile; a publish that breaks off leaves folders that
nothing points to. A refresh takes over the parts that it does not change.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.content import hash_sum, row_hash, total
from lanewise.functions.reshape import few_rows
from lanewise.sources.readers import read_optional

PART = "part"
#: The part of rows that have no value to be parted by.
NO_PART = "none"
#: Jobs submitted at a time where marts do not depend on each other.
SIDE_BY_SIDE = 4

POINTER = T.StructType().add("sequence", "long").add("folder", "string")
MANIFEST = (
    T.StructType()
    .add("name", "string")
    .add("part", "string")
    .add("folder", "string")
    .add("schema", "string")
    .add("n_rows", "long")
    .add("size_bytes", "long")
    .add("content", "decimal(38,0)")
)


class Entry(NamedTuple):
    """A part of a mart as the manifest lists it."""

    name: str
    part: str
    folder: str
    schema: str
    n_rows: int
    size_bytes: int
    content: object


class PublishConflict(RuntimeError):
    """Somebody else published the same sequence number first."""


@dataclass(frozen=True)
class MartSet:
    """One published set, as the pointer named it when it was resolved."""

    spark: SparkSession
    root: str
    sequence: int
    entries: tuple[Entry, ...]

    @classmethod
    def current(cls, spark: SparkSession, root: str) -> MartSet:
        sequence, folder = _pointer(spark, root)
        if folder is None:
            raise ValueError(f"{root}: nothing is published")
        # One row per mart and part.
        rows = few_rows(spark.read.schema(MANIFEST).parquet(posixpath.join(folder, "manifest")))
        return cls(spark, root, sequence, tuple(Entry(*row) for row in rows))

    def entries_of(self, name: str, parts: Iterable[str] | None = None) -> list[Entry]:
        found = [e for e in self.entries if e.name == name]
        if not found:
            raise ValueError(f"{self.root}: no mart {name}")
        wanted = None if parts is None else set(parts)
        return [e for e in found if wanted is None or e.part in wanted]

    def table(
        self, name: str, parts: Iterable[str] | None = None, with_part: bool = False
    ) -> DataFrame:
        """The mart, or only the named parts of it, on demand with the column `part`."""
        schema = T.StructType.fromJson(json.loads(self.entries_of(name)[0].schema))
        folders: dict[str, list[str]] = {}
        for e in self.entries_of(name, parts):
            if e.n_rows:
                folders.setdefault(posixpath.dirname(e.folder), []).append(e.folder)
        if not with_part:
            paths = [path for group in folders.values() for path in group]
            return _read(self.spark, schema, paths)
        schema = schema.add(PART, "string")
        frames = [
            self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            for base, paths in folders.items()
        ]
        return reduce(DataFrame.unionByName, frames or [self.spark.createDataFrame([], schema)])

    def listing(self) -> DataFrame:
        """`name, n_rows, n_cols, size_bytes, content_hash` per mart."""
        listed = []
        for name in dict.fromkeys(e.name for e in self.entries):
            parts = self.entries_of(name)
            columns = len(json.loads(parts[0].schema)["fields"])
            content = str(sum(int(e.content) for e in parts))
            listed.append(
                (name, sum(e.n_rows for e in parts), columns, sum(e.size_bytes for e in parts), content)
            )
        return self.spark.createDataFrame(
            listed, "name string, n_rows long, n_cols int, size_bytes long, content_hash string"
        )


class MartSetWriter:
    """Collects the marts of a new set and publishes them together.

    A written mart is read for its manifest entries while the next ones are built.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.sequence = _pointer(spark, root)[0] + 1
        self.folder = posixpath.join(root, "sets", f"{self.sequence:08}-{uuid.uuid4().hex[:12]}")
        self._found: list[Future | list[Entry]] = []
        self._readers = ThreadPoolExecutor(SIDE_BY_SIDE)

    @property
    def entries(self) -> list[Entry]:
        """Of all marts so far; waits for those that are still read."""
        found = [f.result() if isinstance(f, Future) else f for f in list(self._found)]
        return [entry for some in found for entry in some]

    def write(
        self,
        name: str,
        df: DataFrame,
        cluster_by: Iterable[str] = (),
        finish: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Write a mart to the new set and return it as read back.

        A column `part`, where there is one, names the folder of each row and is no column
        of the mart. Within it the files hold ranges of the columns to cluster by; rows that are
        close by these are to have the same part. Without such columns rows are dealt by part,
        and the runtime splits a part of many rows: ranges would need a sample, for which all
        that leads to the rows is computed once more. `finish` adds columns to the rows as dealt,
        so that these are not moved.
        """
        path, parted = posixpath.join(self.folder, name), PART in df.columns
        if parted:
            df = df.withColumn(PART, F.coalesce(F.col(PART), F.lit(NO_PART)))
        if keys := list(cluster_by):
            df = df.repartitionByRange(*keys).sortWithinPartitions(*([PART] if parted else []), *keys)
        elif parted:
            df = df.hint("rebalance", PART)
        df = finish(df) if finish else df
        schema = T.StructType([f for f in df.schema.fields if f.name != PART])
        (df.write.partitionBy(PART) if parted else df.write).parquet(path)
        self._found.append(self._readers.submit(_parts, self.spark, path, name, schema, parted))
        return _read(self.spark, schema, [path])

    def write_all(
        self, frames: dict[str, DataFrame], cluster_by: dict[str, tuple[str, ...]] | None = None
    ) -> dict[str, DataFrame]:
        """Write several marts, none of which is built from another, side by side."""
        keys = [(cluster_by or {}).get(name, ()) for name in frames]
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            return dict(zip(frames, pool.map(self.write, frames, frames.values(), keys)))

    def keep(self, entries: Iterable[Entry]) -> None:
        """Take over parts of an earlier set."""
        self._found.append(list(entries))

    def table(self, name: str) -> DataFrame:
        """A mart of the new set, with the parts that were taken over."""
        return MartSet(self.spark, self.root, self.sequence, tuple(self.entries)).table(name)

    def publish(self) -> MartSet:
        entries = tuple(sorted(self.entries, key=lambda e: (e.name, e.part, e.folder)))
        self._readers.shutdown()
        manifest = self.spark.createDataFrame([tuple(e) for e in entries], MANIFEST)
        manifest.coalesce(1).write.parquet(posixpath.join(self.folder, "manifest"))
        row = self.spark.createDataFrame([(self.sequence, self.folder)], POINTER)
        row.coalesce(1).write.mode("append").parquet(posixpath.join(self.root, "pointers"))
        # Of two publishes with one number the first by name counts, for every reader.
        if _pointer(self.spark, self.root, self.sequence)[1] != self.folder:
            raise PublishConflict(self.folder)
        return MartSet(self.spark, self.root, self.sequence, entries)


def _read(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    # The name of a part's folder would come as a column.
    return spark.read.schema(schema).parquet(*paths).select(*schema.names)


def _pointer(spark: SparkSession, root: str, sequence: int | None = None) -> tuple[int, str | None]:
    """Sequence and folder of the latest publish, or of the given one."""
    log = read_optional(spark, posixpath.join(root, "pointers"), POINTER)
    if sequence is not None:
        log = log.where(F.col("sequence") == sequence)
    last = log.orderBy(F.desc("sequence"), "folder").first()
    return (last["sequence"], last["folder"]) if last else (0, None)


def _parts(
    spark: SparkSession, path: str, name: str, schema: T.StructType, parted: bool
) -> list[Entry]:
    """Manifest entries of a written mart: one pass over it, one row per part to the driver."""
    stored = T.StructType(list(schema.fields))
    if parted:
        stored.add(PART, "string")
    files = spark.read.schema(stored).parquet(path)
    per_file = (
        files.select(
            (F.col(PART) if parted else F.lit("all")).alias("part"),
            # A task gives its files in all parts the same name.
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            row_hash(files, schema).alias("hash"),
        )
        .groupBy("part", "file")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("size").alias("size"),
            hash_sum(F.col("hash")).alias("hash"),
        )
    )
    per_part = per_file.groupBy("part").agg(F.sum("n"), F.sum("size"), total(F.col("hash")))
    found = [
        Entry(name, r[0], posixpath.join(path, f"{PART}={r[0]}") if parted else path, schema.json(), *r[1:])
        for r in few_rows(per_part.orderBy("part"))
    ]
    return found or [Entry(name, "all", path, schema.json(), 0, 0, Decimal(0))]
