"""Helpers shared by the text operators: input columns, stored steps, batches of texts."""

from __future__ import annotations

import atexit
import os
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word in most operators: a run without blanks. `bytes.split()` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked through in pieces of about this many bytes, whatever the batch size is.
CHUNK_BYTES = 2 << 20

#: Bounds of the Arrow batches between Spark and Python, whichever is reached first.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which all executors share.

    Where the setting is absent a local folder serves a local master only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lanewise-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return posixpath.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that its lineage ends there."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lanewise_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lanewise-package-")  # served from here while the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = os.path.join(folder, "tree", "lanewise")
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(
        shutil.make_archive(os.path.join(folder, "lanewise"), "zip", os.path.dirname(copy))
    )
    context._lanewise_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session be small: a worker holds a few copies of one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(
    docs: DataFrame, id_col: str, text_col: str, carry: bool = False, **more: Column
) -> DataFrame:
    """`doc_id, text`, more columns, and with `carry` the whole input row as the struct `row`.

    The struct keeps all other columns apart, whatever their names are.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    columns = [docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")]
    if carry:
        columns.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return docs.select(*columns, *[column.alias(name) for name, column in more.items()])


def output_schema(base: DataFrame, *fields: tuple[str, T.DataType | str]) -> T.StructType:
    """The columns of `base` but for its text, and the fields."""
    kept = [f for f in base.schema.fields if f.name != "text"]
    added = [
        T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in fields
    ]
    return T.StructType(kept + added)


def with_columns(batch: pa.RecordBatch, **added) -> pa.RecordBatch:
    """The batch without its text and with the added columns (arrays or lists)."""
    names = [n for n in batch.schema.names if n != "text"]
    arrays = [batch.column(n) for n in names]
    arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in added.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names + list(added))


def encoded(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch in UTF-8; a null text is empty."""
    column = batch.column("text")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def in_chunks(values: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose values have about `limit` bytes together; a longer one stands alone."""
    start = size = 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > limit:
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield start, len(values)


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def held_out(id_column: Column, modulus: int) -> Column:
    """True where nothing may be learned from the row. Rows without an id are held out."""
    return F.coalesce(remainder(id_column, modulus) == 0, F.lit(True))


def splitmix(values: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit integers, one to one."""
    z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
