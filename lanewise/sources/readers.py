"""CSV and parquet readers with declared schemas, SQL views, optional inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lanewise.schemas import TABLES, checked, read_as, require_columns

#: Name of the column that takes the text of a malformed record.
REJECTED = "_rejected_record"


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key_type: T.DataType = T.LongType(),
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header row. Columns are matched by header name; a missing one is an error.

    Extra columns in the file are ignored, as is their order. A doubled quote inside a quoted
    field is one quote. Fields with line breaks need `multi_line`, which keeps Spark from
    splitting a file. `key_type` is that of all ids, for example text.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    raw = spark.read.options(**options).csv(path)
    require_columns(raw, schema.names, path)
    return raw.select([read_as(raw, f, key_type) for f in schema.fields])


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key_type: T.DataType = T.LongType(),
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Good rows as `read_csv_table` gives them, and rejected records: `file, line, reason`.

    A record is rejected when it has more or fewer fields than the header, when a value is not
    of its column's type or has more digits than can be kept, and when a column that must be
    there is empty. The reason names the first such column. `line` is the record's text. Every
    record is in one of the two frames.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECTED]])
    # Without pruning, so that a record's number of fields is always seen.
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, "columnPruning": False}
    records = spark.read.options(**options).schema(texts).csv(path).select(
        "*", F.col("_metadata.file_path").alias(f"{REJECTED}_file")
    )
    reasons, values = [], []
    for field in schema.fields:
        value, problem = checked(field, key_type)
        values.append(value.alias(field.name))
        reasons.append(problem)
    fields = F.when(F.col(REJECTED).isNotNull(), F.lit("not as many fields as the header"))
    reason = F.coalesce(fields, *reasons)
    line = F.coalesce(F.col(REJECTED), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names])))
    rejected = records.where(reason.isNotNull()).select(
        F.col(f"{REJECTED}_file").alias("file"), line.alias("line"), reason.alias("reason")
    )
    return records.where(reason.isNull()).select(*values), rejected


def reading_counts(good: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """`table_name, n_records, n_good, n_rejected`, for a manifest."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n") for df, side in ((good, "good"), (rejected, "rejected"))]
    both = counts[0].unionByName(counts[1])
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")))
    return both.agg(
        F.sum("n").alias("n_records"), of("good").alias("n_good"), of("rejected").alias("n_rejected")
    ).select(F.lit(name).alias("table_name"), "*")


def read_parquet_table(
    spark: SparkSession, path: str, schema: T.StructType, key_type: T.DataType | None = None
) -> DataFrame:
    """Parquet; ids keep their stored type unless `key_type` is given."""
    raw = require_columns(spark.read.parquet(path), schema.names, path)
    return raw.select([read_as(raw, f, key_type) for f in schema.fields])


def read_tables(
    spark: SparkSession, root: str, fmt: str = "parquet", **options
) -> dict[str, DataFrame]:
    """The six source tables from `<root>/<table>.<fmt>`; options go to the table's reader."""
    reader = {"csv": read_csv_table, "parquet": read_parquet_table}[fmt]
    return {
        name: reader(spark, f"{root}/{name}.{fmt}", schema, **options)
        for name, schema in TABLES.items()
    }


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or an empty one with `schema` where nothing is written yet.

    A table that lacks expected columns is an error.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return require_columns(found, schema.names, path)
