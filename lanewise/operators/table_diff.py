"""Difference of two tables by a tree of checksums: only ranges that differ are opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.content import hash_sum, row_hash
from lanewise.sources.marts import shared_folder, write_mart

#: Bits of the key's hash that one level of the tree adds, and the rows per range that are few
#: enough to be compared one by one.
LEVEL_BITS = 4
OPEN_ROWS = 32
LEFT, RIGHT = "only_left", "only_right"


def _range(level: int) -> Column:
    return F.shiftrightunsigned("_place", 64 - LEVEL_BITS * level)


def unequal_ranges(digests: Sequence[DataFrame], folder: str) -> tuple[int, DataFrame]:
    """The level at which ranges are opened, and the `range` numbers there that differ, with
    how many `rows` they have on both sides; digests are `_place, hash` of the two tables."""
    level, differing = 0, None
    while level * LEVEL_BITS < 60:
        level += 1
        summed = None
        for sign, digest in zip((1, -1), digests):
            if differing is not None:
                digest = digest.join(differing, _range(level - 1) == differing["range"], "left_semi")
            part = digest.groupBy(_range(level).alias("range")).agg(
                (sign * F.count(F.lit(1))).alias("n"),
                (sign * hash_sum(F.col("hash"))).alias("hash"),
                F.count(F.lit(1)).alias("rows"),
            )
            summed = part if summed is None else summed.unionByName(part)
        ranges = summed.groupBy("range").agg(*[F.sum(c).alias(c) for c in ("n", "hash", "rows")])
        unequal = ranges.where((F.col("n") != 0) | (F.col("hash") != 0)).select("range", "rows")
        differing = write_mart(unequal, folder, f"level-{level}")
        n, rows = differing.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if rows <= n * OPEN_ROWS:
            break

    return level, differing


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one of two tables has: `side`, `n` more than the other, and all columns.

    Rows fall into ranges of a hash of their key. Per range both tables are summed up to a
    count and an order-free checksum, level by level, sixteen ranges below each that differed;
    a level's tasks send one row per range, not their rows. Where ranges hold few rows they
    are opened, and only their rows are shuffled and compared. Equal tables are found so after
    one level. A changed row shows twice, once for each side; repeated rows count.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    folder = shared_folder(left.sparkSession, "diff")
    sides = {LEFT: left, RIGHT: right.select(columns)}
    place = F.xxhash64(*[F.col(k) for k in keys]).alias("_place")
    # Hash and checksum are computed once; levels read these two columns only.
    digests = {}
    for name, df in sides.items():
        digest = df.select(place, row_hash(df).alias("hash"))
        digests[name] = write_mart(digest, folder, f"digests-{name}")

    level, differing = unequal_ranges(list(digests.values()), folder)
    signed = None
    for sign, df in zip((1, -1), sides.values()):
        opened = df.withColumn("_place", place).join(differing, _range(level) == differing["range"], "left_semi")
        part = opened.select(*columns, F.lit(sign).alias("sign"))
        signed = part if signed is None else signed.unionByName(part)
    surplus = signed.groupBy(*columns).agg(F.sum("sign").alias("n")).where(F.col("n") != 0)
    side = F.when(F.col("n") > 0, F.lit(LEFT)).otherwise(F.lit(RIGHT))
    return surplus.select(side.alias("side"), F.abs("n").alias("n"), *columns)
