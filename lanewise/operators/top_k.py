"""The k largest groups among very many, without grouping all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.sources.marts import shared_folder, write_mart

#: Groups that a task remembers, at first, by how much more in the next round, and at most. A
#: task holds up to three times as many, so this bounds its memory whatever the data.
CAPACITY = 10_000
GROWTH = 8
MOST = 80_000


def _summaries(rows: DataFrame, capacity: int) -> DataFrame:
    """Per task: its largest groups with a lower bound of their sums, and, in a row without a
    key, how much any one group may have lost.

    A task adds up its rows, as many at a time as its capacity, and drops the smallest groups
    whenever it holds twice its capacity. A dropped group had at most the largest sum dropped
    with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, missed = None, [], 0.0

        def add_up() -> None:
            nonlocal held, missed
            table = pa.Table.from_batches(new)
            new.clear()
            held = table if held is None else pa.concat_tables([held, table])
            held = held.group_by("key").aggregate([("weight", "sum")]).rename_columns(["key", "weight"])
            if len(held) > 2 * capacity:
                held = held.sort_by([("weight", "descending")])
                missed += held["weight"][capacity].as_py()
                held = held.slice(0, capacity).combine_chunks()

        for batch in batches:
            new.append(batch)
            if sum(map(len, new)) >= capacity:
                add_up()
        if new:
            add_up()
        if held is not None:
            last = pa.table({"key": pa.array([None], pa.string()), "weight": pa.array([missed])})
            yield from pa.concat_tables([held, last]).to_batches()

    return rows.mapInArrow(run, "key string, weight double")


def top_groups(
    df: DataFrame, keys: Sequence[str], weight: str, k: int, capacity: int = CAPACITY
) -> DataFrame:
    """The `k` groups with the largest sums of a weight that is never negative, exactly.

    Tasks send summaries of bounded size. Merged, they give every group a lower bound, and an
    upper one that is higher by what all tasks may have dropped. Groups whose upper bound
    reaches the k-th lower bound are the candidates; their rows are summed up in whole. If
    even a group that no task kept might reach it, the next round remembers more groups, up to
    `MOST`. Groups too alike to be told apart by then are all summed up, in a plain grouping
    whose state Spark can spill.

    Ties go by the keys. Null keys are a group, null weights are left out.
    """
    folder = shared_folder(df.sparkSession, "top-groups")
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.where(F.col(weight).isNotNull())
    narrow = rows.select(name.alias("key"), F.col(weight).cast("double").alias("weight"))
    while True:
        summaries = write_mart(_summaries(narrow, capacity), folder, f"summaries-{capacity}")
        missed = summaries.where(F.col("key").isNull()).agg(F.sum("weight")).first()[0] or 0.0
        lower = summaries.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("weight").alias("lower"))
        lower = write_mart(lower, folder, f"bounds-{capacity}")
        first = lower.orderBy(F.desc("lower")).limit(k).agg(F.min("lower"), F.count("lower")).first()
        # Sums of doubles in another order differ in their last digits.
        reach = (first[0] or 0.0) * (1 - 1e-9) if first[1] == k else 0.0
        if not missed or missed * (1 + 1e-9) < reach:
            candidates = lower.where(F.col("lower") + missed * (1 + 1e-9) >= reach).select(F.col("key").alias("_key"))
            whole = rows.withColumn("_key", name).join(candidates, "_key", "left_semi")
            break
        capacity *= GROWTH
        if capacity > MOST:
            whole = rows
            break
    return whole.groupBy(*keys).agg(F.sum(weight).alias(weight)).orderBy(F.desc(weight), *keys).limit(k)
