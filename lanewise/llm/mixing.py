"""Mixing of sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import WORD, stored, texts

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the sampling key that split a source into sampling buckets.
BUCKET_DIGITS = 4


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(id_column: Column, text: Column, seed: int) -> Column:
    """A seeded pseudo-random order of the documents.

    Rows of one id share their place; rows without an id go by their text.
    """
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    name = F.coalesce(id_column.cast("string"), nameless)
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def water_level(plan: DataFrame) -> float:
    """The level at which min(cap, level * weight) over all sources adds up to all sizes.

    Sources above their cap are clamped and the rest shares what is left by weight, until
    none is above. Each round is one aggregate; only its sums come to the driver.
    """
    clamped, level, n_clamped = F.lit(False), None, -1
    while True:
        sums = plan.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("capped"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(clamped.cast("int")).alias("n"),
        ).first()
        if not sums["total"] or not sums["weight"] or sums["n"] == n_clamped:
            return level or 0.0
        n_clamped, level = sums["n"], (sums["total"] - sums["capped"]) / sums["weight"]
        clamped = F.lit(level) * F.col("weight") > F.col("cap")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """`doc_id, size, source_size, target, copies, taken` for every row (and `row` with `carry`).

    Size is the number of words. Sources in code point order, null last, get the weights in
    turn and share all sizes by them; a source above `max_epochs` times its size is clamped.
    A source's rate is target / source_size: every document is taken floor(rate) times, and
    once more if it comes early in the seeded order of its source, up to the point where the
    source's sum is nearest to its target. `copies` counts the repetitions, `taken` = copies * size.

    Null text counts as empty; rows with the same id, or without an id and with the same text,
    are taken alike. A source whose texts are all empty has target 0. An empty table gives an
    empty table. Columns of the input never clash, since only the named ones are read.
    """
    rows = texts(docs, id_col, text_col, carry, source=docs[source_col].cast("string"))
    key = sampling_key(F.col("doc_id"), F.col("text"), seed)
    rows = rows.withColumns({"size": text_size(F.col("text")), "key": key}).drop("text")
    if not carry:
        rows = stored(rows, "mix-sizes")
    sized = rows.select("source", "size", "key")
    sized = stored(sized, "mix-sizes") if carry else sized

    # One row per source: the only window over all of them.
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    plan = stored(
        by_source.select(
            "source",
            "source_size",
            F.element_at(pattern, (rank % len(weights) + 1).cast("int")).cast("long").alias("weight"),
            (F.col("source_size") * max_epochs).alias("cap"),
        ),
        "mix-plan",
    )
    level = water_level(plan)
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.select(
        "source",
        "source_size",
        target.alias("target"),
        whole.cast("long").alias("whole"),
        (target - whole * F.col("source_size")).alias("rest"),
    )

    # Where the seeded order of a source reaches the rest: first the bucket, then the key in it.
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sized.groupBy("source", bucket)
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    )
    split = (
        buckets.alias("b")
        .join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")))
        .where(F.col("before") + F.col("bucket_size") >= F.col("rest"))
        .select("b.source", "bucket", "before", "rest")
    )
    inside = (
        sized.select("source", "size", "key", bucket)
        .alias("k")
        .join(
            split.alias("s"),
            F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.bucket") == F.col("s.bucket")),
        )
        .groupBy("k.source", "k.bucket", "key", "before", "rest")
        .agg(F.sum("size").alias("size"))
    )
    run = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2
    # Without a key in the bucket itself, all keys of earlier buckets are in.
    last_key = F.coalesce(
        F.max(F.when(F.col("reached") <= F.col("rest"), F.col("key"))), F.min("bucket")
    )
    cutoff = inside.withColumn("reached", reached).groupBy("source").agg(last_key.alias("last_key"))
    plan = (
        plan.alias("p")
        .join(cutoff.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select("p.*", "last_key")
    )
    plan = stored(plan, "mix-targets")

    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    out = rows.alias("r").join(plan.alias("p"), same)
    once_more = (F.col("rest") > 0) & (F.col("key") <= F.col("last_key"))
    copies = F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")
    return out.select(
        "doc_id",
        *(["row"] if carry else []),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken."""
    rows = mix_sources(docs, carry=True, **options).where(F.col("copies") > 0)
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
