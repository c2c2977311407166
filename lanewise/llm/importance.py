"""Importance resampling towards a target text: array-scored weights, exact distributed selection."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import encoded, output_schema, stored, texts, with_columns
from lanewise.llm.decontaminate import SEPARATED

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: Texts are cut between words into pieces of about this many bytes, so that memory is bounded.
PIECE_BYTES = 2 << 20
#: Keys that one median stands for, at most.
SLICE = 1 << 20
#: The search ends when this many keys are left; they are ordered at once.
LAST_KEYS = 10_000
#: Survivors are written anew when they are fewer than one in this many of the stored keys.
SHRINK = 4
#: Words beyond this length are hashed one by one, the others column by column.
LONG_WORD = 48
#: The selection's order: highest score, smallest id (none last), place in the stored table.
KEY = ("down", "no_id", "id", "place")


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values.astype(np.uint32)


_CRC = _crc_table()


def word_crcs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """crc32 and start of every word of lower-cased, separated bytes (see `SEPARATED`)."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.diff(np.concatenate(([False], raw != 0x20, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    crcs = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # By length, so that the words that reach a column stand at the end.
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(LONG_WORD + 2))
    last = first[LONG_WORD + 1]
    for column in range(LONG_WORD):
        reach = order[first[column + 1] : last]
        if not len(reach):
            break
        crc = crcs[reach]
        crcs[reach] = _CRC[(crc ^ raw[starts[reach] + column]) & 0xFF] ^ (crc >> np.uint32(8))
    crcs ^= np.uint32(0xFFFFFFFF)
    for i in order[last:]:
        crcs[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crcs, starts


def pieces(values: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """The texts joined into pieces of about PIECE_BYTES; a long text is cut between words.

    With each piece come the (value, start) pairs of the texts in it.
    """
    spans, parts, size = [], [], 0
    for i, value in enumerate(values):
        value, at = value.translate(SEPARATED), 0
        while at < len(value):
            end = value.find(b" ", at + max(PIECE_BYTES - size, 1))
            end = len(value) if end < 0 else end
            spans.append((i, size))
            parts.append(value[at:end])
            size += end - at + 1
            at = end
            if size >= PIECE_BYTES:
                yield np.array(spans), b" ".join(parts)
                spans, parts, size = [], [], 0
    if spans:
        yield np.array(spans), b" ".join(parts)


def word_buckets(values: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bucket of each word and the text that it belongs to, piece by piece."""
    for spans, data in pieces(values):
        crcs, starts = word_crcs(data)
        owner = spans[np.searchsorted(spans[:, 1], starts, "right") - 1, 0]
        yield (crcs % np.uint32(buckets)).astype(np.int64), owner


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Words of all texts per bucket. Each task sends one row per bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in word_buckets(encoded(batch), buckets):
                sums += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": met, "n": sums[met]})

    partial = rows.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(source))
    ratios = [((t + 1.0) * s_all) / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """The rows with `n_features` and `weight`, the mean gain of their words rounded down."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = encoded(batch)
            words, sums = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            for found, owner in word_buckets(values, len(gains)):
                # Whole numbers below 2**53, so that sums in doubles are exact.
                sums += np.bincount(owner, gains[found], len(values)).astype(np.int64)
                words += np.bincount(owner, minlength=len(values))
            yield with_columns(batch, n_features=words, weight=sums // np.maximum(words, 1))

    return rows.mapInArrow(weigh, output_schema(rows, ("n_features", "long"), ("weight", "long")))


def noise(id_column: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that the id's digest gives, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _precedes(keys: np.ndarray, pivot: tuple) -> np.ndarray:
    mask = np.zeros(keys.shape[1], bool)
    for values, bound in zip(keys[::-1], pivot[::-1]):
        mask = (values < bound) | ((values == bound) & mask)
    return mask


def _median(keys: np.ndarray) -> list[int]:
    order = np.lexsort(keys[::-1])
    return keys[:, order[(len(order) - 1) // 2]].tolist()


def _round(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list:
    """Per slice of keys strictly between low and high: side of the pivot, number, median."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]).astype(np.int64)
            if low:
                part = part[:, ~_precedes(part, (*low[:-1], low[-1] + 1))]
            if high:
                part = part[:, _precedes(part, high)]
            held.append(part)
            n += part.shape[1]
            if n >= SLICE:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
        if n:
            yield np.concatenate(held, axis=1)

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in slices(batches):
            left = _precedes(part, pivot) if pivot else np.ones(part.shape[1], bool)
            right = ~_precedes(part, (*pivot[:-1], pivot[-1] + 1)) if pivot else ~left
            for side, mask in (("left", left), ("right", right)):
                if mask.any():
                    rows.append((side, int(mask.sum()), *_median(part[:, mask])))
        columns = list(zip(*rows)) or [[] for _ in range(2 + len(KEY))]
        schema = pa.schema([("side", pa.string()), ("n", pa.int64()), *[(c, pa.int64()) for c in KEY]])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    if low:  # the coarse bounds reach the scan
        keys = keys.where(F.col("down") >= low[0])
    if high:
        keys = keys.where(F.col("down") <= high[0])
    found = keys.mapInArrow(medians, "side string, n long, " + ", ".join(f"{c} long" for c in KEY))
    return [tuple(r) for r in found.collect()]


def cutoff(keys: DataFrame, n: int, k: int) -> tuple | None:
    """The k-th key of the n distinct ones in `keys`, found without ordering them.

    Each round takes the median of the slice medians, weighted by how many keys are left in
    the slices, counts the keys on both sides and goes on in the side that holds the k-th: at
    least a quarter of the keys are settled for good. One job a round gives the counts and the
    medians of both sides, one row per slice and side.
    """
    low = high = None
    held, left = n, _round(keys, None, None, None) if 0 < k <= n else []
    while left:
        total = sum(r[1] for r in left)
        if total <= LAST_KEYS:
            kept = keys.where(F.col("down").between(low[0] if low else -(2**63), high[0] if high else 2**63 - 1))
            rows = sorted(
                tuple(r)
                for r in kept.where(_after(low) & _before(high)).select(*KEY).collect()
            )
            return rows[k - 1]
        if total * SHRINK < held:
            keys, held = stored(keys.where(_after(low) & _before(high)), "importance-keys"), total
        reached, pivot = 0, None
        for _, size, *key in sorted(left, key=lambda r: r[2:]):
            reached += size
            pivot = tuple(key)
            if 2 * reached >= total:
                break
        found = _round(keys, low, high, pivot)
        before = sum(r[1] for r in found if r[0] == "left")
        if k == before + 1:
            return pivot
        if k <= before:
            high, left = pivot, [r for r in found if r[0] == "left"]
        else:
            low, left, k = pivot, [r for r in found if r[0] == "right"], k - before - 1
    return None


def _key() -> Column:
    return F.struct(*KEY)


def _bound(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(key, KEY)])


def _after(key: tuple | None) -> Column:
    return _key() > _bound(key) if key else F.lit(True)


def _before(key: tuple | None) -> Column:
    return _key() < _bound(key) if key else F.lit(True)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """`doc_id, n_features, weight, score, rank` for every row (and `row` with `carry`).

    Words are hashed to buckets; a bucket's gain compares its share in the target with that in
    all documents, a document's weight is its mean gain, and its score adds seeded noise, so
    that the highest scores are a draw without replacement. Of the documents with at least
    `min_words` words, `percent` in a hundred are drawn; `rank` numbers them, the others have
    none. Ids are integers. Equal scores go by the smaller id, no id last; rows that are equal
    in both are drawn in the order of the stored table, up to the exact number.

    A null text has no words, weight 0 and is never drawn unless `min_words` is 0; a null id
    draws its noise as `null`. An empty table gives an empty table, an empty target gains from
    smoothing alone. Only the named columns are read, so that others never clash.
    """
    rows = texts(docs, id_col, text_col, carry)
    goal = texts(target, target_text_col, target_text_col)
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(goal, buckets))
    scored = weighted(rows, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("place", F.monotonically_increasing_id()), "importance")

    enough = F.col("n_features") >= min_words
    identity = F.col("doc_id").cast("long")
    keyed = (
        scored.withColumn("down", -F.col("score"))
        .withColumn("no_id", identity.isNull().cast("long"))
        .withColumn("id", F.coalesce(identity, F.lit(0)).cast("long"))
    )
    n = scored.where(enough).count()
    last = cutoff(keyed.where(enough).select(*KEY), n, percent * n // 100)
    output = ["doc_id", *(["row"] if carry else []), "n_features", "weight", "score"]
    if last is None:
        return scored.select(*output, F.lit(None).cast("long").alias("rank"))

    won = enough & (_key() <= _bound(last))
    # Ordered by one range exchange; a row's rank is its place after all earlier partitions.
    winners = stored(
        keyed.where(won).orderBy(*KEY).select(*output, F.monotonically_increasing_id().alias("at")),
        "importance-winners",
    )
    part = F.shiftright("at", 33).alias("part")
    return winners_ranked(winners, part).select(*output, "rank").unionByName(
        keyed.where(~won).select(*output, F.lit(None).cast("long").alias("rank"))
    )


def winners_ranked(winners: DataFrame, part: Column) -> DataFrame:
    """The rows with `rank`, from their partition and place in it; one row per partition is summed."""
    sizes = winners.groupBy(part).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        winners.withColumn("part", part)
        .join(F.broadcast(sizes), "part")
        .withColumn("rank", F.col("offset") + inside + 1)
    )


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs`, with their columns."""
    return resample(docs, target, carry=True, **options).where(F.col("rank").isNotNull()).select("row.*")
