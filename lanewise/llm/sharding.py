"""Sharding by histogram sort: splitters from exact byte counts, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import shared_folder, ship_package, stored

SHARDS = 8
#: A splitter is good when the bytes below it are this share of a shard away from their target.
TOLERANCE = 0.005
#: Probes for each open splitter and round.
PROBES = 32
#: Shards are written in parts of about this many bytes, each of them the work of one task.
PART_BYTES = 32 << 20
#: Inner splitters only deal out work, so that this share of a part is near enough.
PART_TOLERANCE = 0.1
#: Keys are written anew when those in open intervals are fewer than one in this many.
SHRINK = 4
KEY_BYTES = 24
LAST = 1 << 8 * KEY_BYTES


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text: Column, id_column: Column) -> Column:
    """24 bytes that order the rows: hash of the text, of the id, and of the row's place.

    Equal texts stand together; rows equal in text and id differ in the last part only.
    """
    parts = [
        F.xxhash64(text.isNull(), text),
        F.xxhash64(id_column.isNull(), id_column.cast("string")),
        F.xxhash64(F.monotonically_increasing_id()),
    ]
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def _keys(column: pa.Array) -> np.ndarray:
    """Binary keys of one length as a numpy array that orders like them."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.empty(0, f"S{KEY_BYTES}")
    offset = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], f"S{KEY_BYTES}", len(column), offset)


def _packed(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(KEY_BYTES, "big") for p in probes], f"S{KEY_BYTES}")


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """Exact bytes, smallest and largest key of each bin; bin i has the keys from probe i - 1
    on and below probe i. Each task sends one row per bin that it met."""
    bounds = _packed(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        sizes, low, high = np.zeros(n, np.int64), {}, {}
        for batch in batches:
            values = _keys(batch.column("key"))
            if not len(values):
                continue
            order = np.argsort(values)
            values = values[order]
            bins = np.searchsorted(bounds, values, "right")
            np.add.at(sizes, bins, batch.column("size").to_numpy()[order])
            met, first = np.unique(bins, return_index=True)
            for b, i, j in zip(met.tolist(), first.tolist(), [*first[1:].tolist(), len(bins)]):
                low[b] = min(low.get(b, values[i]), values[i])
                high[b] = max(high.get(b, values[j - 1]), values[j - 1])
        met = sorted(low)
        ends = [pa.array([bytes(d[b]).ljust(KEY_BYTES, b"\0") for b in met], pa.binary()) for d in (low, high)]
        columns = [pa.array(met, pa.int32()), pa.array(sizes[met], pa.int64()), *ends]
        yield pa.RecordBatch.from_arrays(columns, names=["bin", "size", "low", "high"])

    partial = keys.mapInArrow(count, "bin int, size long, low binary, high binary")
    bins = partial.groupBy("bin").agg(F.sum("size"), F.min("low"), F.max("high"))
    return {
        r[0]: (r[1], int.from_bytes(r[2], "big"), int.from_bytes(r[3], "big")) for r in bins.collect()
    }


def _spread(low: int, high: int, n: int) -> list[int]:
    """Up to n probes above `low` and up to `high`, evenly spaced.

    Between different texts they fall between texts, within one text between ids, so that no
    group is cut while there are others to cut between.
    """
    unit = next(u for u in (1 << 128, 1 << 64, 1) if low // u < high // u)
    spread = {(low + (high - low) * i // n) // unit * unit for i in range(1, n + 1)}
    return [p for p in spread if p > low]


def find_splitters(keys: DataFrame, total: int, wanted: list[tuple[float, float]]) -> list[int]:
    """For each (target, tolerance) the key below which about `target` bytes lie.

    A round counts the bytes below all probes in one pass. A probe within the tolerance settles
    its splitter; otherwise the keys of the bin that holds the target, from the smallest to the
    largest, are the next interval, down to one row, which goes to the nearer side.
    """
    # An open splitter: bytes below its interval, first and last key of the interval.
    state = dict.fromkeys(range(len(wanted)), (0, 0, LAST - 1))
    found: dict[int, int] = {}
    kept = total
    while state:
        probes = {p for _, low, high in set(state.values()) for p in _spread(low, high, PROBES)}
        probes |= {p for _, low, high in state.values() for p in (low, high + 1) if 0 < p < LAST}
        probes = sorted(probes)
        place = {p: i for i, p in enumerate(probes)}
        bins = histogram(keys, probes)
        open_bins = {}
        for i, (below, low, high) in list(state.items()):
            target, tolerance = wanted[i]
            best, inside = (abs(below - target), low), None
            first_bin = place[low] + 1 if low else 0
            for b in range(first_bin, place.get(high + 1, len(probes)) + 1):
                size, first, final = bins.get(b, (0, 0, 0))
                if size and below <= target < below + size:
                    inside = b, (below, first, final)
                below += size
                if size:
                    best = min(best, (abs(below - target), final + 1))
            if best[0] <= tolerance or inside is None or inside[1][1] == inside[1][2]:
                found[i] = best[1]
                del state[i]
            else:
                open_bins[inside[0]] = bins[inside[0]]
                state[i] = inside[1]
        left = sum(size for size, _, _ in open_bins.values())
        if state and left * SHRINK < kept:
            spans = sorted((low, high) for _, low, high in open_bins.values())
            keys, kept = stored(_between(keys, spans), "shard-keys"), left
    return [found[i] for i in range(len(wanted))]


def _between(keys: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """The keys in disjoint spans, which include their ends."""
    edges = _packed([edge for low, high in spans for edge in (low, high + 1)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = np.searchsorted(edges, _keys(batch.column("key")), "right") % 2 == 1
            yield batch.filter(pa.array(inside))

    return keys.mapInArrow(keep, keys.schema)


def write_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    part_bytes: int = PART_BYTES,
) -> str:
    """Write the rows to `shard=0` ... in a new folder of the shared one, and return its path.

    All rows are ordered by a hash of text, id and place, so that equal texts stand together,
    and cut where exact byte counts are nearest to equal: a group of copies is cut only if a
    splitter falls into it. A size is the UTF-8 bytes of the text plus 1. Whole rows, with all
    their columns in the struct `row`, are exchanged once, straight to the part that the key
    names, and each part is sorted and written by one task.

    A null text counts 1 and differs from an empty one; null ids and repeated rows are ordered
    by their place in the input. With fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = docs[text_col].cast("string")
    rows = docs.select(
        sort_key(text, docs[id_col]).alias("key"),
        size_of(text).alias("size"),
        docs[id_col].alias("doc_id"),
        text.alias("text"),
        F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"),
    )
    keys = stored(rows.select("key", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    share = total / shards
    targets = [
        (share * i / parts, share * tolerance if i % parts == 0 else share / parts * PART_TOLERANCE)
        for i in range(1, shards * parts)
    ]
    splitters = find_splitters(keys, total, targets) if total else [LAST - 1] * len(targets)
    # Inner splitters are looser than shard bounds, so that order is restored between them.
    splitters = list(accumulate(splitters, max))
    bounds = spark.sparkContext.broadcast(_packed([min(s, LAST - 1) for s in splitters]))

    @F.arrow_udf("int")
    def part_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds.value, _keys(key), "right"), pa.int32())

    path = shared_folder(spark, "shards")
    writer = (
        rows.withColumn("part", part_of("key"))
        .repartitionById(shards * parts, F.col("part"))
        .sortWithinPartitions("part", "key")
        .select(
            F.floor(F.col("part") / parts).cast("int").alias("shard"),
            "part",
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
            "doc_id",
            "text",
            "row",
        )
        .write.option("compression", "zstd")
    )
    # Without rows no folder of a shard would hold the columns.
    (writer.partitionBy("shard") if total else writer).parquet(path)
    return path


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, text, row, shard, slot` from the written shards.

    A slot is the row's place in its part after the rows of the shard's earlier parts.
    """
    rows = spark.read.parquet(folder).withColumn("shard", F.col("shard").cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    slot = (F.col("offset") + F.col("at") - F.col("first")).alias("slot")
    # One row per part, which holds PART_BYTES: a broadcast of at most 32 bytes for each.
    return rows.join(F.broadcast(sizes), "part").select("doc_id", "text", "row", "shard", slot)


def shard_documents(docs: DataFrame, **options) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` of the shards as read back."""
    return read_shards(docs.sparkSession, write_shards(docs, **options)).select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
