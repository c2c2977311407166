"""SimHash near-duplicates: fingerprints partitioned by vantage points in Hamming space."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import (
    LOWER,
    encoded,
    output_schema,
    stored,
    texts,
    with_columns,
)

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that one cell of the vantage point partition should hold on average.
CELL = 2_000
#: Fingerprints of one cell in one block; a larger cell is worked off block by block.
BLOCK = 20_000
#: Entries of the shuffled cells in one group.
GROUP = 200_000
#: Pairs that are compared outright in a branch of the tree.
LEAF_PAIRS = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 where over half of the shingle hashes have it; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = [np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)]
    bits = np.concatenate(ones) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: bool) -> DataFrame:
    """`doc_id, fp` (64 bits as a long), and with `carry` the `row` and a hash of its text, `tie`."""
    tie = {"tie": F.xxhash64(docs[text_col])} if carry else {}
    rows = texts(docs, id_col, text_col, carry, **tie)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in encoded(batch)], np.uint64)
            yield with_columns(batch, fp=pa.array(found.view(np.int64), pa.int64()))

    return rows.mapInArrow(run, output_schema(rows, ("fp", "long")))


# Partition. A pair within 3 bits is within 1 bit in the low or in the high half, so two trees
# over the halves with radius 1 find every pair; over all 64 bits distances lie so close
# together that a bound of 3 would prune next to nothing. On a half, the distances to each
# vantage point of two codes that differ in one bit differ by exactly one.


def vantage_points(fps: DataFrame, n: int) -> np.ndarray:
    """The first few fingerprints in a hash order."""
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(n).collect() if n else []
    return np.array([r["fp"] for r in rows], np.int64).view(np.uint64)


def depth_for(n: int) -> int:
    """Vantage points so that a cell holds about CELL of n fingerprints (about 1 in 9 per point)."""
    return max(0, math.ceil(math.log(max(1, n / CELL), 9)))


def half_of(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp >> np.uint64(32 * half)).astype(np.uint32)


def cells(codes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cell of each code: its distances to the vantage points, written in base 64."""
    key = np.zeros(len(codes), np.int64)
    for point in points:
        key = key * 64 + np.bitwise_count(codes ^ point).astype(np.int64) + 1
    return key


def overlaps(codes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and cell of each neighbouring cell that a one-bit change can reach.

    Of the two directions between neighbours one suffices: the larger distance to the first
    point. With no point there is one cell and nothing to reach.
    """
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own, found = cells(codes, points), []
    for bit in range(32):
        step = np.zeros(len(codes), np.int64)
        for i, point in enumerate(points):
            up = ((codes ^ point) >> np.uint32(bit)) & np.uint32(1) == 0
            sign = np.where(up, 1, -1).astype(np.int64)
            step = step * 64 + sign
            if i == 0:
                forward = up
        found.append(np.stack([np.flatnonzero(forward), (own + step)[forward]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def entries(fps: DataFrame, points: np.ndarray) -> DataFrame:
    """`fp, half, cell, stored`: each code once in its cell and as a probe in reachable cells."""
    halves = [np.unique(half_of(points, h)) for h in (0, 1)]

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for half in (0, 1):
                codes = half_of(fp, half)
                index, cell = overlaps(codes, halves[half])
                own = cells(codes, halves[half])
                n = len(index)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((fp, fp[index])).view(np.int64)),
                        pa.array(np.full(len(fp) + n, half, np.int32)),
                        pa.array(np.concatenate((own, cell))),
                        pa.array(np.arange(len(fp) + n) < len(fp)),
                    ],
                    names=["fp", "half", "cell", "stored"],
                )

    return fps.mapInArrow(run, "fp long, half int, cell long, stored boolean")


class Components:
    """Union of links among n nodes, the label being the smallest index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def search(
    fp: np.ndarray, code: np.ndarray, probes: np.ndarray, held: np.ndarray, max_bits: int, union: Components
) -> None:
    """Link each probe with the held codes within `max_bits`; both are indices of `fp`.

    Each level takes a held code as vantage point, puts the held codes in rings by distance,
    and sends a probe to the rings that the triangle inequality leaves: its own distance, one
    less and one more, as only codes within one bit of the half are sought here.
    """
    stack = [(probes, held)]
    while stack:
        q, p = stack.pop()
        if not len(q) or not len(p):
            continue
        if len(q) * len(p) > LEAF_PAIRS:
            point = code[p[0]]
            dq, dp = np.bitwise_count(code[q] ^ point), np.bitwise_count(code[p] ^ point)
            rings = np.unique(dp)
            if len(rings) > 1:
                for ring in rings:
                    near = np.abs(dq.astype(np.int16) - np.int16(ring)) <= 1
                    stack.append((q[near], p[dp == ring]))
                continue
        step = max(1, LEAF_PAIRS // len(p))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            a, b = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[p][None, :]) <= max_bits)
            union.link(part[a], p[b])


def cell_links(table: pa.Table, max_bits: int) -> pa.Table:
    """For all cells of a group, a link from each linked code to the smallest of its component."""
    half, cell, block = (np.asarray(table[c]) for c in ("half", "cell", "block"))
    fp = np.asarray(table["fp"]).view(np.uint64)
    is_stored = np.asarray(table["stored"])
    order = np.lexsort((block, cell, half))
    key = np.stack([half[order], cell[order], block[order]])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    nodes, index = np.unique(fp, return_inverse=True)
    union = Components(len(nodes))
    for part in np.split(order, cuts):
        code = half_of(nodes, int(half[part[0]])) if len(part) else nodes
        held = np.unique(index[part[is_stored[part]]])
        search(nodes, code, np.unique(index[part]), held, max_bits, union)
    linked = np.flatnonzero(union.label != np.arange(len(nodes)))
    return pa.table(
        {"a": nodes[linked].view(np.int64), "b": nodes[union.label[linked]].view(np.int64)}
    )


def near_pairs(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Links `a, b` between distinct fingerprints, enough to span each component of each group."""
    if max_bits > 3:
        raise ValueError("the halves are searched within one bit each: at most 3 bits")
    shares = entries(fps, vantage_points(fps, depth_for(n)))
    held = shares.where("stored").groupBy("half", "cell").agg(F.count(F.lit(1)).alias("size"))
    large = held.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    blocks = F.coalesce(F.col("blocks"), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # A code lies in one block of its cell and probes all of them.
    spread = (
        shares.join(large.select("half", "cell", "blocks"), ["half", "cell"], "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("stored", F.col("stored") & (F.col("block") == own))
    )
    groups = max(1, math.ceil(n * 12 / GROUP))
    grouped = spread.withColumn("group", F.pmod(F.xxhash64("half", "cell", "block"), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(
        lambda table: cell_links(table, max_bits), "a long, b long"
    )


def components(links: DataFrame) -> DataFrame:
    """`fp, root` for every linked node, by alternating large-star and small-star steps.

    Each step replaces links by links to the smallest neighbour and is written to the shared
    folder; after a number of rounds logarithmic in the nodes all links are stars.
    """
    low, high = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    edges = stored(links.where(F.col("a") != F.col("b")).select(low, high).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
        small = small.where(F.col("u") != F.col("v")).union(least.select(F.col("m").alias("u"), "v"))
        edges = stored(small.distinct(), "links")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        before = now


def classes_of(plain: DataFrame, max_bits: int) -> DataFrame:
    """`fp, root, component_id` of every fingerprint of the stored rows `doc_id, fp`."""
    nodes = stored(plain.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(near_pairs(nodes.select("fp"), nodes.count(), max_bits))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stored(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row.

    Fingerprints within `max_bits` differing bits are linked; `component_id` is the smallest
    doc_id that links reach. Equal fingerprints are one node, so copies are never paired.
    Null and empty texts have fingerprint zero, which is linked like any other. Rows without
    an id get the smallest id of their component too, null if there is none. Repeated rows
    share a component; an empty table gives an empty result; only the named columns are read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, carry=False), "fingerprints")
    return rows.join(classes_of(rows, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of `docs` for each group of near duplicates: the one with the smallest id.

    Rows without an id come last. Of several rows with that id the one with the smallest hash
    of its text stays, and of rows alike in both the first as stored. Fingerprints are computed
    once, with the rows; who stays is settled on narrow rows, and the rows that go are taken
    out of the stored ones. These are few as a rule, so that texts are then not shuffled.
    """
    found = fingerprints(docs, id_col, text_col, shingle, carry=True)
    rows = stored(found.withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    narrow = rows.select("place", "doc_id", "fp", "tie")
    roots = classes_of(narrow, max_bits).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie", "place")
    first = narrow.join(roots, "fp").groupBy("root").agg(F.min(order).alias("first"))
    gone = narrow.select("place").join(first.select("first.place"), "place", "left_anti")
    return rows.join(stored(gone, "duplicates"), "place", "left_anti").select("row.*")
