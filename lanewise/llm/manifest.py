"""Merkle manifest of a dataset: a streaming append with incremental witnesses, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import ship_package, stored

ARITY = 8
#: Levels of the tree within a block; a block has ARITY ** BLOCK_LEVELS leaves and is one group.
BLOCK_LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class WitnessTree:
    """A tree that grows by appending nodes, with the witnesses of its leaves up to date.

    Each level has one open run of up to `arity` subtrees. A leaf's witness lists the digests
    left and right of its ancestors, as far as their runs are complete. When a run completes,
    the witnesses below it are extended by the siblings, and the run's digest is appended to
    the next level.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, list[list]]]] = [[]]

    def append(self, node: str, *witnesses: list) -> None:
        self._append(0, node, list(witnesses))

    def _append(self, level: int, node: str, witnesses: list[list]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, witnesses))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, witnesses) in enumerate(run):
            siblings = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for witness in witnesses:
                witness.append(siblings)
        below = [witness for _, witnesses in run for witness in witnesses]
        self._append(level + 1, digest("".join(nodes)), below)

    def close(self, height: int | None = None) -> str:
        """Complete the open runs, up to `height` or until one node remains; the digest there."""
        level = 0
        while True:
            last = not any(self.open[level + 1 :])
            if level == height or (height is None and last and len(self.open[level]) == 1):
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def _height(n: int, block: int, levels: int) -> int | None:
    """Blocks of a tree of several all have the same height, also the last, shorter one."""
    return levels if n > block else None


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of the values: `-` for a null, else their UTF-8 byte count, a colon and the value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        named = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(named))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """`tree, index, n, node`: one row per block, to be appended to the next tree of blocks."""
    block = ARITY**levels

    def root(key: tuple, group: pa.Table) -> pa.Table:
        n = group["n"][0].as_py()
        tree = WitnessTree()
        for node in group.sort_by("index")["node"].to_pylist():
            tree.append(node)
        row = {"tree": key[0].as_py(), "index": key[1].as_py(), "n": -(-n // block)}
        return pa.Table.from_pylist([{**row, "node": tree.close(_height(n, block, levels))}])

    schema = "tree long, index long, n long, node string"
    return _blocks(nodes.select("tree", "index", "n", "node"), levels).applyInArrow(root, schema)


def _blocks(nodes: DataFrame, levels: int):
    return nodes.groupBy("tree", F.floor(F.col("index") / ARITY**levels).alias("block"))


def _append_blocks(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every pass, from leaves to blocks of blocks, and one root per tree."""
    passes = []
    while True:
        passes.append(nodes)
        nodes = stored(_block_roots(nodes, levels), "manifest-blocks")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return passes, nodes


def _extend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The nodes with `path`: the siblings inside their block, then the block's own path.

    `above` has one row per block: tree, index, path and the columns that all nodes take over.
    """
    block = ARITY**levels
    kept = [c for c in nodes.columns if c != "n"]
    taken = [c for c in above.columns if c not in ("tree", "index", "node", "path")]
    schema = T.StructType([*(nodes.schema[c] for c in kept), *(above.schema[c] for c in taken)]).add(
        "path", T._parse_datatype_string(PATH)
    )

    def witnesses(key: tuple, group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("index").combine_chunks()
        tree, found = WitnessTree(), [[] for _ in range(len(group))]
        for node, witness in zip(group["node"].to_pylist(), found):
            tree.append(node, witness)
        tree.close(_height(group["n"][0].as_py(), block, levels))
        rest = [(step["left"], step["right"]) for step in upper["path"][0].as_py()]
        left = pa.array([step[0] for witness in found for step in (*witness, *rest)], pa.string())
        right = pa.array([step[1] for witness in found for step in (*witness, *rest)], pa.string())
        ends = [0]
        for witness in found:
            ends.append(ends[-1] + len(witness) + len(rest))
        steps = pa.StructArray.from_arrays([left, right], names=["left", "right"])
        columns = {c: group[c] for c in kept}
        for c in taken:
            columns[c] = pa.array([upper[c][0].as_py()] * len(group), upper[c].type)
        columns["path"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        return pa.table(columns)

    return (
        _blocks(nodes, levels)
        .cogroup(above.groupBy("tree", "index"))
        .applyInArrow(witnesses, schema)
    )


def _extend_down(passes: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    for nodes in reversed(passes):
        above = _extend(nodes, above, levels)
    return above


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    columns: Sequence[str] = COLUMNS,
    presented: Column | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """`doc_id, leaf, subroot, root, path` for every row, and `presented` where it is given.

    Every row is a leaf. Per value of `tree_col` the leaves ascend by id; runs of eight nodes
    become their digest until one remains, the subroot. Subroots by that value, null first,
    become the root in the same way. `path` holds the digests left and right of the leaf and of
    each of its ancestors. `presented` is the digest of the leaf as somebody else holds it.

    Leaves are ordered by one range exchange and appended in aligned blocks of 4,096, each in
    one task; the block roots are appended in the same way, and a witness inside a block is
    extended by that of its root. Rows without an id come first, equal ids go by the leaf's
    digest. A null or empty value has a digest of its own, a null tree value is a tree.
    An empty table gives an empty table. Only the named columns are read.
    """
    ship_package(docs.sparkSession)
    leaf = leaf_of([docs[c] for c in columns])
    more = [] if presented is None else [presented.alias("presented")]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[tree_col].cast("string").alias("name"), leaf.alias("node"), *more)
    # Stored before the range exchange, which reads its input twice.
    rows = stored(rows, "manifest-leaves")
    order = F.col("name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("node")
    rows = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "manifest-sorted")
    part = F.shiftright("at", 33)

    # One row per tree and partition of the order, then one per tree.
    runs = rows.groupBy("name", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    runs = stored(runs, "manifest-runs")
    names = runs.groupBy("name").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("name").asc_nulls_first())) - 1
    names = stored(names.select("name", "n", number.cast("long").alias("tree")), "manifest-trees")
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    runs = stored(
        runs.select("name", "part", start.alias("start"))
        .alias("r")
        .join(names.alias("t"), F.col("r.name").eqNullSafe(F.col("t.name")))
        .select("r.name", "part", "start", "n", "tree"),
        "manifest-starts",
    )
    leaves = (
        rows.alias("l")
        .join(runs.alias("r"), (part == F.col("part")) & F.col("l.name").eqNullSafe(F.col("r.name")))
        .select(
            "tree",
            (F.col("start") + F.col("at")).alias("index"),
            "n",
            "doc_id",
            "node",
            *(["presented"] if more else []),
        )
    )
    passes, subroots = _append_blocks(leaves, levels)
    trees = subroots.agg(F.count("*")).first()[0]
    top = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("index"),
        F.lit(trees).cast("long").alias("n"),
        "node",
    )
    top_passes, root = _append_blocks(top, levels)
    no_path = F.array().cast(PATH).alias("path")
    above = root.select("tree", "index", F.col("node").alias("root"), no_path)
    above = _extend_down(top_passes, above, levels).select(
        F.col("index").alias("tree"),
        F.lit(0).cast("long").alias("index"),
        F.col("node").alias("subroot"),
        "root",
        "path",
    )
    found = _extend_down(passes, above, levels)
    return found.withColumnRenamed("node", "leaf").drop("tree", "index")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    steps = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    parent = lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256)
    return F.aggregate(path, leaf, parent)
