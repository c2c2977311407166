"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import encoded, in_chunks, output_schema, stored, texts, with_columns
from lanewise.llm.word_automaton import SEPARATED, UNKNOWN, Automaton, word_pieces

WINDOW = 13
#: Share of a document's words that must lie in hits: one in this many.
HIT_SHARE = 20
#: Bytes of benchmark text in one automaton: about 30 bytes of memory each, 75 while it is built.
BLOCK_BYTES = 4 << 20
#: Blocks broadcast at a time, one after another in the same tasks. More take further rounds.
ROUND_BLOCKS = 16
#: Bytes of documents held while the blocks of a round are gone through.
SPAN_BYTES = 64 << 20
#: Words of one piece of a benchmark item; longer items are cut into overlapping pieces.
PIECE_WORDS = 100_000


def word_spans(text: bytes, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Start and end of word ranges, given by their first and last word, in code points."""
    data = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(SEPARATED), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[2 * first], edges[2 * last + 1]
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    starts, ends = starts - np.searchsorted(inner, starts), ends - np.searchsorted(inner, ends)
    return [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """`item, text`: the distinct items as their words, the long ones in pieces.

    Neighbouring pieces share a window's words less one, so each window is whole in one piece.
    """
    items = texts(benchmark, item_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            names, pieces = [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), encoded(batch)):
                held: list[bytes] = []
                for words in word_pieces(text):
                    held += words
                    while len(held) > PIECE_WORDS:
                        names.append(name)
                        pieces.append(b" ".join(held[:PIECE_WORDS]))
                        held = held[PIECE_WORDS - window + 1 :]
                names.append(name)
                pieces.append(b" ".join(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["item", "text"]
            )

    return items.mapInArrow(run, "item string, text binary").where(F.length("text") > 0).distinct()


def _rounds(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list]:
    """Names and broadcasts of the benchmark's blocks, at most ROUND_BLOCKS at a time.

    Items are dealt to blocks by their hash; the driver holds one block at a time.
    """
    context = benchmark.sparkSession.sparkContext
    pieces = stored(_pieces(benchmark, item_col, text_col, window), "benchmark-pieces")
    size = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for start in range(0, blocks, ROUND_BLOCKS):
        found = []
        for block in range(start, min(blocks, start + ROUND_BLOCKS)):
            rows = pieces.where(number == block).collect()
            packed = [(r["item"], zlib.compress(bytes(r["text"]), 1)) for r in rows]
            found.append((uuid.uuid4().hex, context.broadcast(packed)))
        yield found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    hit_share: int = HIT_SHARE,
    carry: bool = False,
) -> DataFrame:
    """`doc_id, n_words, n_hit, items, spans, contaminated` per row (and `row` with `carry`).

    Words are runs of digits, letters a-z after lower-casing, and non-ASCII characters. Every
    window of `window` item words (a shorter item is one window) is sought in the document's
    words; words inside an occurrence are hit. `items` lists the hit items, sorted as strings;
    `spans` holds start and end of the merged hits in code points of the original text.
    `contaminated`: at least one word in `hit_share` is hit.

    The benchmark is a stated query set. Its automaton is broadcast as text and built once in a
    worker process; documents are scanned without a shuffle. A benchmark above BLOCK_BYTES is
    dealt to blocks: a task holds one block's automaton at a time and leads its documents past
    all of them. Beyond ROUND_BLOCKS blocks, rows are stored with their hits between rounds.

    Null text has no words. An item without an id can be hit but is not listed. Empty tables
    give empty or hit-free results. Repeated rows and items are judged each for itself.
    """
    rows = texts(docs, id_col, text_col, carry)
    schema = output_schema(
        rows,
        ("n_words", "long"),
        ("n_hit", "long"),
        ("items", "array<string>"),
        ("spans", "array<struct<start:long,end:long>>"),
        ("contaminated", "boolean"),
    )
    waiting = None
    for blocks in _rounds(benchmark, item_col, item_text_col, window):
        if waiting is not None:
            partial = T.StructType([f for f in rows.schema.fields if f.name not in FOUND.fieldNames()] + FOUND.fields)
            rows = stored(rows.mapInArrow(_scanned(waiting, window), partial), "decontamination-round")
        waiting = blocks
    return rows.mapInArrow(_judged(waiting, window, hit_share), schema)


#: What a round has found in a row.
RANGE = T.StructType().add("s", "integer").add("e", "integer")
FOUND = T.StructType().add("ranges", T.ArrayType(RANGE)).add("found", T.ArrayType(T.StringType()))
RANGES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

#: The last automaton of this worker process, by its block's name: bounded by BLOCK_BYTES.
_built: dict[str, Automaton] = {}


def _automaton(block: tuple, window: int) -> Automaton:
    name, packed = block
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(item, zlib.decompress(text)) for item, text in packed.value], window)
    return _built[name]


class Hits:
    """What is known of the texts of a batch: words hit, and items."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.values = batch, encoded(batch)
        self.hit: list[np.ndarray | None] = [None] * len(self.values)
        self.n_words = [0] * len(self.values)
        self.items: list[set] = [set() for _ in self.values]
        if "ranges" in batch.schema.names:
            self.earlier = batch.column("ranges").to_pylist()
            self.items = [set(found) for found in batch.column("found").to_pylist()]
        else:
            self.earlier = [[] for _ in self.values]

    def scan(self, machine: Automaton) -> None:
        for a, b in in_chunks(self.values):
            parts = []
            for i in range(a, b):
                ids = machine.ids(self.values[i])
                self.n_words[i] = len(ids)
                parts += [ids, np.full(1, UNKNOWN, np.int32)]
            sequence = np.concatenate(parts)
            # Text by text, words and the place that parts them from the next text.
            bounds = np.cumsum([0] + [self.n_words[i] + 1 for i in range(a, b)])
            ends, nodes = machine.occurrences(sequence)
            if not len(ends):
                continue
            change = np.zeros(len(sequence) + 1, np.int32)
            np.add.at(change, ends + 1 - machine.depth(nodes), 1)
            np.add.at(change, ends + 1, -1)
            covered = np.cumsum(change[:-1]) > 0
            text = np.searchsorted(bounds, ends, side="right") - 1
            for i in np.unique(text).tolist():
                mask = covered[bounds[i] : bounds[i + 1] - 1]
                old = self.hit[a + i]
                self.hit[a + i] = mask.copy() if old is None else old | mask
            for key in np.unique(text << 32 | nodes).tolist():
                names = (machine.names[j] for j in machine.items_of(key & 0xFFFFFFFF))
                self.items[a + (key >> 32)].update(n for n in names if n is not None)

    def ranges(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and places after the last words of the merged hits."""
        mask = self.hit[i]
        if mask is None:
            mask = np.zeros(self.n_words[i] if self.earlier[i] else 0, bool)
        for r in self.earlier[i]:
            mask[r["s"] : r["e"]] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        return edges[::2], edges[1::2]


def _spans_of_batches(batches, limit: int) -> Iterator[list[Hits]]:
    held, size = [], 0
    for batch in batches:
        held.append(Hits(batch))
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(batches, blocks: list, window: int) -> Iterator[Hits]:
    """Batches past all blocks. With one block no batch waits for another."""
    for held in _spans_of_batches(batches, SPAN_BYTES if len(blocks) > 1 else 0):
        for block in blocks:
            machine = _automaton(block, window)
            for hits in held:
                hits.scan(machine)
        yield from held


def _scanned(blocks: list, window: int):
    def run(batches):
        for hits in _found(batches, blocks, window):
            names = [n for n in hits.batch.schema.names if n not in FOUND.fieldNames()]
            ranges = [
                [{"s": s, "e": e} for s, e in zip(*(x.tolist() for x in hits.ranges(i)))] for i in range(len(hits.values))
            ]
            arrays = [hits.batch.column(n) for n in names]
            arrays += [pa.array(ranges, RANGES), pa.array([sorted(x) for x in hits.items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *FOUND.fieldNames()])

    return run


def _judged(blocks: list, window: int, hit_share: int):
    def run(batches):
        for hits in _found(batches, blocks, window):
            n_hit, spans = [], []
            for i, text in enumerate(hits.values):
                first, end = hits.ranges(i)
                n_hit.append(int((end - first).sum()))
                spans.append(word_spans(text, first, end - 1) if len(first) else [])
            yield with_columns(
                hits.batch.select([n for n in hits.batch.schema.names if n not in FOUND.fieldNames()]),
                n_words=pa.array(hits.n_words, pa.int64()),
                n_hit=pa.array(n_hit, pa.int64()),
                items=pa.array([sorted(x) for x in hits.items], pa.list_(pa.string())),
                spans=pa.array(spans, SPANS),
                contaminated=pa.array(
                    [h > 0 and hit_share * h >= n for h, n in zip(n_hit, hits.n_words)], pa.bool_()
                ),
            )

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns."""
    judged = decontaminate(docs, benchmark, carry=True, **options)
    return judged.where(~F.col("contaminated")).select("row.*")
