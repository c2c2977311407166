"""Exact repeated passages: fixed-block anchors, rolling probes, extension to whole windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import units
from lanewise.llm.common import splitmix
from lanewise.llm.hashing import token_hashes

WINDOW = 35
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of all runs of a length in a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = _BASE
        np.cumprod(powers, out=powers)
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = _INVERSE
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return splitmix((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])


class Passages:
    """Word positions of a unit's texts, one after another, and the starts that stay in a text."""

    def __init__(self, values: list[bytes]):
        words, self.counts = token_hashes(values)
        self.rolling = Rolling(words)
        self.ends = np.cumsum(self.counts)
        self.first = np.repeat(self.ends - self.counts, self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(len(words))

    def starts(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.left >= length)


def block_size(window: int) -> int:
    """The longest block such that every window covers a whole one, wherever it starts."""
    return (window + 1) // 2


def probes(page: Passages, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all rolling probes, their hashes, and which of them are reference blocks."""
    block = block_size(window)
    starts = page.starts(block)
    return starts, page.rolling.at(starts, block), (starts - page.first[starts]) % block == 0


def _short(keys: np.ndarray) -> np.ndarray:
    """Anchors are compared by the bucket and 32 more bits; a chance hit is only a candidate."""
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def anchor_keys(values: list[bytes], window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit's distinct anchor keys in order, and for each probe its key's place and more."""
    page = Passages(values)
    starts, hashes, aligned = probes(page, window)
    # Only the bucket and 32 bits are kept, so keys are distinct and sorted in that form.
    form = (units.bucket_of(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    keys, place = np.unique(form, return_inverse=True)
    blocks = np.bincount(place[aligned], minlength=len(keys))
    return keys, place, blocks


def ask_anchors(table: DataFrame, window: int, buckets: int) -> DataFrame:
    """`bucket, unit, keys, one, more`: every rolling probe, marked where it is a block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, blocks = anchor_keys(units.unpacked(row["texts"], row["sizes"]), window, buckets)
                edges = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                out = []
                for b in range(buckets):
                    part = slice(edges[b], edges[b + 1])
                    if part.start < part.stop:
                        n = blocks[part]
                        out.append((b, _short(keys[part]).tobytes(), units.pack_bits(n == 1), units.pack_bits(n > 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, *_ in out], pa.int32()),
                        pa.array([row["unit"]] * len(out), pa.int64()),
                        *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)],
                    ],
                    names=["bucket", "unit", "keys", "one", "more"],
                )

    return table.select("unit", "sizes", "texts").mapInArrow(
        run, "bucket int, unit long, keys binary, one binary, more binary"
    )


def answer_anchors(asked: pa.Table) -> pa.Table:
    """Of each unit's keys: which are a reference block, and which are several."""
    rows = asked.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    blocks = []
    for r, k in zip(rows, keys):
        one, more = units.unpack_bits(r["one"], len(k)), units.unpack_bits(r["more"], len(k))
        blocks += [k[one], k[more], k[more]]
    index, counts = np.unique(np.concatenate(blocks), return_counts=True)
    any_, several = [], []
    for k in keys:
        at = np.searchsorted(index, k)
        known = (np.append(index, 0)[at] == k) & (at < len(index))
        any_.append(units.pack_bits(known))
        several.append(units.pack_bits(known & (np.append(counts, 0)[at] > 1)))
    return pa.table(
        {
            "unit": pa.array([r["unit"] for r in rows], pa.int64()),
            "step": pa.array([1] * len(rows), pa.int32()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "yes": pa.array(any_, pa.binary()),
            "more": pa.array(several, pa.binary()),
        }
    )


ANSWER = "unit long, step int, bucket int, yes binary, more binary"


def _answered(answers: list[dict], step: int, edges: np.ndarray, name: str) -> np.ndarray:
    """The answer bits of all buckets, in the order of the keys."""
    flags = np.zeros(edges[-1], bool)
    for a in answers:
        if a["step"] == step:
            part = slice(edges[a["bucket"]], edges[a["bucket"] + 1])
            flags[part] = units.unpack_bits(a[name], part.stop - part.start)
    return flags


def candidates(values: list[bytes], answers: list[dict], window: int, buckets: int) -> tuple[Passages, np.ndarray]:
    """Starts of the windows that cover an anchor: a probe that equals a block elsewhere."""
    page = Passages(values)
    starts, hashes, aligned = probes(page, window)
    form = (units.bucket_of(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    keys, place = np.unique(form, return_inverse=True)
    edges = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    known, several = (_answered(answers, 1, edges, name)[place] for name in ("yes", "more"))
    # A block itself counts as a hit only if there is another such block.
    hit = np.where(aligned, several, known)
    before = np.zeros(len(page.left) + 1, np.int64)
    marks = np.zeros(len(page.left), bool)
    marks[starts] = hit
    np.cumsum(marks, out=before[1:])
    whole = page.starts(window)
    reach = window - block_size(window) + 1
    return page, whole[before[whole + reach] > before[whole]]


def window_keys(page: Passages, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = page.rolling.at(starts, window)
    return np.unique(hashes, return_inverse=True, return_counts=True)


def ask_windows(unit: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    """`bucket, unit, keys, more`: hashes of the candidate windows, and those found twice here."""
    out = []
    told = answers.to_pylist()
    for row in unit.to_pylist():
        page, starts = candidates(units.unpacked(row["texts"], row["sizes"]), told, window, buckets)
        keys, _, counts = window_keys(page, starts, window)
        edges = units.cuts(keys, buckets)
        for b in range(buckets):
            part = slice(edges[b], edges[b + 1])
            if part.start < part.stop:
                out.append((b, row["unit"], keys[part].tobytes(), units.pack_bits(counts[part] > 1)))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ("bucket", "unit", "keys", "more")
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})


def answer_windows(asked: pa.Table) -> pa.Table:
    """Of each unit's windows: which occur at least twice in the corpus."""
    rows = asked.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    twice = [k[units.unpack_bits(r["more"], len(k))] for r, k in zip(rows, keys)]
    index, counts = np.unique(np.concatenate(keys + twice), return_counts=True)
    repeated = index[counts > 1]
    return pa.table(
        {
            "unit": pa.array([r["unit"] for r in rows], pa.int64()),
            "step": pa.array([2] * len(rows), pa.int32()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "yes": pa.array([units.pack_bits(np.isin(k, repeated, assume_unique=True)) for k in keys], pa.binary()),
            "more": pa.array([b""] * len(rows), pa.binary()),
        }
    )


def cleaned(unit: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    """Per text: its words, how many lie in repeated windows, and the others joined by blanks."""
    told, parts = answers.to_pylist(), []
    for row in unit.to_pylist():
        values = units.unpacked(row["texts"], row["sizes"])
        page, starts = candidates(values, told, window, buckets)
        keys, place, _ = window_keys(page, starts, window)
        repeated = starts[_answered(told, 2, units.cuts(keys, buckets), "yes")[place]]
        change = np.zeros(len(page.left) + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + window, -1)
        gone = np.cumsum(change)[:-1] > 0
        n_removed, kept = [], []
        for value, n, end in zip(values, page.counts.tolist(), page.ends.tolist()):
            mask = gone[end - n : end]
            n_removed.append(int(mask.sum()))
            words = value.split()
            if n_removed[-1]:
                words = [w for w, drop in zip(words, mask.tolist()) if not drop]
            kept.append(b" ".join(words))
        parts.append(
            pa.table(
                {
                    "doc_id": pa.array(row["doc_ids"], unit.schema.field("doc_ids").type.value_type),
                    "n_words": pa.array(page.counts, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )
        )
    if not parts:  # answers without a unit do not occur; a group always has its unit
        return pa.table({"doc_id": [], "n_words": [], "n_removed": [], "kept": []})
    return pa.concat_tables(parts)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """`doc_id, n_words, n_removed, kept` per row, `kept` being the kept words joined by a blank.

    A word goes if a run of `window` words around it also starts anywhere else, in the same
    text or another. Each text is cut into reference blocks of half a window; every rolling
    run of that length is probed against the blocks of all texts. A repeated window covers a
    block of its other occurrence, so it shows up as a hit; windows around hits are then
    compared whole, and the union of those that occur twice is the maximal repeats.

    Null and empty texts have no words. Repeated rows are occurrences of each other. Texts
    shorter than a window lose nothing. An empty table gives none. No pairs are formed and a
    passage costs one key per unit, however many texts share it.
    """
    table = units.store_units(docs, id_col, text_col, "substring-units")
    total = table.agg(F.sum("n_words")).first()[0] or 0
    buckets = units.buckets_for(total)
    asked = ask_anchors(table, window, buckets)
    answers = asked.groupBy("bucket").applyInArrow(answer_anchors, ANSWER)
    answers = units.stored(answers, "substring-answers")
    grouped = lambda t: t.groupBy("unit")
    candidate = grouped(table).cogroup(grouped(answers)).applyInArrow(
        lambda unit, told: ask_windows(unit, told, window, buckets),
        "bucket int, unit long, keys binary, more binary",
    )
    repeated = units.stored(
        candidate.groupBy("bucket").applyInArrow(answer_windows, ANSWER), "substring-answers"
    )
    id_type = table.schema["doc_ids"].dataType.elementType.simpleString()
    return (
        grouped(table)
        .cogroup(grouped(answers.union(repeated)))
        .applyInArrow(
            lambda unit, told: cleaned(unit, told, window, buckets),
            f"doc_id {id_type}, n_words long, n_removed long, kept string",
        )
    )
