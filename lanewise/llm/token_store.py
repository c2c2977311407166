"""Token ids in directly addressable codes: byte chunks by level, continuation bits, ranks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import (
    encoded,
    in_chunks,
    ship_package,
    shared_folder,
    splitmix,
    stored,
    texts,
)

MAGIC = b"DAC1"
#: Bits of continuation bitmap per entry of a rank directory.
RANK_BITS = 512
#: Tokens after which a segment is closed at the next document end.
SEGMENT_TOKENS = 1 << 20
#: Bytes of units and their ids that a worker process remembers, about.
CACHE_BYTES = 48 << 20
#: Words that are merged in one text, and places of the table in which units are looked up.
JOINED = 100
TABLE_BITS = 20
#: Texts are encoded in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
END_ID = 0


# The code of one segment. Level k holds the k-th lowest byte of the ids that have one, a bit
# for each that says whether a higher byte follows, and the number of set bits before every
# RANK_BITS bits. Position i of level k continues at position rank_k(i) of level k + 1.


def encode_ids(ids: np.ndarray) -> bytes:
    """The segment's bytes: magic, number of ids, then for each level its size and three arrays."""
    rest, out = ids.astype(np.uint32), [MAGIC, struct.pack("<Q", len(ids))]
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        out += [bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint32(8)
    return b"".join(out + [struct.pack("<Q", 0)])


class Segment:
    """Random access to the ids of an encoded segment; nothing is decoded in advance."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        (self.size,), at = struct.unpack_from("<Q", data, 4), 12
        self.levels = []
        while n := struct.unpack_from("<Q", data, at)[0]:
            at += 8
            chunks, at = np.frombuffer(data, np.uint8, n, at), at + n
            n_ranks = -(-n // RANK_BITS)
            bits = np.frombuffer(data, np.uint8, n_ranks * RANK_BITS // 8, at)
            at += len(bits)
            ranks, at = np.frombuffer(data, "<u4", n_ranks, at), at + 4 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        """The id at position i: one byte per level and one rank query between levels."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end; each level's part is contiguous and found by two ranks."""
        out = np.zeros(max(0, end - start), np.uint32)
        at, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            if start >= end:
                break
            out[at] |= chunks[start:end].astype(np.uint32) << np.uint32(shift)
            first = start >> 3
            flags = np.unpackbits(bits[first : (end + 7) >> 3], bitorder="little")
            at = at[flags[start - 8 * first : end - 8 * first].astype(bool)]
            start = self._rank(bits, ranks, start) if len(at) else 0
            end, shift = start + len(at), shift + 8
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position i: the directory entry and at most RANK_BITS bits."""
        block = i // RANK_BITS
        first = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[first : i >> 3]).sum())
        part = int(bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + whole + part.bit_count()


# Tokenizing. Byte-level BPE cuts a text before it merges anything. Some cuts can be told from
# two neighbouring bytes: between a character that is no white space and white space after it;
# between ASCII letters and digits; and between an ASCII letter or digit and a mark after it,
# but for the apostrophe. What stands between two such cuts is cut alike wherever it stands. So
# texts are split into these units, and each distinct one is encoded once. Texts with white
# space beyond ASCII or the opening of a special token go to the tokenizer whole.

#: Byte-level alphabet: a byte that is no printable Latin-1 character stands as 256 and up.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: What the first character beyond Latin letters is, in code points.
_LATIN = "\u0250"
#: Classes of bytes: white space, letters, digits, marks; all else, with the apostrophe, is 0.
_CLASS = np.zeros(256, np.uint8)
for _class, _bytes in enumerate((b" \t\n\v\f\r", ascii_letters.encode(), b"0123456789", b".,;:!?|()[]*#$%&"), 1):
    _CLASS[list(_bytes)] = _class
#: Whether a unit ends between two bytes of the given classes.
_CUT = np.zeros((5, 5), bool)
_CUT[[0, 2, 3, 4], 1] = True
_CUT[[2, 3, 2, 3], [3, 2, 4, 4]] = True
#: White space of Unicode beyond ASCII, as bytes.
_WIDE_SPACE = re.compile(
    "|".join("\x85 \xa0 \u1680 \u2028 \u2029 \u202f \u205f \u3000".split(" ")).encode()
    + b"|\xe2\x80[\x80-\x8a]"
)


def cuts_at_gaps(tokenizer) -> bool:
    """Whether the tokenizer cuts as described: byte-level BPE without an added blank."""
    state = json.loads(tokenizer.to_str())
    before = state["pre_tokenizer"] or {}
    return (
        state["model"]["type"] == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and state["normalizer"] is None
    )


def letters_stay_apart(tokenizer) -> bool:
    """Whether no merge joins the digit 0 and anything but a blank, so that it can separate words."""
    merges = json.loads(tokenizer.to_str())["model"]["merges"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
    return all("0" not in a + b or set(a + b) <= set("\u01200123456789.,") for a, b in pairs)


class WordCache:
    """Ids of texts from the given byte-level BPE tokenizer, unit by unit where that is exact.

    Units and their ids are kept in flat arrays. A unit is looked up by a hash of its bytes in
    a table with one place per hash, and compared byte by byte with what stands there. Beyond
    `limit` bytes all is forgotten; frequent units are the first to come back.
    """

    def __init__(self, tokenizer, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = tokenizer, limit
        self.merges = Tokenizer(tokenizer.model)  # the same model for words that are cut already
        self.units, self.joins = cuts_at_gaps(tokenizer), letters_stay_apart(tokenizer)
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.keys, self.ids = Flat(np.uint8), Flat(np.uint32)

    def encode(self, values: list) -> list[bytes]:
        """The ids of each text (str or UTF-8), as little-endian 32-bit integers."""
        values = [v.encode() if isinstance(v, str) else v for v in values]
        ids, counts = self.encode_all(values)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text; texts in pieces of bounded size."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(values), np.int64)
        for owners, parts in _pieces(values):
            whole = [not self.units or b"<|" in p or _WIDE_SPACE.search(p) is not None for p in parts]
            ids, n = self._by_units([b"" if w else p for p, w in zip(parts, whole)])
            if any(whole):
                ids = self._spliced(ids, n, whole, [p for p, w in zip(parts, whole) if w])
            out.append(ids)
            np.add.at(counts, owners, n)
            if self.keys.size + self.ids.size * 4 + len(self.keys) * 16 > self.limit:
                self._clear()
        return np.concatenate(out) if out else np.empty(0, np.uint32), counts

    def _spliced(self, ids: np.ndarray, n: np.ndarray, whole: list[bool], texts: list[bytes]) -> np.ndarray:
        """The ids with those of the texts that are encoded whole in their places; n is completed."""
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        pieces, rest = np.split(ids, np.cumsum(n)[:-1]), iter(coded)
        for i in np.flatnonzero(whole):
            pieces[i] = np.array(next(rest).ids, np.uint32)
            n[i] = len(pieces[i])
        return np.concatenate(pieces)

    def _by_units(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(parts)
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(parts), np.int64)
        lengths = np.array([len(p) for p in parts])
        text_starts = np.cumsum(lengths) - lengths
        kind = _CLASS[raw]
        first = np.empty(len(raw), bool)
        first[1:] = _CUT.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
        first[text_starts[lengths > 0]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(raw)))
        slots = self._slots(data, raw, starts, sizes)
        ids, n = self.ids.take(slots)
        # Ids of a text: what its units have.
        upto = np.concatenate(([0], np.cumsum(n)))
        unit = np.searchsorted(starts, text_starts), np.searchsorted(starts, text_starts + lengths)
        return ids, upto[unit[1]] - upto[unit[0]]

    def _slots(self, data: bytes, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each unit's ids are; those of unknown units are added."""
        hashes = _unit_hashes(raw, starts, sizes)
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slots = self.table[at]
        known = slots >= 0
        known[known] = self.keys.equal(slots[known], raw, starts[known], sizes[known])
        new = np.flatnonzero(~known)
        if len(new):
            _, one, kind = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            units = Flat.of(raw, starts[one], sizes[one])
            if not units.equal(kind, raw, starts[new], sizes[new]).all():
                one, kind = new, np.arange(len(new))  # two units of one hash: each for itself
            heads, tails = starts[one].tolist(), (starts + sizes)[one].tolist()
            added = self._learn([data[a:b] for a, b in zip(heads, tails)])
            self.table[at[one]] = added
            slots[new] = added[kind]
        return slots

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Encode units and keep them; returns their slots. Runs of letters go many at a time."""
        plain, latin, others = [], [], []
        for i, unit in enumerate(units):
            word = unit[1:] if unit[:1] == b" " else unit
            if self.joins and word.isalpha():
                plain.append(i)
            elif self.joins and _latin_letters(word):
                latin.append(i)
            else:
                others.append(i)
        slots, n = np.empty(len(units), np.int32), len(self.keys)
        for chosen, encode in ((plain, self._ascii_ids), (latin, self._latin_ids), (others, self._any_ids)):
            if chosen:
                part = [units[i] for i in chosen]
                self.ids.add(*encode(part))
                self.keys.add(np.frombuffer(b"".join(part), np.uint8), np.array([len(u) for u in part]))
                slots[chosen] = np.arange(n, n + len(part))
                n += len(part)
        return slots

    def _ascii_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._merged(
            [b"0".join(units[i : i + JOINED]).decode().replace(" ", "\u0120") for i in range(0, len(units), JOINED)]
        )

    def _latin_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._merged(
            [
                b"0".join(units[i : i + JOINED]).decode("latin-1").translate(_ALPHABET)
                for i in range(0, len(units), JOINED)
            ]
        )

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words joined by a digit that no merge goes across."""
        (cut,) = self.merges.encode("0", add_special_tokens=False).ids
        coded = self.merges.encode_batch_fast([t + "0" for t in texts], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        ends = np.flatnonzero(ids == cut)
        return ids[ids != cut], np.diff(np.append(-1, ends)) - 1

    def _any_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
        parts = [c.ids for c in coded]
        return np.array([i for p in parts for i in p], np.uint32), np.array([len(p) for p in parts])


class Flat:
    """Many short arrays in one, which grows at the end."""

    def __init__(self, dtype):
        self.values, self.ends, self.n, self.size = np.empty(1 << 12, dtype), np.zeros(1 << 10, np.int64), 0, 0

    def __len__(self) -> int:
        return self.n

    @classmethod
    def of(cls, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Flat:
        flat = cls(raw.dtype)
        flat.add(raw[_ragged(starts, sizes)], sizes)
        return flat

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.size + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while self.n + 1 + len(counts) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.size : self.size + len(values)] = values
        self.ends[self.n + 1 : self.n + 1 + len(counts)] = self.size + np.cumsum(counts)
        self.n, self.size = self.n + len(counts), self.size + len(values)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen arrays after each other, and their lengths."""
        begin = self.ends[which]
        counts = self.ends[which + 1] - begin
        return self.values[_ragged(begin, counts)], counts

    def equal(self, which: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the chosen arrays are the given parts of `raw`."""
        begin = self.ends[which]
        same = self.ends[which + 1] - begin == sizes
        if same.any():
            part = starts[same], sizes[same]
            bytes_equal = self.values[_ragged(begin[same], part[1])] == raw[_ragged(*part)]
            same[same] = np.logical_and.reduceat(bytes_equal, np.cumsum(part[1]) - part[1])
        return same


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all parts after each other; no part is empty where they are compared."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    both = []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, factor, np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


def _unit_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A polynomial of each unit's bytes, from one running sum over all of them."""
    power, inverse = _powers(1 << max(PIECE_BYTES, len(raw)).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
    parts = (sums[starts + sizes] - sums[starts]) * inverse[starts]
    return splitmix(parts)


def _latin_letters(word: bytes) -> bool:
    if not word or word.isascii():
        return False
    text = word.decode()
    return text.isalpha() and max(text) < _LATIN


def _pieces(values: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of about PIECE_BYTES together; a longer one is cut where a word ends."""
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, value in enumerate(values):
        at = 0
        while at < len(value):
            end = at + PIECE_BYTES - size
            if end < len(value):
                cut = _WORD_END.search(value, max(end - 1, at))
                end = cut.start() + 1 if cut else len(value)
                if b"<|" in value or _WIDE_SPACE.search(value):
                    end = len(value)
            owners.append(i)
            parts.append(value[at:end])
            size, at = size + min(end, len(value)) - at, end
            if size >= PIECE_BYTES:
                yield owners, parts
                owners, parts, size = [], [], 0
    if owners:
        yield owners, parts


#: A word's last byte: no white space, with a blank behind it.
_WORD_END = re.compile(rb"[^ \t\n\v\f\r](?=[ \t\n\v\f\r])")


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One cache per worker process, of at most CACHE_BYTES: it also serves the tasks that follow."""
    return WordCache(load_tokenizer(path))


def load_tokenizer(path: str):
    # A task has one core; the library must not start a thread for each of the machine's.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    segment_tokens: int = SEGMENT_TOKENS,
    partitions: int | None = None,
) -> str:
    """Encode all texts in ascending id order and write the segments; returns the folder.

    Rows are dealt by ranges of the id (then by text, so that many rows of one id do not meet
    in one task) and sorted. Each task appends its documents, with `end_id` after each, to
    segments of about `segment_tokens` ids that close at a document end. A segment is one row:
    partition, number in it, the documents' ids and lengths, and the encoded ids.

    Null text is empty: the document is `end_id` alone. A null id comes first. Rows with equal
    id and text are interchangeable. The tokenizer file must be readable on every executor.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = ["doc_id", "order"]
    rows = rows.withColumn("order", F.xxhash64("text"))
    n = [partitions] if partitions else []
    dealt = rows.repartitionByRange(*n, *order).sortWithinPartitions(*order)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part int, segment int, doc_ids array<{id_type}>, lengths array<long>, codes binary"

    def run(batches):
        cache = word_cache(tokenizer_path)
        part, segment, held = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        lengths: list[int] = []
        codes: list[bytes] = []
        end = np.array([end_id], "<u4").tobytes()

        def closed():
            joined = np.frombuffer(b"".join(codes), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([ids], pa.list_(id_arrow)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_ids(joined)], pa.binary()),
                ],
                names=["part", "segment", "doc_ids", "lengths", "codes"],
            )

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            doc_ids, values = batch.column("doc_id").to_pylist(), encoded(batch)
            for start, stop in in_chunks(values):
                found = cache.encode(values[start:stop])
                for doc_id, code in zip(doc_ids[start:stop], found):
                    ids.append(doc_id)
                    lengths.append(len(code) // 4 + 1)
                    codes += [code, end]
                    held += lengths[-1]
                    if held >= segment_tokens:
                        yield closed()
                        segment, held = segment + 1, 0
                        ids, lengths, codes = [], [], []
        if ids:
            yield closed()

    folder = shared_folder(spark, "tokens")
    dealt.select("doc_id", "text").mapInArrow(run, schema).write.option(
        "compression", "none"
    ).parquet(folder)
    return folder


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """`start` (tokens of all earlier segments), `part, segment, doc_ids, lengths, codes`."""
    segments = spark.read.parquet(folder)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = segments.select("part", "segment", size.alias("n"))
    # Tokens before a partition: one row per partition. Within it: one row per segment.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.join(parts, "part")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
        .select("part", "segment", "start")
    )
    # Stored, so that its size is known before the codes would be shuffled for the join.
    return segments.join(stored(starts, "token-starts"), ["part", "segment"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` per document, from the stored segments alone."""
    ship_package(spark)
    segments = read_segments(spark, folder)
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment, at = Segment(row["codes"]), 0
                starts, sums = [], []
                for n in row["lengths"]:
                    starts.append(row["start"] + at)
                    sums.append(zlib.crc32(segment.slice(at, at + n).astype("<u4").tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array(starts, pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "doc_ids", "lengths", "codes").mapInArrow(
        run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )


def token_at(spark: SparkSession, folder: str, position: int) -> int | None:
    """The id at a position of the whole corpus: its segment is found by start, then one access."""
    ship_package(spark)
    segments = read_segments(spark, folder)
    rows = segments.where(F.col("start") <= position).orderBy(F.col("start").desc()).limit(1).collect()
    if not rows:
        return None
    segment = Segment(bytes(rows[0]["codes"]))
    i = position - rows[0]["start"]
    return segment[i] if i < len(segment) else None
