"""Units: stored groups of whole texts that exchange hashed keys with buckets and get answers.

A corpus-wide lookup of every word position would move far more rows than texts. Instead each
unit sends its distinct keys, sorted, one row per bucket; a bucket answers in the same order.
The unit table is written once, so an answer always finds the unit that asked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lanewise.llm.common import encoded, stored, texts

#: Bytes of text after which a unit is closed.
UNIT_BYTES = 6 << 20
#: Keys that a bucket should get in all.
BUCKET_KEYS = 3_000_000


def store_units(docs: DataFrame, id_col: str, text_col: str, purpose: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Table of `unit, doc_ids, sizes, texts, n_words`: ids, byte lengths, and compressed texts.

    Null texts are empty. A unit holds whole texts in their order and is bounded by its bytes
    and one text. No row is moved: each task packs what it reads.
    """
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        values: list[bytes] = []
        held = 0

        def closed():
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(values))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([ids], pa.list_(id_arrow)),
                    pa.array([[len(v) for v in values]], pa.list_(pa.int64())),
                    pa.array([packed], pa.binary()),
                    pa.array([sum(len(v.split()) for v in values)], pa.int64()),
                ],
                names=["unit", "doc_ids", "sizes", "texts", "n_words"],
            )

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), encoded(batch)):
                ids.append(doc_id)
                values.append(value)
                held += len(value)
                if held >= unit_bytes:
                    yield closed()
                    number, held = number + 1, 0
                    ids, values = [], []
        if ids:
            yield closed()

    schema = f"unit long, doc_ids array<{id_type}>, sizes array<long>, texts binary, n_words long"
    return stored(rows.mapInArrow(run, schema), purpose)


def unpacked(packed: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [data[end - size : end] for size, end in zip(sizes, ends)]


def buckets_for(n_keys: int) -> int:
    return max(1, math.ceil(n_keys / BUCKET_KEYS))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the key's upper half, so sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from bucket to bucket: buckets + 1 places."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)
