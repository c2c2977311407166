"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import encoded, held_out, in_chunks, output_schema, splitmix, texts, with_columns
from lanewise.llm.hashing import token_hashes

BUCKETS = 1 << 13
DIMENSIONS = 64
#: Non-zero entries of a word's index vector.
NON_ZERO = 4
#: Words on either side that count as context.
WINDOW = 2
HIDDEN = 32
EPOCHS = 150
#: Bound of the training sample: documents per label.
SAMPLE_PER_LABEL = 2_000
PREDICT_FROM = 0.3
CHUNK_BYTES = 1 << 20
PAGES_AT_ONCE = 64

#: Words are runs of letters, of digits, or of other marks, so that marks have vectors too.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
CLASSES[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = 1
CLASSES[[b for b in range(128) if chr(b).isdigit()]] = 2

_SEEDS = splitmix(np.arange(BUCKETS * NON_ZERO, dtype=np.uint64)).reshape(BUCKETS, NON_ZERO)
INDEX_PLACE = (_SEEDS % np.uint64(DIMENSIONS)).astype(np.int64)
INDEX_SIGN = np.where(_SEEDS >> np.uint64(63), 1.0, -1.0)


def word_buckets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = token_hashes(values, CLASSES)
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), counts


def context_sums(values: list[bytes]) -> np.ndarray:
    """For each bucket, the sum of the index vectors of the words around its words."""
    buckets, counts = word_buckets(values)
    owner = np.repeat(np.arange(len(values)), counts)
    total = np.zeros(BUCKETS * DIMENSIONS)
    for distance in range(1, WINDOW + 1):
        same = owner[distance:] == owner[:-distance]
        left, right = buckets[:-distance][same], buckets[distance:][same]
        for word, context in ((left, right), (right, left)):
            for k in range(NON_ZERO):
                place = word * DIMENSIONS + INDEX_PLACE[context, k]
                total += np.bincount(place, INDEX_SIGN[context, k], BUCKETS * DIMENSIONS)
    return total


def word_vectors(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Word vectors from the contexts of all words of all texts.

    Each task adds up whole numbers per bucket and Spark sums the buckets over the tasks, so
    reruns agree; what reaches the driver has BUCKETS rows whatever the corpus.
    """
    rows = texts(docs, id_col, text_col).where(F.col("text").isNotNull()).select("text")

    def run(batches):
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            values = encoded(batch)
            for start, end in in_chunks(values, CHUNK_BYTES):
                total += context_sums(values[start:end])
        sums = total.astype(np.int64).reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(used)] + [pa.array(sums[used, k]) for k in range(DIMENSIONS)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["bucket"] + [f"v{k}" for k in range(DIMENSIONS)]
    sums = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("bucket")
    found = sums.agg(*[F.sum(n).alias(n) for n in names[1:]]).toPandas()
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    vectors[found["bucket"].to_numpy()] = found[names[1:]].to_numpy(float)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norm, 1)
    return vectors.astype(np.float32)


def pooled(values: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors over each whole text, and how they repeat.

    The last columns are the shares of words that have the vector of the word one or two
    before, and the chance that two words of the text have the same. Zeros without words.
    """
    both = np.concatenate([vectors, vectors**2], axis=1)
    out = np.zeros((len(values), 2 * DIMENSIONS + 3), np.float32)
    for start in range(0, len(values), PAGES_AT_ONCE):
        part = values[start : start + PAGES_AT_ONCE]
        counts = np.zeros((len(part), BUCKETS), np.float32)
        repeats = np.zeros((len(part), 3), np.float32)
        for a, b in in_chunks(part, CHUNK_BYTES):
            buckets, sizes = word_buckets(part[a:b])
            owner = np.repeat(np.arange(b - a), sizes)
            for distance in (1, 2):
                same = (buckets[distance:] == buckets[:-distance]) & (owner[distance:] == owner[:-distance])
                repeats[a:b, distance - 1] = np.bincount(owner[distance:][same], minlength=b - a)
            place = owner * BUCKETS + buckets
            counts[a:b] = np.bincount(place, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        total = np.maximum(1, counts.sum(axis=1, keepdims=True))
        sums = counts @ both / total
        repeats[:, :2] /= total
        repeats[:, 2] = ((counts / total) ** 2).sum(axis=1)
        mean = sums[:, :DIMENSIONS]
        spread = np.sqrt(np.maximum(0, sums[:, DIMENSIONS:] - mean**2))
        out[start : start + len(part)] = np.concatenate([mean, spread, repeats], axis=1)
    return out


@dataclass
class QualityModel:
    """Word vectors, standardisation, two layers, and the temperature of the output."""

    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.shift) / self.scale).astype(np.float64)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, values: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(pooled(values, self.vectors)) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, prior: float, seed: int = 11) -> QualityModel:
    """Adam on the log loss; labels weigh as in the whole table; every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, train = order[::5], np.delete(order, np.s_[::5])
    if not len(train):
        train = order
    shift, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-4
    share = y.mean()
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    p = {
        "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        "b2": np.zeros(1),
    }
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    z = ((x - shift) / scale).astype(np.float64)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            step += 1
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            e = (sigmoid(h @ p["w2"] + p["b2"]) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(e, p["w2"]) * (1 - h**2)
            grads = {
                "w1": z[rows].T @ back + 1e-3 * p["w1"],
                "b1": back.sum(axis=0),
                "w2": h.T @ e + 1e-3 * p["w2"],
                "b2": e.sum(keepdims=True),
            }
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] = p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    model = QualityModel(vectors, shift, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    if len(check):
        logits = model.logits(x[check])
        grid = np.geomspace(0.25, 8, 81)
        model.temperature = float(min(grid, key=lambda t: log_loss(sigmoid(logits / t), y[check])))
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
) -> QualityModel | None:
    """Fit on at most `per_label` documents of each label 0 and 1, the first in a hash order.

    Only ids whose crc32 remainder by 5 is not 0 are used. An id with both labels counts as 0.
    The bound makes the chosen ids fit for a broadcast. None without a labelled document.
    """
    marked = (
        labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), 5))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    totals = dict(marked.groupBy("label").count().collect())
    # A share of a label's ids that holds about three times the sample is ranked, not all.
    share = {label: min(1.0, 3 * per_label / n) for label, n in totals.items()}
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    limit = F.when(F.col("label") == 0, share.get(0, 1.0)).otherwise(share.get(1, 1.0))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (
        marked.where(draw < limit)
        .withColumn("rank", rank)
        .where(F.col("rank") <= per_label)
        .select("doc_id", "label")
    )
    vectors = word_vectors(docs, id_col, text_col)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches):
        for batch in batches:
            x = pooled(encoded(batch), shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.string()),
                    batch.column("label"),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                ],
                names=["id", "label", "x"],
            )

    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    found = (
        rows.select("doc_id", "label", "text")
        .mapInArrow(run, "id string, label int, x binary")
        .orderBy("id")
        .collect()
    )
    if not found:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    y = np.array([r["label"] for r in found], float)
    return fit(x, y, vectors, totals.get(1, 0) / max(1, sum(totals.values())))


def score(
    docs: DataFrame,
    model: QualityModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """`doc_id, score, predicted` for every row (and `row` with `carry`).

    `score` is the calibrated probability of label 1. Null and empty texts are scored like any
    text without words; without a model every score is 0.5. Repeated rows score alike, an empty
    table gives none, and only the named columns are read.
    """
    rows = texts(docs, id_col, text_col, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in batches:
            values = encoded(batch)
            p = learned.scores(values) if learned else np.full(len(values), 0.5)
            yield with_columns(
                batch, score=pa.array(p, pa.float64()), predicted=pa.array((p >= PREDICT_FROM).astype(np.int32))
            )

    return rows.mapInArrow(run, output_schema(rows, ("score", "double"), ("predicted", "int")))
