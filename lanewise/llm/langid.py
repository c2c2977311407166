"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import (
    LOWER,
    encoded,
    held_out,
    in_chunks,
    output_schema,
    stored,
    texts,
    with_columns,
)

BUCKETS = 1 << 13
DIMENSIONS = 16
#: Bound of the training sample: documents per language.
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 30
#: A document whose calibrated probability is lower is rejected.
REJECT_BELOW = 0.5
#: Share of the calibration rows that may lie beyond the reach before it is widened.
FALSE_REJECTIONS = 0.01
UNDETERMINED = "und"

#: Letters, lower-cased in ASCII, and all bytes of non-ASCII characters; the rest is a blank.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in LOWER)


def subword_buckets(text: bytes) -> np.ndarray:
    """Bucket of every 3-byte and 4-byte piece of the blank-enclosed words, over the whole text.

    A piece may begin or end with a blank but holds none inside, so it stays in its word.
    """
    data = np.frombuffer(b" " + text.translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    blank = data == 0x20
    three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    found = [three[~blank[1:-1]]]
    if len(data) > 3:
        four = (three[:-1] << 8) | data[3:]
        found.append(four[~(blank[1:-2] | blank[2:-1])] ^ np.uint32(0x5BD1E995))
    pieces = np.concatenate(found) * np.uint32(0x9E3779B1)
    return (pieces >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


@dataclass
class LanguageModel:
    """Log-odds of each bucket (embedding times softmax weights), bias, and temperature.

    For rejection also how usual each bucket is in a language (its log share), the mean and
    spread that texts of the language have of that, and how far below is still accepted.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    usual: np.ndarray
    centre: np.ndarray
    between: np.ndarray
    within: np.ndarray
    reach: float

    def judge(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the softmax of the mean over its pieces, and how many deviations less usual
        the pieces are than those of texts in the likeliest language."""
        logits, unusual = np.zeros((len(values), len(self.languages))), np.zeros(len(values))
        for i, value in enumerate(values):
            buckets, counts = np.unique(subword_buckets(value), return_counts=True)
            n = max(1, counts.sum())
            logits[i] = counts @ self.table[buckets] / n + self.bias
            k = int(logits[i].argmax())
            mean = counts @ self.usual[buckets, k] / n
            unusual[i] = (self.centre[k] - mean) / np.sqrt(self.between[k] + self.within[k] / n)
        return softmax(logits / self.temperature), unusual

    def probabilities(self, values: list[bytes]) -> np.ndarray:
        return self.judge(values)[0]

    def rejects(self, values: list[bytes], below: float) -> np.ndarray:
        """Texts that are no known language's: an unsure choice, or pieces unusual for it."""
        p, unusual = self.judge(values)
        return (p.max(axis=1) < below) | (unusual > self.reach)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows the weights have not seen."""
    grid = np.geomspace(0.2, 20, 121)
    if not len(y):
        return 1.0
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Sample:
    """A training text: its buckets, their shares of its pieces, the number of pieces, the language."""

    buckets: np.ndarray
    shares: np.ndarray
    pieces: int
    lang: int


def fit(sample: list[Sample], languages: list[str], seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent on embeddings and softmax weights; every fifth row calibrates.

    Rows are kept sparse; only those of one step are spread over all buckets.
    """
    rng = np.random.default_rng(seed)
    y = np.array([row.lang for row in sample])
    order = rng.permutation(len(y))
    check, train = order[::5], np.delete(order, np.s_[::5])
    if not len(train):
        train = order
    n = len(languages)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            x = np.zeros((len(batch), BUCKETS), np.float32)
            for i, k in enumerate(batch):
                x[i, sample[k].buckets] = sample[k].shares
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            error = (error / len(batch)).astype(np.float32)
            back = x.T @ (error @ weights.T)
            weights -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            embedding -= rate * 20 * back
    table = embedding.astype(np.float64) @ weights
    logits = np.stack([sample[k].shares @ table[sample[k].buckets] for k in check]) + bias
    return LanguageModel(
        languages,
        table,
        bias.astype(np.float64),
        best_temperature(logits, y[check]),
        *usualness([sample[k] for k in train], [sample[k] for k in check], n),
    )


def usualness(train: list[Sample], check: list[Sample], n: int) -> tuple:
    """Log shares of the buckets per language from the training rows; from the others, per
    language, centre and spread of a text's mean, and of single pieces; and the accepted reach.

    The reach is such that about FALSE_REJECTIONS of the calibration rows lie beyond, widened
    by half for what so few rows cannot show.
    """
    shares = np.zeros((BUCKETS, n))
    for row in train:
        shares[row.buckets, row.lang] += row.shares
    totals = np.maximum(shares.sum(axis=0), 1e-9)
    usual = np.log(shares / totals + 1e-6)
    means = np.array([row.shares @ usual[row.buckets, row.lang] for row in check])
    squares = np.array([row.shares @ usual[row.buckets, row.lang] ** 2 for row in check])
    pieces = np.array([max(1, row.pieces) for row in check])
    lang = np.array([row.lang for row in check])
    spread = np.maximum(squares - means**2, 0)
    centre, between, within = np.zeros(n), np.ones(n), np.ones(n)
    for k in range(n):
        rows = lang == k if (lang == k).sum() >= 5 else np.ones(len(lang), bool)
        long = rows & (pieces >= np.median(pieces[rows]))
        centre[k], within[k] = np.median(means[long]), spread[rows].mean() + 1e-6
        between[k] = max(((means[long] - centre[k]) ** 2).mean(), 1e-4)
    deviations = (centre[lang] - means) / np.sqrt(between[lang] + within[lang] / pieces)
    reach = 1.5 * max(3.0, float(np.quantile(deviations, 1 - FALSE_REJECTIONS)))
    return usual, centre, between, within, reach


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel | None:
    """Fit on at most `per_language` rows of each language, those first in a hash order.

    Only rows with text and language whose crc32 remainder by 5 is not 0 are used. None if
    there is no such row.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5))
    rank = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "h")
    )
    # The choice is made on narrow rows; texts follow for the chosen ids alone. A share of a
    # language's rows that holds about three times the sample is ranked, not all of them.
    narrow = rows.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    part = F.least(F.lit(1.0), 3.0 * per_language / F.count(F.lit(1))).alias("share")
    # Stored, so that its size is known and the rows are not dealt by language for the join.
    share = stored(narrow.groupBy("lang").agg(part), "language-shares")
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id", "h"), F.lit(1 << 20)) / (1 << 20)
    chosen = (
        narrow.join(share, "lang")
        .where(draw < F.col("share"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= per_language)
        .select("doc_id", "lang", "h")
        .distinct()
    )
    sample = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "lang", "h"])

    def counted(batches):
        for batch in batches:
            found = [
                np.unique(subword_buckets(v), return_counts=True) for v in encoded(batch)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    pa.array([k.astype(np.int32).tobytes() for k, _ in found], pa.binary()),
                    pa.array([(c / max(1, c.sum())).astype(np.float32).tobytes() for _, c in found], pa.binary()),
                    pa.array([int(c.sum()) for _, c in found], pa.int64()),
                ],
                names=["lang", "buckets", "shares", "pieces"],
            )

    found = (
        sample.select("lang", "text")
        .mapInArrow(counted, "lang string, buckets binary, shares binary, pieces long")
        .orderBy("lang", "buckets", "shares")
        .collect()
    )
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    numbers = {lang: i for i, lang in enumerate(languages)}
    sample = [
        Sample(
            np.frombuffer(r["buckets"], np.int32),
            np.frombuffer(r["shares"], np.float32),
            r["pieces"],
            numbers[r["lang"]],
        )
        for r in found
    ]
    return fit(sample, languages)


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    reject_below: float = REJECT_BELOW,
    carry: bool = False,
) -> DataFrame:
    """`doc_id, lang_pred, score, rejected` for every row (and `row` with `carry`).

    `score` is the calibrated probability of `lang_pred`. A text that is null or has no letter
    is `und` with score 0 and rejected, as is everything without a model; other rows are
    rejected where the score is under `reject_below`, or where the pieces are less usual in the
    predicted language than those of nearly all texts that calibrated the model. Repeated rows score alike, an empty table
    gives an empty result, and only the named columns are read.
    """
    rows = texts(docs, id_col, text_col, carry)
    schema = output_schema(rows, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in batches:
            values = encoded(batch)
            langs: list[str] = []
            scores: list[float] = []
            rejected: list[bool] = []
            for start, end in in_chunks(values):
                part = values[start:end]
                if learned is None:
                    langs += [UNDETERMINED] * len(part)
                    scores += [0.0] * len(part)
                    rejected += [True] * len(part)
                    continue
                p, unusual = learned.judge(part)
                best = p.argmax(axis=1)
                for value, k, row, far in zip(part, best, p, unusual > learned.reach):
                    known = has_letter(value)
                    langs.append(learned.languages[k] if known else UNDETERMINED)
                    scores.append(float(row[k]) if known else 0.0)
                    rejected.append(not known or bool(far) or scores[-1] < reject_below)
            yield with_columns(
                batch,
                lang_pred=pa.array(langs, pa.string()),
                score=pa.array(scores, pa.float64()),
                rejected=pa.array(rejected, pa.bool_()),
            )

    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose language is recognised, with their columns."""
    judged = identify(docs, train(docs), carry=True, **options)
    return judged.where(~F.col("rejected")).select("row.*")
