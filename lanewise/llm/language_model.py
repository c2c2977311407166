"""Trigram language model in Elias-Fano tries, one per bucket of contexts."""

from __future__ import annotations

import mmap
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import units
from lanewise.llm.common import LOWER, in_chunks, splitmix
from lanewise.llm.elias_fano import EliasFano
from lanewise.llm.hashing import token_hashes

#: Stand-ins for the start and the end of a text, which no word's hash equals.
START, END = np.uint64(1), np.uint64(2)
#: Added to each unigram count.
ADDED = 0.1
#: Taken from each bigram and trigram count and given to the next lower order.
DISCOUNT = 0.75
#: A word with one in this many of a unit's tokens may be frequent in all; with many buckets
#: the share is lower, as a bucket then has less room for a context.
FREQUENT = 2_000
#: Quantised probabilities: codes 1 to 255 over so many decades below 1; 0 is unseen.
DECADES = 14.0
_STEP = DECADES / 254


def quantised(p: np.ndarray) -> np.ndarray:
    return (255 - np.clip(np.round(-np.log10(p) / _STEP), 0, 254)).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(255.0 - codes) * _STEP), 0.0)


def is_held_out(doc_id, modulus: int = 10) -> bool:
    """As crc32 of the id's text says; rows without an id teach nothing."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == 0


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them."""
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, place.astype(np.int32)


def _numbered_pairs(first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First parts and words of the distinct pairs in order, and each pair's place."""
    pairs, place = _numbered(first.astype(np.uint64) << np.uint64(32) | word)
    return (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), place


class Grams:
    """The bigrams of a unit: each word, and the end of each text, after what precedes it; and
    its trigrams: each token but a text's first, after the bigram that precedes it."""

    def __init__(self, values: list[bytes], trigrams: bool = True):
        # A few texts at a time: hashing takes some 30 bytes for each byte of text.
        hashed = [token_hashes([v.translate(LOWER) for v in values[a:b]]) for a, b in in_chunks(values)]
        words = np.concatenate([w for w, _ in hashed] or [np.empty(0, np.uint64)])
        counts = np.concatenate([c for _, c in hashed] or [np.empty(0, np.int64)])
        del hashed
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(values), dtype=np.int32), self.sizes)
        n = len(words) + len(values)
        self.is_end = np.zeros(n, bool)
        self.is_end[ends - 1] = True
        current = np.full(n, END)
        current[~self.is_end] = words
        before = np.full(n, START)
        before[1:][~self.is_end[:-1]] = words
        del words
        # The low half of a hash tells next words apart; places are below 2^32 in a unit.
        current = (current & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.contexts, self.context = _numbered(before)
        later = np.flatnonzero(before != START).astype(np.int32) if trigrams else None
        del before
        self.pair_context, self.pair_word, self.pair = _numbered_pairs(self.context, current)
        if trigrams:
            self.later, self.before = later, self.pair[later - 1]
            self.third_pair, self.third_word, self.third = _numbered_pairs(self.before, current[later])

    def by_bucket(self, buckets: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in the order of their buckets, and where each bucket begins.

        A context's pairs share a bucket; those of a frequent context are dealt by their word.
        """
        spread = np.isin(self.contexts, frequent)[self.pair_context]
        key = np.where(spread, splitmix(self.pair_word), self.contexts[self.pair_context])
        bucket = units.bucket_of(key, buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def thirds_by_bucket(self, order: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigrams in the order of their bigrams, where each bucket begins, and how many each
        bigram has."""
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        fans = np.bincount(self.third_pair, minlength=len(order)).astype(np.uint32)
        upto = np.concatenate(([0], np.cumsum(fans[order], dtype=np.int64)))
        return np.argsort(rank[self.third_pair], kind="stable"), upto[edges], fans


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct neighbours and their numbers, of a sequence in which equal values adjoin."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, int)
    return values[first], np.diff(np.append(first, len(values)))


ASKED = ("contexts", "sizes", "words", "counts", "fans", "thirds", "third_counts")


def ask(table: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """`bucket, unit`, the unit's bigrams (`contexts, sizes, words, counts`) and the trigrams
    under each (`fans, thirds, third_counts`), with training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(units.unpacked(row["texts"], row["sizes"]))
                learn = ~np.array([is_held_out(i) for i in row["doc_ids"]], bool)
                learn = learn[grams.owner]
                counts = np.bincount(grams.pair[learn], minlength=len(grams.pair_word))
                order, edges = grams.by_bucket(buckets, frequent)
                third_order, third_edges, fans = grams.thirds_by_bucket(order, edges)
                third_counts = np.bincount(grams.third[learn[grams.later]], minlength=len(grams.third_word))
                out = []
                for b in range(buckets):
                    part = order[edges[b] : edges[b + 1]]
                    thirds = third_order[third_edges[b] : third_edges[b + 1]]
                    if len(part):
                        contexts, sizes = runs_of(grams.pair_context[part])
                        out.append(
                            (
                                grams.contexts[contexts].tobytes(),
                                sizes.astype(np.uint32).tobytes(),
                                grams.pair_word[part].tobytes(),
                                counts[part].astype(np.uint32).tobytes(),
                                fans[part].tobytes(),
                                grams.third_word[thirds].tobytes(),
                                third_counts[thirds].astype(np.uint32).tobytes(),
                                b,
                            )
                        )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[-1] for o in out], pa.int32()),
                        pa.array([row["unit"]] * len(out), pa.int64()),
                        *[pa.array([o[i] for o in out], pa.binary()) for i in range(len(ASKED))],
                    ],
                    names=["bucket", "unit", *ASKED],
                )

    return table.select("unit", "doc_ids", "sizes", "texts").mapInArrow(
        run, "bucket int, unit long, " + ", ".join(f"{name} binary" for name in ASKED)
    )


class Trie:
    """Contexts, their totals and pointers, their next words and quantised probabilities; then
    the same for each pair of context and next word, with the third words.

    All sequences are monotone: contexts by hash, running totals, running numbers of next
    words (the pointers), and next words counted from their context's rank, third words from
    their pair's place. The levels lie in
    one memory-mapped file without a name, so that pages not in use can leave memory.
    """

    def __init__(
        self,
        contexts: np.ndarray,
        context: np.ndarray,
        words: np.ndarray,
        counts: np.ndarray,
        total: int,
        pair: np.ndarray,
        thirds: np.ndarray,
        third_counts: np.ndarray,
    ):
        totals = np.bincount(context, counts, len(contexts)).astype(np.int64)
        n_next = np.bincount(context, minlength=len(contexts))
        self.levels = {
            "contexts": EliasFano.encode(contexts),
            "totals": EliasFano.encode(np.cumsum(totals)),
            "pointers": EliasFano.encode(np.cumsum(n_next)),
            "next": EliasFano.encode(context.astype(np.uint64) << np.uint64(32) | words),
        }
        self.codes = quantised((counts - DISCOUNT) / max(1, total))
        pair_totals = np.bincount(pair, third_counts, len(words)).astype(np.int64)
        self.levels |= {
            "pair_totals": EliasFano.encode(np.cumsum(pair_totals)),
            "pair_pointers": EliasFano.encode(np.cumsum(np.bincount(pair, minlength=len(words)))),
            "third": EliasFano.encode(pair.astype(np.uint64) << np.uint64(32) | thirds),
        }
        self.third_codes = quantised((third_counts - DISCOUNT) / pair_totals[pair])
        self._map()

    def _map(self) -> None:
        arrays = [a for level in self.levels.values() for a in level.arrays()]
        arrays += [self.codes, self.third_codes]
        with tempfile.TemporaryFile() as file:
            starts = []
            for a in arrays:
                file.write(b"\0" * (-file.tell() % 8))
                starts.append(file.tell())
                file.write(a.tobytes())
            file.write(b"\0" * 8)
            file.flush()
            self.file = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.file, np.uint8, a.size, at) for a, at in zip(arrays, starts)]
        for level in self.levels.values():
            low, high = views.pop(0), views.pop(0)
            level.low, level.high = low.reshape(level.low.shape), high.view(np.uint64)
        self.codes, self.third_codes = views

    def _sums(self, rank: np.ndarray, totals: str, pointers: str) -> tuple[np.ndarray, np.ndarray]:
        """Training count and number of different next words of each rank; 0, 0 for -1."""
        known = np.flatnonzero(rank >= 0)
        out = []
        for name in (totals, pointers):
            level, values = self.levels[name], np.zeros(len(rank), np.int64)
            upto = level[rank[known]].astype(np.int64)
            before = np.where(rank[known] > 0, level[np.maximum(rank[known] - 1, 0)].astype(np.int64), 0)
            values[known] = upto - before
            out.append(values)
        return out[0], out[1]

    def _next(self, level: str, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each word after what has that rank, -1 if unseen."""
        out = np.full(len(rank), -1, np.int64)
        known = np.flatnonzero(rank >= 0)
        out[known] = self.levels[level].find(rank[known].astype(np.uint64) << np.uint64(32) | words[known])
        return out

    def of_contexts(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, training count and number of different next words; -1, 0, 0 if unknown."""
        rank = self.levels["contexts"].find(contexts)
        return rank, *self._sums(rank, "totals", "pointers")

    def of_pairs(self, rank: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and code of each word after the context of that rank (-1 and 0 if unseen), and
        the share of probability that the pair leaves to the lower order."""
        at = self._next("next", rank, words)
        totals, n_next = self._sums(at, "pair_totals", "pair_pointers")
        rest = np.where(totals > 0, DISCOUNT * n_next / np.maximum(1, totals), 1.0)
        return at, _picked(self.codes, at), rest.astype(np.float32)

    def of_thirds(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Code of each word after the pair at that place, 0 if unseen."""
        return _picked(self.third_codes, self._next("third", at, words))


def _picked(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint8)
    out[at >= 0] = codes[at[at >= 0]]
    return out


ANSWER = (
    "unit long, bucket int, totals binary, n_next binary, codes binary, rests binary,"
    " third_codes binary, known long, frequent array<struct<context:long,total:long,n_next:long>>"
)


def answer(asked: pa.Table, total: int, frequent: np.ndarray) -> pa.Table:
    """Sum the units' counts, build the bucket's trie, and look up what each unit asked for."""
    rows = asked.to_pylist()
    contexts = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
    sizes = [np.frombuffer(r["sizes"], np.uint32) for r in rows]
    words = np.concatenate([np.frombuffer(r["words"], np.uint32) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
    distinct, where = _numbered(np.concatenate(contexts))
    context = np.repeat(where, np.concatenate(sizes))
    pair_context, pair_word, pair = _numbered_pairs(context, words)
    del context, words
    sums = np.bincount(pair, counts, len(pair_word))
    seen = sums > 0
    trained, rank = np.unique(pair_context[seen], return_inverse=True)

    fans = np.concatenate([np.frombuffer(r["fans"], np.uint32) for r in rows])
    thirds = np.concatenate([np.frombuffer(r["thirds"], np.uint32) for r in rows])
    third_first = np.cumsum([0] + [len(r["thirds"]) // 4 for r in rows])
    third_pair, third_word, triple = _numbered_pairs(np.repeat(pair, fans), thirds)
    del thirds, fans
    counts = np.concatenate([np.frombuffer(r["third_counts"], np.uint32) for r in rows])
    third_sums = np.bincount(triple, counts, len(third_word))
    del counts
    third_seen = third_sums > 0
    # Texts to learn from give a trigram and the bigram before it alike, so the bigram is seen.
    place = np.cumsum(seen) - 1
    trie = Trie(
        distinct[trained],
        rank,
        pair_word[seen],
        sums[seen],
        total,
        place[third_pair[third_seen]],
        third_word[third_seen],
        third_sums[third_seen],
    )

    ranks, totals, n_next = trie.of_contexts(distinct)
    at, codes, rests = trie.of_pairs(ranks[pair_context], pair_word)
    third_codes = trie.of_thirds(at[third_pair], third_word)
    is_frequent = np.isin(distinct, frequent)
    partial = [
        {"context": int(distinct[i].view(np.int64)), "total": int(totals[i]), "n_next": int(n_next[i])}
        for i in np.flatnonzero(is_frequent)
    ]
    first = np.cumsum([0] + [len(c) for c in contexts])
    pair_first = np.cumsum([0] + [int(s.sum()) for s in sizes])
    parts = [where[a:b] for a, b in zip(first, first[1:])]
    pair_parts = [pair[a:b] for a, b in zip(pair_first, pair_first[1:])]
    n = len(rows)
    return pa.table(
        {
            "unit": pa.array([r["unit"] for r in rows], pa.int64()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "totals": pa.array([totals[p].tobytes() for p in parts], pa.binary()),
            "n_next": pa.array([n_next[p].tobytes() for p in parts], pa.binary()),
            "codes": pa.array([codes[p].tobytes() for p in pair_parts], pa.binary()),
            "rests": pa.array([rests[p].tobytes() for p in pair_parts], pa.binary()),
            "third_codes": pa.array(
                [third_codes[triple[a:b]].tobytes() for a, b in zip(third_first, third_first[1:])], pa.binary()
            ),
            # What the bucket knows of all its contexts stands in its first row.
            "known": pa.array([int((totals[~is_frequent] > 0).sum())] + [0] * (n - 1), pa.int64()),
            "frequent": pa.array(
                [partial] + [[]] * (n - 1),
                pa.list_(pa.struct([("context", pa.int64()), ("total", pa.int64()), ("n_next", pa.int64())])),
            ),
        }
    )


def scored(unit: pa.Table, answers: pa.Table, model: dict) -> pa.Table:
    """Scores of a unit's texts from the answers to its bigrams."""
    told, parts = answers.to_pylist(), []
    for row in unit.to_pylist():
        grams = Grams(units.unpacked(row["texts"], row["sizes"]))
        order, edges = grams.by_bucket(model["buckets"], model["frequent"])
        third_order, third_edges, _ = grams.thirds_by_bucket(order, edges)
        totals = np.zeros(len(grams.contexts), np.int64)
        n_next, codes = np.zeros_like(totals), np.zeros(len(grams.pair_word), np.uint8)
        rests, third_codes = np.ones(len(grams.pair_word), np.float32), np.zeros(len(grams.third_word), np.uint8)
        for a in told:
            part = order[edges[a["bucket"]] : edges[a["bucket"] + 1]]
            contexts, _ = runs_of(grams.pair_context[part])
            totals[contexts] = np.frombuffer(a["totals"], np.int64)
            n_next[contexts] = np.frombuffer(a["n_next"], np.int64)
            codes[part] = np.frombuffer(a["codes"], np.uint8)
            rests[part] = np.frombuffer(a["rests"], np.float32)
            thirds = third_order[third_edges[a["bucket"]] : third_edges[a["bucket"] + 1]]
            third_codes[thirds] = np.frombuffer(a["third_codes"], np.uint8)
        # A frequent context is spread over buckets; its sums were added up before.
        found = np.searchsorted(model["frequent"], grams.contexts)
        spread = np.flatnonzero(np.append(model["frequent"], START)[found] == grams.contexts)
        spread = spread[found[spread] < len(model["frequent"])]
        totals[spread] = model["frequent_totals"][found[spread]]
        n_next[spread] = model["frequent_next"][found[spread]]

        # A word's own count is its total as the context of what follows it.
        count = np.full(len(grams.pair), model["ends"], np.int64)
        inner = np.flatnonzero(~grams.is_end)
        count[inner] = totals[grams.context[inner + 1]]
        unigram = (count + ADDED) / (model["total"] + ADDED * (model["distinct"] + 1))
        context_total = np.maximum(1, totals)[grams.context]
        seen = restored(codes)[grams.pair] * model["total"] / context_total
        rest = np.where(totals > 0, DISCOUNT * n_next / np.maximum(1, totals), 1.0)[grams.context]
        p = seen + rest * unigram
        p[grams.later] = restored(third_codes)[grams.third] + rests[grams.before] * p[grams.later]
        n = len(row["doc_ids"])
        parts.append(
            pa.table(
                {
                    "doc_id": pa.array(row["doc_ids"], unit.schema.field("doc_ids").type.value_type),
                    "held_out": pa.array([is_held_out(i) for i in row["doc_ids"]], pa.bool_()),
                    "n_tokens": pa.array(grams.sizes, pa.int64()),
                    "n_known": pa.array(np.bincount(grams.owner[count > 0], minlength=n), pa.int64()),
                    "base_score": pa.array(np.bincount(grams.owner, np.log10(unigram), n)),
                    "score": pa.array(np.bincount(grams.owner, np.log10(p), n)),
                }
            )
        )
    return pa.concat_tables(parts)


def survey(table: DataFrame, buckets: int) -> tuple[np.ndarray, int, int]:
    """Frequent contexts, the number of texts learned from, and that of their tokens.

    A context is frequent if one bucket should not hold all its bigrams. Each unit names the
    words above half that share of its tokens, and those above it in all tokens are kept; both
    numbers are bounded by the shares.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(units.unpacked(row["texts"], row["sizes"]), trigrams=False)
                learn = ~np.array([is_held_out(i) for i in row["doc_ids"]], bool)
                counts = np.bincount(grams.context)
                large = np.flatnonzero(counts * max(FREQUENT, 16 * buckets) >= len(grams.context))
                yield pa.RecordBatch.from_pydict(
                    {
                        "context": grams.contexts[large].view(np.int64).tolist() + [None],
                        "n": counts[large].tolist() + [len(grams.context)],
                        "ends": [0] * len(large) + [int(learn.sum())],
                        "learned": [0] * len(large) + [int(grams.sizes[learn].sum())],
                    }
                )

    rows = table.select("doc_ids", "sizes", "texts").mapInArrow(
        run, "context long, n long, ends long, learned long"
    )
    sums = rows.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("n", "ends", "learned")])
    sums = units.stored(sums, "lm-survey")
    total = sums.where(F.col("context").isNull()).first()
    if total is None:
        return np.array([START]), 0, 0
    large = sums.where(F.col("context").isNotNull() & (F.col("n") * 8 * buckets >= total["n"])).collect()
    found = np.array([r["context"] for r in large], np.int64).view(np.uint64)
    return np.unique(np.append(found, START)), total["ends"], total["learned"]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` per row.

    Words are lower-cased in A-Z; every text ends with an end token. Rows whose crc32
    remainder by 10 is 0, or without an id, are held out of training. `base_score` is the
    smoothed unigram log10 probability, `score` that of a trigram model: discounted trigrams,
    the discount given to discounted bigrams, and theirs to the unigrams. A text's first token
    has a bigram only.

    All texts are packed into units. Each unit sends its distinct bigrams, and the trigrams
    under each, with their training counts to buckets of contexts; a bucket sums them, builds
    its trie and answers by successor search. Counts are exact up to equality of 64-bit word hashes; next words are
    told apart by 32 bits within their context. Null text is empty: its one token is the end.
    Repeated rows each count and score alike. An empty table gives none; with nothing to
    learn from, all tokens are equally unknown.
    """
    table = units.store_units(docs, id_col, text_col, "lm-units")
    words = table.agg(F.sum("n_words")).first()[0] or 0
    # A bigram and a trigram per word, and half the keys, as a bucket also holds its trie.
    buckets = units.buckets_for(4 * words)
    frequent, ends, total = survey(table, buckets)
    answers = units.stored(
        ask(table, buckets, frequent)
        .groupBy("bucket")
        .applyInArrow(lambda asked: answer(asked, total, frequent), ANSWER),
        "lm-answers",
    )
    known = answers.agg(F.sum("known")).first()[0] or 0
    sums = (
        answers.select(F.explode("frequent").alias("f"))
        .groupBy("f.context")
        .agg(F.sum("f.total").alias("total"), F.sum("f.n_next").alias("n_next"))
        .collect()
    )
    by_context = {np.int64(r["context"]).view(np.uint64): (r["total"], r["n_next"]) for r in sums}
    frequent_sums = np.array([by_context.get(c, (0, 0)) for c in frequent], np.int64).reshape(-1, 2)
    distinct = known + int((frequent_sums[frequent != START, 0] > 0).sum()) + (ends > 0)
    model = {
        "buckets": buckets,
        "frequent": frequent,
        "frequent_totals": frequent_sums[:, 0],
        "frequent_next": frequent_sums[:, 1],
        "ends": ends,
        "total": total,
        "distinct": distinct,
    }
    id_type = table.schema["doc_ids"].dataType.elementType.simpleString()
    out = (
        table.groupBy("unit")
        .cogroup(answers.drop("known", "frequent").groupBy("unit"))
        .applyInArrow(
            lambda unit, told: scored(unit, told, model),
            f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
