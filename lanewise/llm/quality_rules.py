"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import encoded, output_schema, texts, with_columns

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
NOT_LETTERS = bytes(b for b in range(128) if b not in LETTERS)
MIN_WORDS = 50
#: One document in this many is in the sample that orders the rules.
SAMPLE_SHARE = 100


class Page:
    """A text and what the rules count in it, each counted when first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.words = text.split()

    def without(self, dropped: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, dropped))

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.decode()) - self.without(BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return self.without(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        covered, end = 0, 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.n_repeat_words > 50 * len(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Page], bool]


#: Thresholds as in published rule sets for web text, exclamation marks and capitals added.
RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > len(p.words)),
    Rule("exclamations", lambda p: 10 * p.text.count(b"!") > len(p.words)),
    Rule("word_length", lambda p: not 3 * len(p.words) <= p.word_chars <= 10 * len(p.words)),
    Rule("capitals", lambda p: 10 * p.without(CAPITALS) > 3 * p.without(LETTERS)),
    Rule("duplicate_lines", lambda p: 2 * p.n_dup_lines > len(p.lines)),
    Rule(
        "words_without_letters",
        lambda p: 5 * sum(w.isascii() and not w.translate(None, NOT_LETTERS) for w in p.words)
        > len(p.words),
    ),
    Rule("one_word", lambda p: 4 * max(Counter(p.words).values(), default=0) > len(p.words)),
)


def measured_order(docs: DataFrame, text_col: str, id_col: str, rules=RULES, share: int = SAMPLE_SHARE) -> list[int]:
    """Rules by falling rejection per second, measured on the documents of a hashed sample.

    Every rule runs on every sampled document that passes the base rules; each task sums its
    seconds and rejections, and only the sums by rule come to the driver. The order decides
    speed, not results. Without a sampled document the declared order holds.
    """
    rows = texts(docs, id_col, text_col).where(F.col("text").isNotNull())
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)

    def run(batches):
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in encoded(batch):
                if Page(text).base_failed:
                    continue
                for k, rule in enumerate(rules):
                    page = Page(text)
                    start = time.perf_counter()
                    rejected[k] += rule.rejects(page)
                    seconds[k] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "s": seconds, "n": rejected})

    sums = sample.mapInArrow(run, "rule long, s double, n long").groupBy("rule").agg(F.sum("s"), F.sum("n"))
    rate = {k: n / s if s else 0.0 for k, s, n in sums.collect()}
    return sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    share: int = SAMPLE_SHARE,
    carry: bool = False,
) -> DataFrame:
    """`doc_id`, the base counts, `base_failed, kept, rejected_by` per row (and `row` with `carry`).

    A text with fewer than 50 words, or more than half of its words in repeated three-word
    windows, fails the base rules; others go through the cascade up to the first rule that
    rejects them (`rejected_by`, which depends on the measured order; `kept` does not). Null
    text has no words and fails. Repeated rows are judged alike; an empty table gives none.
    """
    order = measured_order(docs, text_col, id_col, rules, share)
    cascade = [rules[k] for k in order]
    rows = texts(docs, id_col, text_col, carry)
    counts = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = output_schema(
        rows,
        ("n_words", "long"),
        *[(name, "long") for name in counts],
        ("base_failed", "boolean"),
        ("kept", "boolean"),
        ("rejected_by", "string"),
    )

    def run(batches):
        for batch in batches:
            found: dict[str, list] = {f.name: [] for f in schema.fields if f.name not in batch.schema.names}
            for text in encoded(batch):
                page = Page(text)
                failed = page.base_failed
                first = None if failed else next((r.name for r in cascade if r.rejects(page)), None)
                found["n_words"].append(len(page.words))
                for name in counts:
                    found[name].append(getattr(page, name))
                found["base_failed"].append(failed)
                found["kept"].append(not failed and first is None)
                found["rejected_by"].append("base" if failed else first)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
            yield with_columns(
                batch, **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()}
            )

    return rows.mapInArrow(run, schema)
