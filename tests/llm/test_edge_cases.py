"""Nulls, empty and long texts, ties, repeated rows, empty tables, and clashing extra columns."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import (
    decontaminate,
    elias_fano,
    importance,
    langid,
    language_model,
    manifest,
    mixing,
    pii,
    quality_model,
    quality_rules,
    queries,
    sharding,
    simhash,
    substrings,
    token_store,
)
from tests.llm import brute

LONG = " ".join(f"word{i % 977} the" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", "de", "b"),
    (None, "no id here, write to x@y.org", "en", None),
    (5, LONG, "en", "a"),
    (6, LONG, "en", "c"),
    (7, "repeated row " * 30, "de", "c"),
    (7, "repeated row " * 30, "de", "c"),
    (8, "12345 !!! ***", None, "b"),
    (9, "été naïve 日本語 テキスト <|endoftext|>", "fr", "a"),
    (1, "another text under the first id", "en", "a"),
]
#: Names that the operators use for their own columns.
CLASHING = "row", "score", "fp", "key", "size", "spans", "unit", "held_out", "n_words"


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(ROWS, schema).selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])
    bench = spark.createDataFrame(
        [(1, "quick brown fox"), (None, "lazy dog"), (2, None), (3, ""), (4, "another text")],
        "item_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(10)] + [(1, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"
    )
    return docs, bench, labels


def operators(docs, bench, labels):
    yield "pii", lambda: pii.personal_data(docs)
    yield "quality_model", lambda: quality_model.score(docs, quality_model.train(docs, labels))
    yield "langid", lambda: langid.identify(docs, langid.train(docs))
    yield "tokens", lambda: token_store.read_documents(
        docs.sparkSession, token_store.write_tokens(docs, queries.tokenizer_path())
    )
    yield "simhash", lambda: simhash.near_duplicates(docs)
    yield "substrings", lambda: substrings.remove_repeats(docs)
    yield "quality_rules", lambda: quality_rules.judge(docs)
    yield "language_model", lambda: language_model.score_texts(docs)
    yield "decontaminate", lambda: decontaminate.decontaminate(docs, bench)
    yield "mixing", lambda: mixing.mix_sources(docs)
    yield "manifest", lambda: manifest.manifest(docs, columns=("doc_id", "source", "lang", "text"))
    yield "sharding", lambda: sharding.shard_documents(docs)
    yield "importance", lambda: importance.resample(docs, bench, min_words=1)


NAMES = [name for name, _ in operators(None, None, None)]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(tables, name):
    rows = dict(operators(*tables))[name]().collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(tables, name):
    docs, bench, labels = (t.limit(0) for t in tables)
    assert dict(operators(docs, bench, labels))[name]().collect() == []


@pytest.mark.parametrize(
    "stage",
    [
        langid.known_language,
        simhash.one_per_group,
        mixing.mixed,
        lambda docs: importance.drawn(docs, docs, min_words=1, percent=30),
        lambda docs: decontaminate.clean_documents(docs, docs.selectExpr("doc_id AS item_id", "text").limit(0)),
    ],
)
def test_filters_keep_the_columns(tables, stage):
    docs = tables[0]
    out = stage(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert 0 < out.count()


def test_defined_results(tables):
    docs, bench, _ = tables
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert spans[None] == ["email"] and spans[2] == spans[3] == []
    langs = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(langs[i]["lang_pred"] == "und" and langs[i]["score"] == 0 for i in (2, 3, 4, 8))
    hits = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect() if r["doc_id"] != 1}
    assert hits[2]["n_words"] == hits[3]["n_words"] == 0 and not hits[2]["contaminated"]
    first = next(
        r for r in decontaminate.decontaminate(docs, bench).collect() if r["doc_id"] == 1 and r["n_words"] == 9
    )
    assert (first["n_hit"], first["items"], first["contaminated"]) == (5, ["1"], True)
    text = ROWS[0][1]
    assert [text[s["start"] : s["end"]] for s in first["spans"]] == ["quick brown fox", "lazy dog"]
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(docs).collect())
    assert (5, 120_000) in removed and (6, 120_000) in removed and removed.count((7, 60)) == 2
    weights = {r["doc_id"]: r for r in importance.resample(docs, bench).collect()}
    assert all((weights[i]["n_features"], weights[i]["weight"], weights[i]["rank"]) == (0, 0, None) for i in (2, 3, 4))
    leaves = {r["doc_id"]: r for r in manifest.manifest(docs, columns=("doc_id", "text")).collect()}
    assert leaves[2]["leaf"] == brute.leaf(2, None) != leaves[3]["leaf"] == brute.leaf(3, "")
    shards = {r["doc_id"]: r for r in sharding.shard_documents(docs).collect()}
    assert shards[2]["size"] == shards[3]["size"] == 1 and shards[2]["text_crc32"] == 0
    kept = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs).collect()}
    assert kept[2, 0]["base_failed"] and kept[7, 60]["n_repeat_words"] == 60


def test_groups_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "x y z")], "doc_id long, text string")
    assert sorted(r["component_id"] or 0 for r in simhash.near_duplicates(docs).collect()) == [0, 0, 4]
    assert simhash.one_per_group(docs).count() == 2


def test_loose_spans_are_added(spark):
    text = "write to me: joe (at) mail.com or call 555-123-4567"
    many = [(i, f"write to me: a{i}@mail.com or call +1 555 123 {1000 + i}") for i in range(40)]
    docs = spark.createDataFrame([(100, text), *many], "doc_id long, text string")
    row = next(r for r in pii.personal_data(docs).collect() if r["doc_id"] == 100)
    assert row["base"] == [] and [s["value"] for s in row["spans"]] == ["joe (at) mail.com", "555-123-4567"]


ODD_SPANS = [
    "a@b.c_d@e.f x.y@z a@b..c q@w.e.r. " + "z" * 20_000,
    "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4 é 4111-1111-1111-1111, +1 (583) 555-8469. +49 3 " + "1" * 20_000,
    "x" + ".a" * 20_000 + "@b" + ".c" * 20_000,
    "4 4111 1111 1111 1111 | 4111 1111  1111 1111 | +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 | ++12345678901",
    "日本 a@b.c 日本 1.2.3.4 𝒳 +1 555 123 4567",
]


def test_odd_spans(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_SPANS)), "doc_id long, text string")
    rows = pii.personal_data(docs, pii.SpanModel()).select("doc_id", pii.joined(pii.F.col("base")).alias("b"))
    assert {r["doc_id"]: r["b"] for r in rows.collect()} == {
        i: ",".join(brute.base_spans(t)) for i, t in enumerate(ODD_SPANS)
    }


ODD_TEXTS = [
    "", " ", "\n", "  ", "a", " a", "a ", "a\n\nb", "a \n b", "x<|endoftext|> y", "é b", "it's 'll don't 12 3a",
    "a\tb", "a\nb c", "日本 語\n漢", "'s 't", "a\x1cb", "a 's b", "x　y", "the,.! A1b2 ?? (x) ªº ŀǅ",
    "Thhe. Of. THE!! a*** b$$$ | c", "don't I'll we've x's",
]


@pytest.fixture(scope="module")
def tokenizer():
    return token_store.load_tokenizer(queries.tokenizer_path())


def encoded(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_words_from_the_cache(tokenizer):
    cache = token_store.WordCache(tokenizer, limit=4)
    for _ in range(2):
        for text, ids in zip(ODD_TEXTS, cache.encode(ODD_TEXTS)):
            assert np.frombuffer(ids, "<u4").tolist() == encoded(tokenizer, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab Té1'.,\n\t!<|é日"), max_size=30))
def test_cache_on_any_text(tokenizer, text):
    assert np.frombuffer(token_store.WordCache(tokenizer).encode([text])[0], "<u4").tolist() == encoded(tokenizer, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    values = np.array(ids, np.uint32)
    segment = token_store.Segment(token_store.encode_ids(values))
    assert len(segment) == len(ids) and segment.slice(0, len(ids)).tolist() == ids
    assert [segment[i] for i in range(len(ids))] == ids
    middle = len(ids) // 3
    assert segment.slice(middle, len(ids) - 1).tolist() == ids[middle : len(ids) - 1]


def test_token_at(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(30)], "doc_id long, text string")
    folder = token_store.write_tokens(docs, queries.tokenizer_path(), segment_tokens=16, partitions=3)
    rows = sorted(token_store.read_documents(spark, folder).collect())
    assert [r["doc_id"] for r in rows] == list(range(30))
    last = rows[-1]["start"] + rows[-1]["n_tokens"] - 1
    assert token_store.token_at(spark, folder, last) == 0
    assert token_store.token_at(spark, folder, last + 1) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 2) | st.integers(0, 50), max_size=400))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    coded = elias_fano.EliasFano.encode(values)
    assert (coded[np.arange(len(values))] == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array([0, 7, 2**63], np.uint64)])
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
