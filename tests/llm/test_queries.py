"""The registered text queries on a small table, against brute force, SQL, and held-out labels."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from lanewise.llm import (
    decontaminate,
    importance,
    langid,
    language_model,
    manifest,
    mixing,
    queries,
    sharding,
    simhash,
    token_store,
    units,
    word_automaton,
)
from tests.llm import brute

QUERIES = queries.build_queries()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").toPandas()


def by_id(spark, name, sf_dir=SMALL):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", queries.build_oracle())
def test_agrees_with_duckdb(spark, sf001, name):
    con = check_oracle.connect(sf001)
    ok, note = check_oracle.compare(spark, con, name, sf001, QUERIES, queries.build_oracle())
    assert ok, note


def test_base_personal_data(spark, docs):
    got = by_id(spark, "op1_personal_data")
    for doc_id, text in zip(docs.doc_id, docs.text):
        spans = brute.base_spans(text)
        row = got[doc_id]
        assert [row[f"n_{k}"] for k in brute.PII] == [sum(s.startswith(k) for s in spans) for k in brute.PII]
        assert row["base_sha256"] == brute.hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(row["spans"].split(",")) | {""}


def test_quality_on_held_out_labels(spark, sf001):
    got = by_id(spark, "op2_quality", "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good = np.array([s for s, q in held if q == 1])
    bad = np.array([s for s, q in held if q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_language_on_held_out_rows(spark, sf001):
    got = by_id(spark, "op3_language_id", sf001)
    rows = spark.read.parquet(f"{sf001}/documents.parquet").where("lang is not null").collect()
    held = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.99


def test_language_left_out_is_rejected(spark):
    """Nine in ten texts of a language that was not learned, and next to none of the others."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for lang in ("es", "de"):
        model = langid.train(table.where(F.col("lang") != lang))
        judged = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id")
        unknown = F.avg(F.when(F.col("lang") == lang, F.col("rejected").cast("int")))
        known = F.avg(F.when(F.col("lang") != lang, F.col("rejected").cast("int")))
        left_out, others = judged.agg(unknown, known).first()
        assert left_out >= 0.9 and others < 0.02, (lang, left_out, others)
    odd = spark.createDataFrame([(1, "これは日本語の文章です。とても長い文です"), (2, "Это русский текст о погоде")], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(odd, model).collect())


def test_mix_without_ids(spark):
    """A source without ids reaches its target like any other."""
    rows = [(None, f"word {i} " * 5, "a") for i in range(100)] + [(i, "x y z", "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).where("doc_id IS NULL").agg(F.sum("taken"), F.max("target"), F.max("size")).first()
    assert abs(found[0] - found[1]) <= found[2]


def test_token_store(spark, docs):
    tokenizer = token_store.load_tokenizer(queries.tokenizer_path())
    got, start = by_id(spark, "op4_token_store"), 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        row = got[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_simhash(spark, docs):
    got = by_id(spark, "op5_simhash")
    prints = [brute.fingerprint(t) for t in docs.text]
    wanted = brute.components(docs.doc_id.tolist(), prints)
    for doc_id, fp, component in zip(docs.doc_id, prints, wanted):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{fp:016x}", component)


def test_substrings(spark, docs):
    got = by_id(spark, "op6_substrings")
    for doc_id, wanted in zip(docs.doc_id, brute.repeats_removed(docs.text)):
        row = got[doc_id]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == wanted


def test_language_model(spark, docs):
    got = by_id(spark, "op8_language_model")
    for doc_id, wanted in zip(docs.doc_id, brute.trigram_scores(docs.doc_id.tolist(), docs.text)):
        row = got[doc_id]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == wanted[:3]
        assert row["base_score"] == pytest.approx(wanted[3], rel=1e-9)
        # Half a step of the quantised probabilities for each token.
        assert abs(row["score"] - wanted[4]) <= 0.03 * row["n_tokens"]


def test_language_model_in_buckets(spark, docs, monkeypatch):
    """Many units and buckets, with contexts dealt by their next words, score alike."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(units, "BUCKET_KEYS", 3_000)
    units_of = units.store_units
    monkeypatch.setattr(units, "store_units", lambda *args: units_of(*args, unit_bytes=100_000))
    got = {r["doc_id"]: r for r in language_model.score_texts(table).collect()}
    for doc_id, wanted in zip(docs.doc_id, brute.trigram_scores(docs.doc_id.tolist(), docs.text)):
        row = got[doc_id]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == wanted[:3]
        assert row["base_score"] == pytest.approx(wanted[3], rel=1e-9)
        assert abs(row["score"] - wanted[4]) <= 0.03 * row["n_tokens"]


def test_decontamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = by_id(spark, "op9_decontaminate")
    for doc_id, wanted in zip(docs.doc_id, brute.contamination(docs.text, items)):
        row = got[doc_id]
        names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert tuple(row[n] for n in names) == wanted


def test_pipeline(spark, docs):
    """Each stage against brute force on what the stage before kept; the classifier is given."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(table)
    kept = []
    for row in docs.to_dict("records"):
        text = (row["text"] or "").encode()
        if langid.has_letter(text) and not model.rejects([text], langid.REJECT_BELOW)[0]:
            kept.append(row)
    groups = brute.components([r["doc_id"] for r in kept], [brute.fingerprint(r["text"]) for r in kept])
    kept = [r for r, g in zip(kept, groups) if r["doc_id"] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [r for r, c in zip(kept, brute.contamination([r["text"] for r in kept], items)) if not c[-1]]
    frame = spark.createDataFrame(kept, table.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(frame).collect()}
    tokenizer = token_store.load_tokenizer(queries.tokenizer_path())
    wanted, start = [], 0
    for row in kept:
        for _ in range(copies[row["doc_id"]]):
            ids = np.array([*tokenizer.encode(row["text"], add_special_tokens=False).ids, 0], "<u4")
            wanted.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted(wanted)


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    """A benchmark larger than one automaton or one round, and pieces of items, give the same hits."""
    table, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = sorted(map(str, decontaminate.decontaminate(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert sorted(map(str, decontaminate.decontaminate(table, bench).collect())) == wanted
    monkeypatch.setattr(decontaminate, "ROUND_BLOCKS", 2)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 20)
    assert sorted(map(str, decontaminate.decontaminate(table, bench).collect())) == wanted


@pytest.mark.parametrize("window", [1, 2, 3, 13])
def test_word_automaton(window, monkeypatch):
    """All occurrences, nested ones included, as brute force finds them, in few and many lanes."""
    rng = np.random.default_rng(window)
    monkeypatch.setattr(word_automaton, "PIECE_BYTES", 50)
    for trial in range(30):
        letters = np.array(list("abcdefghijk"))[: rng.integers(2, 11) + 1]
        items = [rng.choice(letters[:-1], rng.integers(0, 25)).tolist() for _ in range(rng.integers(0, 6))]
        text = rng.choice(letters, rng.integers(0, 900)).tolist()
        wanted = set()
        for name, item in enumerate(items):
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if size else 0):
                found = (j for j in range(len(text) - size + 1) if text[j : j + size] == item[i : i + size])
                wanted |= {(j + size - 1, size, name) for j in found}
        machine = word_automaton.Automaton([(i, " ".join(t).encode()) for i, t in enumerate(items)], window)
        ends, nodes = machine.occurrences(machine.ids(" ".join(text).encode()))
        got = {
            (end, depth, name)
            for end, node, depth in zip(ends.tolist(), nodes.tolist(), machine.depth(nodes).tolist())
            for name in machine.items_of(node).tolist()
        }
        assert got == wanted


def test_simhash_cells_and_blocks(spark, monkeypatch):
    """Several vantage points, and cells worked off in blocks, lose no link."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for s in seeds for k in (0, 1, 2, 3, 3, 5)]
    fps = np.unique(np.array(fps + list(rng.integers(0, 2**63, 2000, dtype=np.uint64)), np.uint64))
    monkeypatch.setattr(simhash, "CELL", 20)
    monkeypatch.setattr(simhash, "BLOCK", 30)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    roots = simhash.components(simhash.near_pairs(frame, len(fps), 3)).collect()
    got = {f: f for f in fps.view(np.int64).tolist()} | {r["fp"]: r["root"] for r in roots}
    wanted = brute.components(fps.view(np.int64).tolist(), fps)
    classes = {}
    for fp, component in zip(fps.view(np.int64).tolist(), wanted):
        assert classes.setdefault(component, got[fp]) == got[fp]
    assert len(set(classes.values())) == len(classes)


def test_mix_reaches_targets_and_agrees(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = mixing.mix_sources(table).collect()
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    taken, target, largest = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], largest[s] = r["target"], max(largest.get(s, 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
    assert sorted(rows) == sorted(mixing.mix_sources(table.repartition(7)).collect())


def test_manifest(spark, docs):
    got = by_id(spark, "op11_manifest")
    rows = list(docs[["doc_id", "source", "lang", "n_chars", "text"]].itertuples(index=False, name=None))
    for row, wanted in zip(rows, brute.manifest(rows)):
        r = got[row[0]]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == wanted
        assert r["verified"] == (r["folded_root"] == r["root"])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 513, 600])
def test_witness_tree(n):
    """Witnesses of a growing tree are those of the finished one."""
    nodes = [brute.sha(str(i)) for i in range(n)]
    tree, witnesses = manifest.WitnessTree(), [[] for _ in nodes]
    for node, witness in zip(nodes, witnesses):
        tree.append(node, witness)
    if n:
        assert (tree.close(), witnesses) == brute.merkle(nodes)


def test_manifest_in_many_blocks(spark, docs):
    """Blocks of blocks, and trees of very different heights."""
    frame = spark.createDataFrame([(i, "big" if i % 50 else f"t{i % 3}", f"Text {i}") for i in range(700)], "doc_id long, lang string, text string")
    columns = ("doc_id", "lang", "text")
    small, large = (
        sorted(map(str, manifest.manifest(frame, columns=columns, levels=n).collect())) for n in (1, 4)
    )
    assert small == large


def shard_sums(rows):
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_shards(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = QUERIES["op12_shards"](spark, sf001).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    sizes = shard_sums(rows)
    assert max(abs(s - sum(sizes) / 8) for s in sizes) <= max(r["size"] for r in rows)
    # Copies stay together unless a splitter has to fall between them.
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) - 1 for s in where.values()) <= 7


def test_shards_of_a_hot_text(spark):
    """A third of all rows are one text, some of them under one id; parts within shards."""
    rows = [(i if i % 6 else -1, "same text" if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"part_bytes": 1000, "tolerance": 0.001}):
        got = sharding.shard_documents(docs, **options).collect()
        assert len(got) == len(rows)
        sizes = shard_sums(got)
        assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 2 * max(r["size"] for r in got)


def test_importance(spark, docs, monkeypatch):
    """All rounds of the selection, with keys written anew and texts cut into pieces."""
    monkeypatch.setattr(importance, "LAST_KEYS", 3)
    monkeypatch.setattr(importance, "SLICE", 16)
    monkeypatch.setattr(importance, "PIECE_BYTES", 500)
    got = by_id(spark, "op13_importance")
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = list(docs[["doc_id", "text"]].itertuples(index=False, name=None))
    for (doc_id, _), wanted in zip(rows, brute.importance(rows, items)):
        assert tuple(got[doc_id])[1:] == wanted


@pytest.mark.parametrize("percent", [0, 1, 37, 100])
def test_selection_with_ties(spark, percent, monkeypatch):
    """Many rows of one id and text, no ids, and few different scores: the number is exact."""
    monkeypatch.setattr(importance, "LAST_KEYS", 2)
    monkeypatch.setattr(importance, "SLICE", 10)
    rows = [(None if i % 4 == 0 else i % 7, "some words here" if i % 3 else "other words") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = docs.limit(0)
    got = importance.resample(docs, target, percent=percent, min_words=1).collect()
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert drawn == list(range(1, 3 * percent + 1)) and len(got) == 300
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [key(r) for r in ranked] == sorted(map(key, got))[: len(ranked)]


def test_word_crcs():
    words = ["a", "Zürich", "x" * 47, "y" * 48, "z" * 49, "w" * 500, "日本語", "12"]
    data = " ".join(words).lower().encode()
    crcs, starts = importance.word_crcs(data)
    assert crcs.tolist() == [zlib.crc32(w.lower().encode()) for w in words] and starts[0] == 0
