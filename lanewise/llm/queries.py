"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import (
    decontaminate,
    importance,
    langid,
    language_model,
    manifest,
    mixing,
    pii,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substrings,
    token_store,
)
from lanewise.llm.common import held_out, remainder

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, base, pii.joined(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read_documents(spark, folder)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which rule rejects first depends on the measured order, so it is left out.
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = {c: F.col(c) for c in manifest.COLUMNS}
    presented = F.when(
        remainder(F.col("doc_id"), 3) == 0, manifest.leaf_of([*(values | {"text": lowered}).values()])
    ).otherwise(manifest.leaf_of([*values.values()]))
    found = manifest.manifest(docs, presented=presented)
    folded = manifest.folded(F.col("presented"), F.col("path")).alias("folded_root")
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# What the registered SQL below shares: the words of the contract, and lower-cased A-Z.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce({_WORDS.format("text")}, []) AS w
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM docs, unnest(range(1, len(w) - 1)) AS s(i)),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM windows, unnest(range(i, i + 3)) AS u(p) WHERE n > 1 GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM docs, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
words AS (SELECT r, word, count(*) AS n FROM docs, unnest(w) AS u(word) GROUP BY r, word),
by_word AS (
  SELECT r, max(n) AS most,
         sum(CASE WHEN regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]') THEN 0 ELSE n END) AS without_letters
  FROM words GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS marks,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
         length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters,
         coalesce(n_lines, 0) AS n_lines, most, without_letters
  FROM docs LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r) LEFT JOIN by_word USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * marks > n_words
            OR word_chars NOT BETWEEN 3 * n_words AND 10 * n_words OR 10 * capitals > 3 * letters
            OR 2 * n_dup_lines > n_lines OR 5 * without_letters > n_words OR 4 * most > n_words) AS kept
FROM judged
"""

OP9_SQL = rf"""
WITH
item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
starts AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS s(i)),
hits AS (SELECT r, i, n, item_id FROM starts JOIN windows USING (n, k)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
hit_items AS (
  SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP10_SQL = rf"""
WITH
sized AS (
  SELECT doc_id, source, CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM sized GROUP BY source),
-- Sources in the order in which a rising level reaches their caps: the level is the first
-- that leaves the next source under its cap.
capped AS (
  SELECT *, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(3 * source_size) OVER lower, 0) AS BIGINT) AS clamped,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS BIGINT) AS open_weight,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place
  FROM sources
  WINDOW lower AS (ORDER BY 3 * source_size / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by((total - clamped) / open_weight, place) AS level FROM capped
  WHERE (total - clamped) / open_weight * weight <= cap),
targets AS (
  SELECT source, source_size,
         CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target
  FROM capped, level),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
keyed AS (
  SELECT *,
         sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS upto,
         sum(size) OVER (PARTITION BY source, key) AS same
  FROM sized)
SELECT k.doc_id, k.size, r.source_size, r.target,
       CAST(r.whole + CASE WHEN r.target - r.whole * r.source_size > 0
            AND upto - same + same / 2 <= r.target - r.whole * r.source_size THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(k.size * (r.whole + CASE WHEN r.target - r.whole * r.source_size > 0
            AND upto - same + same / 2 <= r.target - r.whole * r.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM keyed k JOIN rates r ON k.source IS NOT DISTINCT FROM r.source
"""


# crc32 of a text by its table of 256 remainders, `t` in the one row of `crc`.
_CRC_TABLE = """(
  SELECT list(list_reduce(range(8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS s(i))"""
_CRC = """xor(list_reduce(list_transform(range(1, len(hex({0})), 2),
         lambda i: CAST('0x' || substr(hex({0}), i, 2) AS BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


def _merkle_levels(name: str, nodes: str, levels: int) -> str:
    """CTEs of a tree's levels: {name}0 to {name}N, and the runs of each level as lists."""
    parts = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        parts.append(f"""{name}{k + 1} AS (
  SELECT tree, i // 8 AS i, (max(n) + 7) // 8 AS n,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d
  FROM {name}{k} GROUP BY tree, i // 8),
{name}_runs{k} AS (
  SELECT tree, i // 8 AS run, list(d ORDER BY i) AS ds FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 8)""")
    return ",\n".join(parts)


def _merkle_fold(name: str, source: str, tree: str, place: str, levels: int) -> str:
    """CTEs that carry each leaf's siblings (`proof`) and its digest (`f`) up the levels."""
    parts = []
    for k in range(levels):
        at = f"(({place} >> {3 * k}) & 7)"
        left = f"coalesce(array_to_string(ds[1:{at}], ''), '')"
        right = f"coalesce(array_to_string(ds[{at} + 2:], ''), '')"
        parts.append(f"""{name}_fold{k} AS (
  SELECT p.* EXCLUDE (proof, f), proof || {left} || {right} AS proof,
         CASE WHEN ds IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f
  FROM {source} p LEFT JOIN {name}_runs{k} q ON q.tree = p.{tree} AND q.run = {place} >> {3 * k + 3})""")
        source = f"{name}_fold{k}"
    return ",\n".join(parts)


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"


def _leaf(text: str) -> str:
    """SQL of a leaf whose text is the given expression."""
    return "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Seven levels hold two million rows a language, and 512 languages.
OP11_SQL = f"""
WITH
crc AS {_CRC_TABLE},
docs AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0
              THEN {_leaf(_LOWER.format("text"))} END AS changed
  FROM documents, crc),
leaves AS (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS f, '' AS proof,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM docs),
{_merkle_levels("low", "SELECT tree, i, n, leaf AS d FROM leaves", 7)},
{_merkle_levels("top", "SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, d FROM low7", 3)},
{_merkle_fold("low", "leaves", "tree", "i", 7)},
subrooted AS (
  SELECT doc_id, leaf, f, proof, b.tree AS i, 0 AS tree, d AS subroot
  FROM low_fold6 a JOIN low7 b ON a.tree = b.tree),
{_merkle_fold("top", "subrooted", "tree", "i", 3)}
SELECT doc_id, leaf, subroot, top3.d AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = top3.d AS verified
FROM top_fold2, top3
"""

OP13_SQL = rf"""
WITH
crc AS {_CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
doc_words AS (SELECT r, unnest(w) AS word FROM docs),
goal_words AS (
  SELECT unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
words AS (
  SELECT word, {_CRC.format("word")} % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM goal_words), crc),
counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t
  FROM (SELECT word, 1 AS s, 0 AS t FROM doc_words UNION ALL SELECT word, 0, 1 FROM goal_words)
  JOIN words USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(CAST(s AS DOUBLE)) OVER () + 10000)
                       / ((CAST(s AS DOUBLE) + 1) * (sum(CAST(t AS DOUBLE)) OVER () + 10000)))) AS gain
  FROM counts),
weights AS (
  SELECT r, floor(sum(gain) / count(*)) AS weight
  FROM doc_words JOIN words USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)
                 AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


def build_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_personal_data,
        op2_quality,
        op3_language_id,
        op4_token_store,
        op5_simhash,
        op6_substrings,
        op7_quality_rules,
        op8_language_model,
        op9_decontaminate,
        op10_mix_sources,
        op11_manifest,
        op12_shards,
        op13_importance,
    )}


def build_oracle() -> dict[str, str]:
    return {
        "op7_quality_rules": OP7_SQL,
        "op9_decontaminate": OP9_SQL,
        "op10_mix_sources": OP10_SQL,
        "op11_manifest": OP11_SQL,
        "op13_importance": OP13_SQL,
    }
