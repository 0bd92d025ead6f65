"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_fingerprint, filter_audit, fm_index, html_extract, language_id, quality, recompression, simhash, token_counts, token_files, toxicity, whitening
from .common import read


def tokenizer(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, words_per_shingle=3).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select(F.col("id").alias("doc_id"), language_id.held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op4_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprint.with_edited(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).withColumnRenamed("id", "page_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeat_digests(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_files.read_back(manifest).withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, components=4)).withColumnRenamed("id", "vec_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_chunk_fingerprint": op4_chunk_fingerprint,
    "op5_html_extract": op5_html_extract,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality": op13_quality,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: SQL of the operators whose results words, windows and counts give; for the others tests/llm has brute force or the libraries.
ORACLE_SQL: dict[str, str] = {
    "op8_substring_dedup": r"""
        WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' ')))) AS k FROM dw WHERE len(w) >= 20),
        later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)""",
    "op10_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
        keys AS (SELECT DISTINCT item, m, k FROM (SELECT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS k FROM (SELECT *, least(len(w), 10) AS m FROM bw WHERE len(w) > 0))),
        win AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS k FROM dw, (SELECT DISTINCT m FROM keys) WHERE len(w) >= m),
        found AS (SELECT doc_id, s, m, item FROM win JOIN keys USING (m, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        first AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
        known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > low AS e
            FROM d JOIN first USING (t) LEFT JOIN known USING (doc_id)),
        masks AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
            count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letter p, letter q, letter r, letter s, letter u
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
        steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        met AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS hit, regexp_matches(fails, '[' || CASE WHEN before = '' THEN '0' ELSE before END || ']') AS gone FROM masks, steps),
        found AS (SELECT part, filter_order, step, f, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM found""",
}
