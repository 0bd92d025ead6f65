"""Registered queries over the provided tables, with the SQL that gives the same rows.

to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import generation as gx
from ..functions import text as tx
from ..operators import corpus_stats, enrich, generation, meta, metrics, ranking, reports, weights
from ..sources import stores
from ..sources.shared import ship
from ..sources import works as sources
from . import bindings as b
from .bindings import DEFAULT_WEIGHTS, NOW, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, parts: list[str] | None = None, more: dict[str, str] | None = None, python: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` after the given bindings and further parts."""

    def put(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            if python:
                ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_sql(parts or [], sql, more)
        return run

    return put


def r6(c: Column | str) -> Column:
    return fx.half_up(F.col(c) if isinstance(c, str) else c, 6)


def s6(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.5) / 1e6"


# --- SQL of the column functions

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def tok_sql(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


def big_sql(e: str) -> str:
    return f"list_transform(range(1, greatest(len({e}), 1)), lambda i: {e}[i] || ' ' || {e}[i + 1])"


VENUE_SQL = "CASE WHEN is_preprint THEN 0.5 WHEN coalesce(journal_name, '') = '' THEN 0.3 WHEN quartile = 'Q1' THEN 1.0 WHEN quartile = 'Q2' THEN 0.7 WHEN quartile = 'Q3' THEN 0.4 WHEN quartile = 'Q4' THEN 0.2 ELSE 0.5 END"
AUTHORS_SQL = "CASE WHEN best_h IS NULL THEN 0.3 ELSE least(ln(best_h + 1) / ln(101.0::DOUBLE), 1.0) END"
_AGE1, _AGE0 = f"greatest({NOW} - year + 1, 1)", f"greatest({NOW} - year, 1)"
IMPACT_SQL = f"CASE WHEN {_AGE1} <= 1 AND citation_count = 0 THEN 0.5 ELSE least(ln(citation_count / {_AGE1} + 1) / ln(51.0::DOUBLE), 1.0) END"
VELOCITY_SQL = f"CASE WHEN {_AGE0} <= 1 AND citation_count = 0 THEN 0.5 ELSE least(citation_count / {_AGE0} / 20, 1.0) END"
RECENCY_SQL = f"exp(-ln(2.0::DOUBLE) / 3 * greatest({NOW} - year, 0))"
_HIT = "len(list_filter({q}, lambda x: list_contains({t}, x)))"
_WORDS = f"{_HIT.format(q='tt', t='t1')} / len(tt) * 3.0 + 0 + {_HIT.format(q='tt', t='t3')} / len(tt) * 2.0"
_PAIRS = f"{_HIT.format(q='tb', t='b1')} / len(tb) * 1.5 + {_HIT.format(q='tb', t='b3')} / len(tb) * 1.0"
RELEVANCE_SQL = f"CASE WHEN len(tt) = 0 THEN 0.05 WHEN len(tt) = 1 THEN greatest(({_WORDS}) / 6.0, 0.05) ELSE greatest(({_WORDS} + {_PAIRS}) / 9.0, 0.05) END"
SCORED = {
    "toks": f"SELECT *, {tok_sql('topic')} AS tt, {tok_sql('title')} AS t1, {tok_sql('concepts_text')} AS t3 FROM works",
    "bigs": f"SELECT *, {big_sql('tt')} AS tb, {big_sql('t1')} AS b1, {big_sql('t3')} AS b3 FROM toks",
    "scored": f"SELECT id, domain_id, n_nationkey, year, citation_count, title, concepts_text, is_preprint, {s6(VENUE_SQL)} AS venue_score, {s6(AUTHORS_SQL)} AS authors_score, {s6(IMPACT_SQL)} AS impact_score, {s6(VELOCITY_SQL)} AS velocity_score, {s6(RECENCY_SQL)} AS recency_score, {s6(RELEVANCE_SQL)} AS relevance_score FROM bigs",
}
_FINAL = " + ".join(f"{DEFAULT_WEIGHTS[k]} * {k}_score" for k in fx.KEYS)
RANKED = SCORED | {"ranked": f"SELECT *, {s6(_FINAL)} AS final_score, row_number() OVER (PARTITION BY domain_id ORDER BY {s6(_FINAL)} DESC, id) AS rank FROM scored"}
SUB = [f"{k}_score" for k in fx.KEYS]
_SUB = ", ".join(SUB)


def scored(spark: SparkSession, d: str) -> DataFrame:
    table = fx.score_table(b.works(spark, d), NOW)
    return table.withColumns({c: r6(c) for c in SUB})


def _final(table: DataFrame) -> Column:
    return r6(sum((F.lit(DEFAULT_WEIGHTS[k]) * F.col(f"{k}_score") for k in fx.KEYS[1:]), F.lit(DEFAULT_WEIGHTS["venue"]) * F.col("venue_score")))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    s = s.withColumn("final_score", _final(s))
    return ranking.rank(s, F.col("final_score"))


def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """Keys and scores of all works, stored: whole rankings read them more than once."""
    s = scored(spark, d)
    path = stores.scratch(spark, "scores")
    s.withColumn("final_score", _final(s)).select("domain_id", "id", *SUB, "final_score").write.parquet(path)
    return spark.read.parquet(path)


def ranked_all(spark: SparkSession, d: str) -> DataFrame:
    """The same for readers of whole rankings."""
    return ranking.rank_all(stored_scores(spark, d), F.col("final_score"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).where(F.col("rank") <= 15).select("domain_id", "rank", "id", "year", "citation_count", *SUB, "final_score")


# --- works and their scores


@query(f"SELECT domain_id, rank, id, year, citation_count, {_SUB}, final_score FROM ranked WHERE rank <= 15", ["works"], RANKED)
def f1_e1_top_works(spark, d):
    return flagship(spark, d)


@query("SELECT id, domain_id, segment, year, citation_count, title, concepts_text, journal_name, quartile, is_preprint, topic, n_authors, CAST(best_h AS INTEGER) AS best_h FROM works", ["works"])
def works_table(spark, d):
    return b.works(spark, d).select("id", "domain_id", "segment", "year", "citation_count", "title", "concepts_text", "journal_name", "quartile", "is_preprint", "topic", F.size("authors").cast("long").alias("n_authors"), "best_h")


for _name, _sql in (("b1_venue", VENUE_SQL), ("b2_authors", AUTHORS_SQL), ("b3_impact", IMPACT_SQL), ("b4_velocity", VELOCITY_SQL), ("b5_recency", RECENCY_SQL)):

    def _one(spark, d, key=_name.split("_")[1]):
        return scored(spark, d).select("id", f"{key}_score")

    _one.__name__ = f"{_name}_score"
    query(f"SELECT id, {s6(_sql)} AS {_name.split('_')[1]}_score FROM works", ["works"])(_one)


@query("SELECT id, relevance_score FROM scored", ["works"], SCORED)
def b8_keyword_relevance(spark, d):
    return scored(spark, d).select("id", "relevance_score")


@query(f"SELECT id, {_SUB}, {s6(_FINAL)} AS final_score FROM scored", ["works"], SCORED)
def b13_b14_score_table(spark, d):
    s = scored(spark, d)
    return s.select("id", *SUB, _final(s).alias("final_score"))


_DOC_TOK = {"t": f"SELECT doc_id, {tok_sql('text')} AS w FROM documents"}


@query(f"SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM t", None, _DOC_TOK)
def b6_tokens(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({big_sql('w')}, '|') AS pairs FROM t", None, _DOC_TOK)
def b7_bigrams(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(tx.bigrams(tx.tokens(F.col("text"))), "|").alias("pairs"))


@query("SELECT id, title || CASE WHEN concepts_text <> '' THEN ' ' || concepts_text ELSE '' END AS text FROM works", ["works"])
def b9_work_text(spark, d):
    w = b.works(spark, d)
    return w.select("id", tx.work_text(F.col("title"), F.col("abstract"), F.col("concepts")).alias("text"))


_DOT = "list_sum(list_transform(list_zip(e.embedding, t.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"SELECT e.vec_id AS doc_id, {s6(f'greatest(({_DOT} + 1) / 2, 0.05)')} AS relevance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) t")
def b10_embedding_relevance(spark, d):
    e = b.table(spark, d, "embeddings")
    topic = e.where("vec_id = 0").select(F.col("embedding").alias("topic"))
    return e.crossJoin(F.broadcast(topic)).select(F.col("vec_id").alias("doc_id"), r6(fx.semantic_relevance(F.col("embedding"), F.col("topic"))).alias("relevance"))  # one topic vector


_KEYWORD_DOC = {
    "topic": f"SELECT {tok_sql(chr(39) + 'the red_widget' + chr(39))} AS tt",
    "kw": f"SELECT doc_id, greatest({_HIT.format(q='tt', t='w')} / len(tt) / 9.0 + (len(list_filter({big_sql('tt')}, lambda x: list_contains({big_sql('w')}, x))) * 0.5 / 9.0), 0.05) AS k FROM (SELECT doc_id, {tok_sql('text')} AS w FROM documents), topic",
    "sem": f"SELECT e.vec_id AS doc_id, greatest(({_DOT} + 1) / 2, 0.05) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) t",
}


@query(f"SELECT doc_id, {s6('coalesce(s, k)')} AS relevance, s IS NOT NULL AS semantic FROM kw LEFT JOIN sem USING (doc_id)", None, _KEYWORD_DOC)
def b11_relevance_fallback(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    e = b.table(spark, d, "embeddings")
    topic = e.where("vec_id = 0").select(F.col("embedding").alias("topic"))
    sem = e.crossJoin(F.broadcast(topic)).select(F.col("vec_id").alias("doc_id"), fx.semantic_relevance(F.col("embedding"), F.col("topic")).alias("s"))
    keyword = fx.relevance_score(F.lit("the red_widget"), F.lit(""), F.col("text"), F.lit(""))
    return docs.join(sem, "doc_id", "left").select("doc_id", r6(fx.relevance_with_fallback(F.col("s"), keyword)).alias("relevance"), F.col("s").isNotNull().alias("semantic"))


_ODD = {"odd": "SELECT c_name AS topic, CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE c_custkey * 1.0 END AS w_venue, c_custkey % 3 * 1.0 AS w_authors, CASE WHEN c_custkey % 7 = 3 THEN -1.0 ELSE 0.0 END AS w_impact, CASE WHEN c_custkey = 0 THEN 0.0 ELSE 2.0 END AS w_relevance, CASE WHEN c_custkey % 2 = 0 THEN 1.0 * (c_custkey > 0)::INT END AS w_velocity FROM customer"}
_ODD_ROWS = "SELECT *, CASE WHEN w_venue IS NULL THEN 'missing key' WHEN w_impact < 0 THEN 'negative weight' WHEN w_venue + w_authors + w_impact + w_relevance + coalesce(w_velocity, 0) = 0 THEN 'all zero' END AS reason, w_venue + w_authors + w_impact + w_relevance + coalesce(w_velocity, 0) AS total FROM odd"


def _odd_weights(spark, d):
    n = F.col("c_custkey")
    return b.table(spark, d, "customer").select(
        F.col("c_name").alias("topic"),
        F.when(n % 5 != 1, n * 1.0).alias("w_venue"),
        (n % 3 * 1.0).alias("w_authors"),
        F.when(n % 7 == 3, -1.0).otherwise(0.0).alias("w_impact"),
        F.when(n == 0, 0.0).otherwise(2.0).alias("w_relevance"),
        F.when(n % 2 == 0, (n > 0).cast("double")).alias("w_velocity"),
    )


@query(f"SELECT topic, reason, CASE WHEN reason IS NULL THEN {s6('w_venue / total')} END AS w_venue, CASE WHEN reason IS NULL THEN {s6('coalesce(w_velocity, 0) / total')} END AS w_velocity FROM rows_", None, _ODD | {"rows_": _ODD_ROWS})
def b12_weight_validation(spark, d):
    good, bad = fx.validate_weights(_odd_weights(spark, d))
    return good.select("topic", F.lit(None).cast("string").alias("reason"), r6("w_venue").alias("w_venue"), r6("w_velocity").alias("w_velocity")).union(bad.select("topic", "reason", F.lit(None).cast("double"), F.lit(None).cast("double")))


@query(f"SELECT topic, {', '.join(s6(f'CASE WHEN t < 1e-10 THEN 1.0 / 3 ELSE greatest({c}, 0) / t END') + f' AS {c}' for c in ('a', 'b', 'c'))} FROM (SELECT *, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) AS t FROM (SELECT c_name AS topic, (c_custkey % 5 - 2) * 1.0 AS a, (c_custkey % 4 - 2) * 1.0 AS b, (c_custkey % 3 - 2) * 1.0 AS c FROM customer))")
def b15_clip_and_normalise(spark, d):
    n = F.col("c_custkey")
    cols = fx.clip_and_normalise({"a": (n % 5 - 2) * 1.0, "b": (n % 4 - 2) * 1.0, "c": (n % 3 - 2) * 1.0})
    return b.table(spark, d, "customer").select(F.col("c_name").alias("topic"), *(r6(c).alias(k) for k, c in cols.items()))


@query("SELECT item_id, CASE WHEN s = '' THEN 'unknown_topic' ELSE s END AS slug FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM benchmark)")
def b16_topic_slug(spark, d):
    return b.table(spark, d, "benchmark").select("item_id", tx.slug(F.col("text")).alias("slug"))


@query("SELECT p_partkey, replace(replace(substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 5), '-', ''), ' ', '') AS issn FROM part")
def b17_normalise_issn(spark, d):
    s = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return b.table(spark, d, "part").select("p_partkey", tx.normalise_issn(F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 4))).alias("issn"))


_LEARNED = {"learned": "SELECT * FROM dweights d JOIN nation n ON n.n_name = d.domain_id WHERE n_nationkey % 3 = 0", "explicit": "SELECT * FROM dweights d JOIN nation n ON n.n_name = d.domain_id WHERE n_nationkey % 2 = 0"}


@query(
    "SELECT s.id, s.domain_id, s.relevance_score FROM scored s LEFT JOIN learned l ON l.domain_id = s.domain_id WHERE s.relevance_score >= CASE WHEN l.w_relevance < 0.15 THEN 0.06 ELSE 0.2 END",
    ["works", "dweights"], SCORED | _LEARNED,
)
def b18_relevance_gate(spark, d):
    n = b.table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("domain_id"))
    learned = b.domain_weights(spark, d).join(n, "domain_id").select("domain_id", F.col("w_relevance").alias("__w"))
    return ranking.gate(scored(spark, d).join(learned, "domain_id", "left"), F.col("__w")).select("id", "domain_id", "relevance_score")


@query(
    f"SELECT nation.n_name AS topic, {s6(f'coalesce(l.w_venue, e.w_venue, {DEFAULT_WEIGHTS['venue']})')} AS w_venue, {s6(f'coalesce(l.w_relevance, e.w_relevance, {DEFAULT_WEIGHTS['relevance']})')} AS w_relevance, CASE WHEN l.w_venue IS NOT NULL THEN 'learned' WHEN e.w_venue IS NOT NULL THEN 'explicit' ELSE 'default' END AS weights_from FROM nation LEFT JOIN learned l ON l.domain_id = nation.n_name LEFT JOIN explicit e ON e.domain_id = nation.n_name",
    ["dweights"], _LEARNED,
)
def b19_weight_resolution(spark, d):
    n = b.table(spark, d, "nation")
    w = b.domain_weights(spark, d).withColumnRenamed("domain_id", "topic")
    of = lambda m: w.join(n.where(F.col("n_nationkey") % m == 0).select(F.col("n_name").alias("topic")), "topic")
    got = ranking.resolve_weights(n.select(F.col("n_name").alias("topic")), of(3), of(2), DEFAULT_WEIGHTS)
    return got.select("topic", r6("w_venue").alias("w_venue"), r6("w_relevance").alias("w_relevance"), "weights_from")


#: Part names stand in for the words of survey titles.
_SURVEY = "title LIKE '%gizmo%' OR title LIKE '%plate%'"
_PROMO = {
    "pool": f"SELECT w.domain_id, w.id AS article_id, CASE WHEN {_SURVEY} THEN 3.0 ELSE 0.0 END + CASE WHEN max(citation_count) OVER (PARTITION BY w.domain_id) > 0 THEN citation_count / max(citation_count) OVER (PARTITION BY w.domain_id) ELSE 0 END AS score FROM gold g JOIN works w ON w.domain_id = g.domain_id AND w.id = g.article_id WHERE grade = 1",
    "placed": f"SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY {s6('score')} DESC, article_id) AS place FROM pool",
}


def _survey_like() -> Column:
    return F.col("title").contains("gizmo") | F.col("title").contains("plate")


@query(f"SELECT domain_id, article_id, {s6('score')} AS score FROM pool", ["works", "gold"], _PROMO)
def b20_promotion_score(spark, d):
    return ranking.promotion_pool(b.gold(spark, d), b.works(spark, d), _survey_like()).select("domain_id", "article_id", r6("score").alias("score"))


@query("SELECT g.domain_id, g.article_id, grade, CAST(CASE WHEN place <= 5 THEN 2 ELSE grade END AS INTEGER) AS new_grade FROM gold g LEFT JOIN placed p ON p.domain_id = g.domain_id AND p.article_id = g.article_id", ["works", "gold"], _PROMO)
def f3_grade_promotion(spark, d):
    return ranking.promote(b.gold(spark, d), b.works(spark, d), _survey_like(), 5)


@query(f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(tx.SURVEY_WORDS)}') AS survey_like FROM documents")
def b20_survey_flag(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.is_survey_like(F.col("text")).alias("survey_like"))


# --- generated text


def _rouge_sql(n: int) -> str:
    item = "g" if n == 1 else "list_transform(range(1, greatest(len(g), 1)), lambda i: g[i] || ' ' || g[i + 1])"
    ref = item.replace("g[", "r[").replace("len(g)", "len(r)") if n == 2 else "r"
    return f"SELECT id, {item} AS a, {ref} AS b FROM toks_"


_ROUGE = {
    "toks_": "SELECT id, regexp_extract_all(lower(generated), '[a-z0-9]+') AS g, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM pairs",
    "one": _rouge_sql(1),
    "two": _rouge_sql(2),
} | {
    f"c{n}": f"SELECT x.id, sum(least(x.n, y.n)) AS shared FROM (SELECT id, u, count(*) AS n FROM (SELECT id, unnest(a) AS u FROM {t}) GROUP BY 1, 2) x JOIN (SELECT id, u, count(*) AS n FROM (SELECT id, unnest(b) AS u FROM {t}) GROUP BY 1, 2) y ON x.id = y.id AND x.u = y.u GROUP BY x.id" for n, t in ((1, "one"), (2, "two"))
}
_F1 = "CASE WHEN coalesce(shared, 0) = 0 THEN 0.0 ELSE floor(2 * (shared / len(a)) * (shared / len(b)) / (shared / len(a) + shared / len(b)) * 1e4 + 0.5) / 1e4 END"


@query(f"SELECT id, (SELECT any_value({_F1}) FROM one LEFT JOIN c1 USING (id) WHERE one.id = p.id) AS rouge1, (SELECT any_value({_F1}) FROM two LEFT JOIN c2 USING (id) WHERE two.id = p.id) AS rouge2 FROM pairs p", ["pairs"], _ROUGE)
def b23_b24_rouge(spark, d):
    p = b.pairs(spark, d)
    g, r = F.col("generated"), F.col("reference")
    return p.select("id", tx.rouge_1(g, r).alias("rouge1"), tx.rouge_2(g, r).alias("rouge2"))


#: The longest common subsequence, one token of the generated text after another: each row of the table from the one before.
_LCS = {
    "toks_": _ROUGE["toks_"],
    "lcs_": "WITH RECURSIVE dp AS (SELECT id, 0 AS k, g, r, list_transform(range(0, len(r) + 1), lambda j: 0) AS row_ FROM toks_ WHERE len(g) > 0 AND len(r) > 0 UNION ALL SELECT id, k + 1, g, r, list_concat([0], list_transform(range(1, len(r) + 1), lambda j: list_max(t[1:j]))) FROM (SELECT *, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN r[j] = g[k + 1] THEN row_[j] + 1 ELSE row_[j + 1] END) AS t FROM dp WHERE k < len(g))) SELECT id, row_[len(r) + 1] AS n FROM dp WHERE k = len(g)",
}


@query("SELECT t.id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE floor(2.0::DOUBLE * n / (len(g) + len(r)) * 1e4 + 0.5) / 1e4 END AS rouge_l FROM toks_ t LEFT JOIN lcs_ USING (id)", ["pairs"], _LCS, python=True)
def b25_j3_rouge_l(spark, d):
    return b.pairs(spark, d).select("id", tx.rouge_l(F.col("generated"), F.col("reference")).alias("rouge_l"))


_EVAL = "SELECT event_id, value / 500 AS r1, value / 700 AS r2, value / 600 AS rl, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 10 / 10.0 END AS f, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 / 7.0 END AS c, event_id % 5 <> 0 AS has_rouge FROM events"


@query("SELECT event_id, CASE WHEN f IS NOT NULL AND has_rouge THEN floor((0.4 * ((r1 + r2 + rl) / 3) + 0.4 * f + 0.2 * c) * 1e4 + 0.5) / 1e4 WHEN f IS NOT NULL THEN floor((0.6 * f + 0.4 * c) * 1e4 + 0.5) / 1e4 WHEN has_rouge THEN floor((r1 + r2 + rl) / 3 * 1e4 + 0.5) / 1e4 END AS composite FROM ev", None, {"ev": _EVAL})
def b26_composite(spark, d):
    e = b.table(spark, d, "events")
    i, v = F.col("event_id"), F.col("value")
    rouge = lambda x: F.when(i % 5 != 0, v / x)
    made = gx.composite(rouge(500), rouge(700), rouge(600), F.when(i % 3 != 0, i % 10 / F.lit(10.0)), F.when(i % 3 != 0, i % 7 / F.lit(7.0)))
    return e.select("event_id", made.alias("composite"))


@query("SELECT p.id, coalesce(j.f, 0.5) AS faithfulness, coalesce(j.c, 0.5) AS coverage FROM pairs p LEFT JOIN (SELECT id, CASE WHEN id % 4 <> 1 THEN id % 10 / 10.0 END AS f, id % 5 / 5.0 AS c FROM pairs WHERE id % 3 <> 0) j USING (id)", ["pairs"])
def b27_attach_judge(spark, d):
    p = b.pairs(spark, d).select("id")
    i = F.col("id")
    judged = p.where(i % 3 != 0).select("id", F.when(i % 4 != 1, i % 10 / F.lit(10.0)).alias("faithfulness"), (i % 5 / F.lit(5.0)).alias("coverage"))
    return gx.attach_judge(p, judged, ["id"])


_PRICE = {"price": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in gx.PRICES) + ") AS t(model, ip, op)", "use_": "SELECT event_id, CASE event_type WHEN 'view' THEN 'gpt-4o' WHEN 'click' THEN 'gpt-4o-mini' WHEN 'signup' THEN 'Qwen/Qwen3-32B' ELSE event_type END AS model, CAST(floor(value * 100) AS BIGINT) AS i, CAST(floor(value * 10) AS BIGINT) AS o, CAST(floor(value * 60) AS BIGINT) AS rd, event_id % 900 AS cr FROM events"}


@query("SELECT event_id, model, coalesce(floor(((greatest(i - rd - cr, 0) + 1.25::DOUBLE * cr + 0.1::DOUBLE * rd) * ip / 1e6 + o * op / 1e6) * 1e6 + 0.5) / 1e6, 0.0) AS cost_usd FROM use_ LEFT JOIN price USING (model)", None, _PRICE)
def b28_token_cost(spark, d):
    v = F.col("value")
    model = F.when(F.col("event_type") == "view", "gpt-4o").when(F.col("event_type") == "click", "gpt-4o-mini").when(F.col("event_type") == "signup", "Qwen/Qwen3-32B").otherwise(F.col("event_type"))
    use = b.table(spark, d, "events").select("event_id", model.alias("model"), F.floor(v * 100).alias("input_tokens"), F.floor(v * 10).alias("output_tokens"), F.floor(v * 60).alias("cache_read_tokens"), (F.col("event_id") % 900).alias("cache_creation_tokens"))
    return gx.token_cost(use, gx.prices(spark)).select("event_id", "model", "cost_usd")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 0 AS rejected FROM events")
def b29_response_parsing(spark, d):
    e = b.table(spark, d, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("I can't { do that")).otherwise(F.concat(F.lit("<think>hm {x}</think>\n```json\n"), F.col("props"), F.lit("\n```\nDone.")))
    k = F.from_json(tx.response_json(raw), "k long")["k"]
    return e.select("event_id", k.alias("k"), k.isNull().alias("rejected"))


@query("SELECT event_id, coalesce(list_position(['poor','acceptable','good','excellent'], q) < 3 AND list_position(['poor','acceptable','good','excellent'], q) > 0, false) AS below FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'poor' WHEN 'click' THEN 'acceptable' WHEN 'signup' THEN 'good' WHEN 'error' THEN 'excellent' ELSE 'other' END AS q FROM events)")
def b30_quality_threshold(spark, d):
    t = F.col("event_type")
    q = F.when(t == "view", "poor").when(t == "click", "acceptable").when(t == "signup", "good").when(t == "error", "excellent").otherwise("other")
    return b.table(spark, d, "events").select("event_id", gx.below_quality(q, "good").alias("below"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'narrative+rouge' WHEN c_custkey % 3 = 1 THEN 'narrative' ELSE 'structured' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'v0' ELSE 'mixed' END AS provider, CASE WHEN p > 1 THEN '(+) +' || printf('%.1f', p) WHEN p < -0.5 THEN '(-) ' || printf('%.1f', p) ELSE '(=) ' || CASE WHEN p < 0 THEN '' ELSE '+' END || printf('%.1f', p) END || '%' AS label, CASE WHEN length(name) <= 12 THEN name ELSE substr(name, 1, 11) || '…' END AS short FROM (SELECT c_custkey, (c_custkey % 25 - 10) / 3.0 AS p, CASE WHEN c_custkey % 3 = 1 THEN 'Narrative-' ELSE 'run-' END || c_name AS name FROM customer)")
def b31_run_labels(spark, d):
    n = F.col("c_custkey")
    name = F.concat(F.when(n % 3 == 1, "Narrative-").otherwise("run-"), F.col("c_name"))
    models = F.array(F.lit("v0/a"), F.concat(F.lit("v"), (n % 4).cast("string"), F.lit("/b")), F.lit("plain"))
    return b.table(spark, d, "customer").select("c_custkey", gx.run_mode(n % 3 == 0, name).alias("mode"), gx.run_provider(models).alias("provider"), gx.improvement_label((n % 25 - 10) / F.lit(3.0)).alias("label"), gx.short_name(name, 12).alias("short"))


@query("SELECT event_id, CASE WHEN abs(r) >= 0.5 THEN 'large' WHEN abs(r) >= 0.3 THEN 'medium' ELSE 'small' END AS effect FROM (SELECT event_id, event_id % 21 / 10.0 - 1 AS r FROM events)")
def b32_effect_size(spark, d):
    return b.table(spark, d, "events").select("event_id", gx.effect_size_label(F.col("event_id") % 21 / F.lit(10.0) - 1).alias("effect"))


@query(f"SELECT event_id, {s6('p')} AS improvement_pct, p >= 1 AS saved FROM (SELECT event_id, CASE WHEN bl = 0 THEN CASE WHEN value > 0 THEN 100.0 ELSE 0.0 END ELSE (value - bl) / bl * 100 END AS p FROM (SELECT event_id, value, event_id % 50 * 1.0 AS bl FROM events))")
def b33_relative_improvement(spark, d):
    p = gx.relative_improvement(F.col("value"), F.col("event_id") % 50 * F.lit(1.0))
    return b.table(spark, d, "events").select("event_id", r6(p).alias("improvement_pct"), (p >= 1).alias("saved"))


@query("SELECT doc_id, concat_ws(' ', CASE WHEN trim(a) <> '' AND lower(trim(a)) <> 'not specified' THEN a END, CASE WHEN doc_id % 3 <> 0 THEN 'Dataset: ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'Limitations: ' || lang END, lang || ' ' || source) AS flat FROM (SELECT doc_id, source, lang, text AS a FROM documents)")
def b22_flatten_summary(spark, d):
    i = F.col("doc_id")
    flat = gx.flatten_summary(F.col("text"), F.lit("Not specified"), F.when(i % 3 != 0, F.col("source")), F.lit(None).cast("string"), F.when(i % 2 == 0, F.col("lang")), F.array("lang", "source"))
    return b.table(spark, d, "documents").select("doc_id", flat.alias("flat"))


@query("SELECT doc_id, '' AS problem, source AS method, CASE WHEN doc_id % 3 = 0 THEN lang || '|' || source WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS contributions FROM documents")
def b21_summary_coercion(spark, d):
    i = F.col("doc_id")
    rest = F.when(i % 3 == 0, F.format_string('["%s","%s"]', "lang", "source")).when(i % 3 == 1, F.format_string('"%s"', "lang")).otherwise(F.lit('" "'))
    raw = F.format_string('{"problem": null, "method": "%s", "key_contributions": %s}', F.col("source"), rest)
    s = b.table(spark, d, "documents").select("doc_id", gx.parse_summary(raw).alias("s"))
    return s.select("doc_id", "s.problem", "s.method", F.array_join("s.key_contributions", "|").alias("contributions"))


# --- sources


@query("SELECT id, query, result_pos FROM (SELECT w.id, h.query, h.result_pos, row_number() OVER (PARTITION BY h.query ORDER BY h.result_pos) AS n FROM works w JOIN hits h ON h.article_id = w.id WHERE year >= 1996 AND year <= 2000) WHERE n <= 50", ["works", "hits"])
def a4_g2_search(spark, d):
    h = b.hits(spark, d).join(b.works(spark, d).select(F.col("id").alias("article_id"), "year", "title"), "article_id")
    return sources.search(h, 1996, 2000, per_query=ranking.per_query_quota(300, 6)).select(F.col("article_id").alias("id"), "query", "result_pos")


@query("SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS issn, CASE k % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' ELSE 'Q4' END AS quartile FROM (SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part) WHERE k % 5 < 4")
def a6_issn_quartiles(spark, d):
    k = F.substring("p_brand", 7, 9).cast("int")
    i = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    rows = b.table(spark, d, "part").select(F.concat(F.substring(i, 1, 4), F.lit("-"), F.substring(i, 5, 4), F.lit(", ")).alias("Issn"), F.element_at(F.array(*map(F.lit, ("Q1", "Q2", "Q3", "Q4", "-"))), k % 5 + 1).alias("q"), "p_partkey")
    return sources.issn_quartiles(rows, "Issn", "q", "p_partkey")


def _raw_works(w):
    """Records as they are landed, of works or of works with further columns, which stay."""
    author = lambda a: F.struct(F.struct(F.concat(F.lit("https://a/A"), a["author_id"].cast("string")).alias("id"), a["name"].alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), F.array().cast("array<struct<display_name:string>>").alias("institutions"))
    index = sources.invert_abstract(F.split("title", " "))
    further = [c for c in ("k", "topic_", "page") if c in w.columns]
    fields = [
        F.concat(F.lit("https://w/W"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("id").cast("string"))).alias("doi"),
        F.when(F.col("id") % 11 != 0, F.col("title")).alias("title"),
        F.col("year").alias("publication_year"),
        F.when(F.col("citation_count") > 0, F.col("citation_count")).alias("cited_by_count"),
        F.when(F.col("title") != "", index).alias("abstract_inverted_index"),
        F.transform("authors", author).alias("authorships"),
        F.struct(F.lit(None).cast("string").alias("landing_page_url"), F.struct(F.col("journal_name").alias("display_name"), F.lit("1234-5678").alias("issn_l"), F.when(F.col("is_preprint"), "repository").otherwise("journal").alias("type")).alias("source")).alias("primary_location"),
        F.struct((F.col("id") % 3 == 0).alias("is_oa")).alias("open_access"),
        F.transform("concepts", lambda c: F.struct(c.alias("display_name"))).alias("concepts"),
    ]
    return w.select(*further, F.col("id").alias("number"), F.to_json(F.struct(*fields)).alias("w"))


#: Works on a landed page, by their numbers: as many pages as the works need.
PAGE = 1_000


def _landed(spark, d):
    path = stores.scratch(spark, "pages")
    works = b.works(spark, d).withColumn("k", F.floor(F.col("id") / PAGE)).repartition("k")  # works move, not their records, which are ten times as wide
    lists = _raw_works(works).groupBy("k").agg(F.array_join(F.collect_list("w"), ",").alias("ws"))
    pages = lists.select(F.concat(F.lit('{"results":['), F.col("ws"), F.lit("]}")).alias("value"))
    pages.union(spark.createDataFrame([("{broken",)], "value string")).write.option("compression", "gzip").text(path)
    return sources.scan_pages(spark, path)


@query(
    "SELECT 'openalex_W' || id AS id, CASE WHEN id % 2 = 0 THEN '10.1/' || id END AS doi, title, CASE WHEN title <> '' THEN title END AS abstract, n_authors, year, citation_count, is_preprint, id % 3 = 0 AS open_access, 'https://w/W' || id AS url, least(n_authors, 5) AS n_concepts FROM works WHERE id % 11 <> 0",
    ["works"],
)
def a1_a2_a3_works_scan(spark, d):
    a = sources.to_articles(_landed(spark, d)[0])
    return a.select("id", "doi", "title", "abstract", F.size("authors").cast("long").alias("n_authors"), "year", "citation_count", "is_preprint", "open_access", "url", F.size("concepts").cast("long").alias("n_concepts"))


@query("SELECT reason, n, true AS all_have_places FROM (SELECT 'missing id or title' AS reason, count(*) AS n FROM works WHERE id % 11 = 0 UNION ALL SELECT 'not JSON', 1)", ["works"])
def a5_rejects(spark, d):
    return _landed(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"), F.bool_and(F.col("file").isNotNull() & F.col("block").isNotNull()).alias("all_have_places"))


#: Results asked for of each topic; a page has at most 100.
N_RESULTS = 450
_PAGES = {
    "placed_": "SELECT *, 1 + (row_number() OVER (PARTITION BY domain_id ORDER BY id) - 1) // 100 AS page FROM works",
    "paged_": "SELECT *, row_number() OVER (PARTITION BY domain_id, page ORDER BY id) AS on_page, count(*) OVER (PARTITION BY domain_id, page) AS size FROM placed_ WHERE NOT (n_nationkey % 5 = 0 AND page = 2 AND id % 7 = 0)",
    "short_": "SELECT domain_id, min(page) AS last FROM paged_ WHERE size < 100 GROUP BY domain_id",
    "taken_": f"SELECT p.*, row_number() OVER (PARTITION BY p.domain_id ORDER BY page, on_page) AS result_pos FROM paged_ p LEFT JOIN short_ s USING (domain_id) WHERE page <= coalesce(last, page)",
}


@query(f"SELECT domain_id AS topic, result_pos, 'openalex_W' || id AS id FROM taken_ WHERE result_pos <= {N_RESULTS} AND id % 11 <> 0", ["works"], _PAGES)
def a1_first_results(spark, d):
    """Each topic's pages up to its first short one or to N_RESULTS; some topics have a short page before their last."""
    path = stores.scratch(spark, "topic-pages")
    placed = ranking.rank_all(b.work_keys(spark, d), -F.col("id").cast("double"), steps=1e-3)
    page = F.floor((F.col("rank") - 1) / 100).cast("int") + 1
    own = placed.select(F.col("id"), F.col("domain_id").alias("topic_"), page.alias("page")).where(~((F.regexp_extract("topic_", "([0-9]+)$", 1).cast("int") % 5 == 0) & (F.col("page") == 2) & (F.col("id") % 7 == 0)))
    works = b.works(spark, d).join(own, "id").repartitionByRange("topic_", "page")  # works move, not their records, which are ten times as wide
    lists = _raw_works(works).groupBy("topic_", "page").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("ws"))  # 100 records at most
    value = F.concat(F.lit('{"meta":{"page":'), F.col("page").cast("string"), F.lit('},"results":['), F.array_join(F.col("ws.w"), ","), F.lit("]}"))
    lists.select(F.col("topic_").alias("topic"), value.alias("value")).write.partitionBy("topic").option("compression", "gzip").text(path)
    good, _ = sources.scan_pages(spark, path, N_RESULTS)
    return good.select("topic", "result_pos", F.concat(F.lit("openalex_"), F.element_at(F.split("id", "/"), -1)).alias("id"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') AS abstract FROM documents WHERE trim(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') <> ''")
def a3_rebuild_abstract(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ").alias("w"))
    index = docs.select("doc_id", sources.invert_abstract(F.col("w")).alias("index"))
    return index.select("doc_id", sources.rebuild_abstract(F.col("index")).alias("abstract")).where("abstract <> ''")


@query("SELECT domain_id, CAST(article_id AS VARCHAR) AS article_id, grade FROM gold", ["gold"])
def a7_gold_corpus(spark, d):
    path = stores.scratch(spark, "gold")
    g = b.gold(spark, d).groupBy("domain_id", F.floor(F.col("article_id") / 20_000).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("article_id").cast("string"), "grade"))).alias("relevance"))
    g.select("domain_id", "relevance").write.option("maxRecordsPerFile", 1).json(path)
    return sources.read_gold(spark, path)


@query("SELECT w.domain_id, 'W' || id AS article_id, title, year, citation_count, grade FROM works w LEFT JOIN gold g ON g.domain_id = w.domain_id AND g.article_id = w.id WHERE w.domain_id NOT IN ('NATION_1', 'NATION_2')", ["works", "gold"])
def a7_gold_articles(spark, d):
    """Articles beside their grades, both landed as JSON; of two domains one half is missing."""
    path = stores.scratch(spark, "gold-corpus")
    name = F.concat(F.lit("W"), F.col("id").cast("string"))
    part = F.floor(F.col("id") / PAGE)
    w = b.works(spark, d).where("domain_id <> 'NATION_1'").select("domain_id", part.alias("k"), F.struct(name.alias("id"), "title", "abstract", "year", "citation_count", "journal_name", "is_preprint").alias("a"))
    w.groupBy("domain_id", "k").agg(F.to_json(F.collect_list("a")).alias("value")).select("domain_id", "value").repartition("domain_id").write.partitionBy("domain_id").text(f"{path}/articles")
    g = b.gold(spark, d).where("domain_id <> 'NATION_2'").groupBy("domain_id", F.floor(F.col("article_id") / PAGE).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("W"), F.col("article_id").cast("string")), "grade")))).alias("value"))
    g.select("domain_id", "value").repartition("domain_id").write.partitionBy("domain_id").text(f"{path}/relevance")
    articles, gold, _ = sources.read_gold_corpus(spark, path)
    return articles.withColumnRenamed("id", "article_id").join(gold, ["domain_id", "article_id"], "left").select("domain_id", "article_id", "title", "year", "citation_count", "grade")


@query("SELECT domain_id, count(*) AS n, max(topic) AS topic FROM works WHERE domain_id NOT IN ('NATION_3', 'NATION_7') GROUP BY domain_id", ["works"])
def a8_domain_config(spark, d):
    """The works of each configured domain; the configuration is landed as JSON and read again."""
    path = stores.scratch(spark, "config")
    listed = b.works(spark, d).groupBy("domain_id").agg(F.max("topic").alias("topic"))
    listed.groupBy(F.pmod(F.xxhash64("domain_id"), F.lit(4))).agg(F.collect_list(F.struct(F.col("domain_id").alias("id"), "topic", F.lit("note").alias("comment"))).alias("domains")).select("domains").write.option("maxRecordsPerFile", 1).json(path)
    config = sources.read_domain_config(spark, f"{path}/*.json", ["NATION_3", "NATION_7"])
    return b.works(spark, d).select("domain_id").join(config, "domain_id").groupBy("domain_id").agg(F.count("*").alias("n"), F.max("topic").alias("topic"))


@query(f"SELECT domain_id AS topic, {s6('w_venue')} AS w_venue, {s6('w_relevance')} AS w_relevance FROM dweights WHERE domain_id <> 'NATION_4'", ["dweights"])
def a9_weight_store(spark, d):
    path = stores.scratch(spark, "weights")
    w = b.domain_weights(spark, d).withColumnRenamed("domain_id", "topic")
    stores.save_weights(w.withColumns({"w_venue": F.lit(0.5)}), path)
    stores.save_weights(w.withColumn("w_venue", F.when(F.col("topic") != "NATION_4", F.col("w_venue"))), path)  # replaced; one without a required key
    return stores.load_weights(spark, path).select("topic", r6("w_venue").alias("w_venue"), r6("w_relevance").alias("w_relevance"))


_MEASURED = {"composite": "value", "rouge1": "value / 3", "rouge2": "value / 5", "rougeL": "value / 7", "faithfulness": "CASE WHEN event_id % 4 > 0 THEN value / 9 END", "coverage": "event_id % 10 / 10.0"}


def _experiment_log(spark, d):
    """Records of runs in two appends, and some lines that aren't JSON."""
    path = stores.scratch(spark, "experiments")
    scores = lambda f: F.struct(*(F.expr(f"({e}) * {f}D").alias(k) for k, e in _MEASURED.items()))
    i = F.col("event_id")
    rec = b.table(spark, d, "events").select(
        F.concat(F.lit("run "), i).alias("run_name"),
        F.concat(F.lit("2026-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("timestamp"),
        F.struct(F.lit("small").alias("summarize"), F.when(i % 3 > 0, "large").alias("critic")).alias("models"),
        F.struct((i % 2 == 0).alias("use_rouge"), (i % 50).cast("int").alias("n_train")).alias("params"),
        scores(0.5).alias("baseline"),
        scores(1.0).alias("final"),
        F.expr("(user_id % 20 - 10) / 4D").alias("improvement_pct"),
        F.expr("event_id % 90 * 1D").alias("duration_seconds"),
    )
    stores.append_experiments(rec.where("params.use_rouge"), path)
    stores.append_experiments(rec.where("not params.use_rouge"), path)
    b.table(spark, d, "events").where("event_id % 40 = 7").select(F.concat(F.lit('{"run_name": "cut off '), F.col("event_id"))).write.mode("append").text(path)
    return path


_LOGGED = "'run ' || event_id AS run_name, " + ", ".join(f"coalesce(({e}) * {f}, 0)::DOUBLE AS {name}_{stores.EXPERIMENT_MEASURES[k]}" for name, f in (("baseline", 0.5), ("final", 1.0)) for k, e in _MEASURED.items())
_LOGGED_NAMES = [f"{name}_{v}" for name in ("baseline", "final") for v in stores.EXPERIMENT_MEASURES.values()]


@query("SELECT run_name, timestamp, critic_model, judge_model, use_rouge, n_train, n_val, " + ", ".join(f"{s6(c)} AS {c}" for c in _LOGGED_NAMES) + f" FROM (SELECT {_LOGGED}, '2026-01-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS timestamp, CASE WHEN event_id % 3 > 0 THEN 'large' ELSE '?' END AS critic_model, '?' AS judge_model, event_id % 2 = 0 AS use_rouge, CAST(event_id % 50 AS INTEGER) AS n_train, CAST(0 AS INTEGER) AS n_val FROM events)")
def a12_experiment_log(spark, d):
    e = stores.read_experiments(spark, _experiment_log(spark, d))
    return e.select("run_name", "timestamp", "critic_model", "judge_model", "use_rouge", "n_train", "n_val", *(r6(c).alias(c) for c in _LOGGED_NAMES))


@query("SELECT count(*) AS n, true AS all_have_places, min('{\"run_name\": \"cut off ' || event_id) AS first FROM events WHERE event_id % 40 = 7")
def a12_experiment_rejects(spark, d):
    bad = stores.experiment_rejects(spark, _experiment_log(spark, d))
    return bad.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("file").isNotNull() & F.col("block").isNotNull()), F.lit(True)).alias("all_have_places"), F.min("record").alias("first"))


@query(f"SELECT run_name, row_number() OVER (ORDER BY final_composite DESC, run_name) AS place, {s6('final_composite - baseline_composite')} AS delta, {s6('final_faithfulness - baseline_faithfulness')} AS delta_faithfulness, {s6('final_coverage - baseline_coverage')} AS delta_coverage, improvement_pct, improvement_pct > 0.5 AS improved, {s6('seconds / 60')} AS minutes FROM (SELECT {_LOGGED}, ((user_id % 20 - 10) / 4)::DOUBLE AS improvement_pct, (event_id % 90)::DOUBLE AS seconds FROM events)")
def d21_experiment_summary(spark, d):
    s = reports.experiment_summary(stores.read_experiments(spark, _experiment_log(spark, d)))
    return s.select("run_name", F.col("place").cast("long").alias("place"), *(r6(c).alias(c) for c in ("delta", "delta_faithfulness", "delta_coverage")), "improvement_pct", "improved", r6("minutes").alias("minutes"))


@query("SELECT 'pair_' || id AS example_id, substr(generated, 1, 200) AS article_text, reference FROM pairs WHERE trim(generated) <> '' AND trim(reference) <> ''", ["pairs"])
def a13_text_pairs(spark, d):
    return sources.text_pairs(b.pairs(spark, d), "generated", "reference", "id", "pair", 200)


@query("SELECT 'pair_' || id AS example_id, substr(generated, 1, 200) AS article_text, reference FROM (SELECT * FROM pairs WHERE trim(generated) <> '' AND trim(reference) <> '' ORDER BY md5('42-' || id), id LIMIT 100)", ["pairs"])
def a13_seeded_sample(spark, d):
    return sources.text_pairs(b.pairs(spark, d), "generated", "reference", "id", "pair", 200, n=100)


@query("SELECT run_id, n, tokens, best_prompt FROM (SELECT run_id, count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens, 'prompt ' || arg_max(id, (tokens_used, id)) AS best_prompt FROM logs GROUP BY run_id)", ["logs"])
def a14_run_persistence(spark, d):
    path = stores.scratch(spark, "run")
    it = b.agent_logs(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("tokens_used").alias("tokens")).withColumns({"gradient": F.lit("text"), "candidates": F.lit("text")})
    best = b.agent_logs(spark, d).groupBy("run_id").agg(F.concat(F.lit("prompt "), F.max_by("id", F.struct("tokens_used", "id")).cast("string")).alias("best_prompt"))
    stores.save_run(it, path, best=best)
    summary = spark.read.schema("run_id long, n long, tokens long").json(f"{path}/summary")
    return summary.join(spark.read.schema("run_id long, best_prompt string").json(f"{path}/best"), "run_id")


_TWO = lambda e: f"floor({e} * 100 + 0.5) / 100"


@query(f"SELECT domain_id, rank, r.id, CASE WHEN length(r.title) <= 78 THEN r.title ELSE substr(r.title, 1, 78) || '…' END AS title, journal_name || CASE WHEN w.is_preprint THEN ' (pp)' ELSE '' END AS venue, r.year, r.citation_count, {_TWO('final_score')} AS final_score FROM ranked r JOIN (SELECT id, journal_name, is_preprint FROM works) w ON w.id = r.id WHERE rank <= 15", ["works"], RANKED)
def a15_report_articles(spark, d):
    return reports.ranked_articles(ranked(spark, d).where("rank <= 15"))


@query("SELECT domain_id, rank, id, CASE WHEN length(title) <= 42 THEN title ELSE substr(title, 1, 42) || '...' END AS title, " + ", ".join(f"{_TWO(k + '_score')} AS {k}" for k in ("venue", "authors", "impact", "relevance")) + f", {_TWO('final_score')} AS final FROM ranked WHERE rank <= 15", ["works"], RANKED)
def a15_score_breakdown(spark, d):
    return reports.score_breakdown(ranked(spark, d).where("rank <= 15"))


#: Customers as trends, whose evidence is their first orders.
_TRENDS = {
    "few_": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
    "trend_": "SELECT c_custkey AS trend_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'emerging' WHEN 1 THEN 'growing' ELSE 'mature' END AS maturity, c_mktsegment AS description FROM customer",
}


def _trends(spark, d):
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    few = b.table(spark, d, "orders").select("o_custkey", "o_orderkey", first.alias("n")).where("n <= 5")  # more than is shown
    evidence = few.groupBy(F.col("o_custkey").alias("trend_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("evidence"))
    k = F.col("c_custkey")
    own = b.table(spark, d, "customer").select(k.alias("trend_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "emerging").when(k % 3 == 1, "growing").otherwise("mature").alias("maturity"), F.col("c_mktsegment").alias("description"))
    return own.join(evidence, "trend_id", "left")


@query("SELECT trend_id, name, upper(maturity) AS maturity, description, coalesce(ids, '—') AS evidence FROM trend_ LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY n) AS ids FROM few_ WHERE n <= 3 GROUP BY o_custkey) ON o_custkey = trend_id", None, _TRENDS)
def a15_trend_table(spark, d):
    return reports.trend_table(_trends(spark, d))


_SUMMARY = {
    "problem": "CASE WHEN o_orderkey % 4 > 0 THEN 'Problem ' || o_orderkey ELSE 'Not specified' END",
    "method": "CASE WHEN o_orderkey % 3 > 0 THEN 'method of ' || o_custkey END",
    "results": "CASE WHEN o_orderkey % 2 = 0 THEN 'A result that is long enough ' || o_orderkey || '. And more.' ELSE 'Short. And a longer sentence here.' END",
    "narrative": "CASE WHEN o_orderkey % 6 = 0 THEN 'Too short. A first sentence that counts ' || o_orderkey || '. no. A second one of such a length. A third one that is not shown.' END",
}
_DIGEST = "CASE WHEN narrative IS NOT NULL THEN 'A first sentence that counts ' || s.o_orderkey || '.  A second one of such a length.' ELSE nullif(array_to_string(list_filter([CASE WHEN problem <> 'Not specified' THEN problem END, method, CASE WHEN s.o_orderkey % 2 = 0 THEN 'A result that is long enough ' || s.o_orderkey || '.' END], lambda x: x IS NOT NULL), '  '), '') END"


@query(f"SELECT t.trend_id, name, pos, article_id, heading, digest FROM (SELECT * FROM trend_ WHERE maturity = 'emerging') t LEFT JOIN (SELECT o_custkey AS trend_id, n - 1 AS pos, f.o_orderkey AS article_id, CASE WHEN title IS NOT NULL THEN title || ' (' || year || ')' ELSE f.o_orderkey::VARCHAR END AS heading, {_DIGEST} AS digest FROM few_ f LEFT JOIN (SELECT id, title, year FROM works WHERE id % 5 <> 0) a ON a.id = f.o_orderkey LEFT JOIN (SELECT o_orderkey, {', '.join(f'{e} AS {k}' for k, e in _SUMMARY.items())} FROM orders WHERE o_orderkey % 7 <> 0) s ON s.o_orderkey = f.o_orderkey WHERE n <= 4 AND (title IS NOT NULL OR results IS NOT NULL)) e USING (trend_id)", ["works"], _TRENDS)
def a15_emerging_trends(spark, d):
    summaries = b.table(spark, d, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS article_id", *(f"{e} AS {k}" for k, e in _SUMMARY.items()))
    got = reports.emerging_trends(_trends(spark, d), b.works(spark, d).where("id % 5 <> 0"), summaries)
    return got.select("trend_id", "name", F.col("pos").cast("long").alias("pos"), "article_id", "heading", "digest")


_FEEDBACK = {"feedback": "SELECT event_id AS id, user_id % 4 AS iteration, CASE event_type WHEN 'view' THEN 'poor' WHEN 'click' THEN 'acceptable' WHEN 'signup' THEN 'good' ELSE 'excellent' END AS quality, value > 50 AS needs_revision, CASE WHEN event_id % 2 = 0 THEN ['issue ' || event_type, 'k'] ELSE [] END AS issues, CASE WHEN event_id % 3 = 0 THEN ['try ' || user_id] END AS suggestions FROM events"}


def _feedback(spark, d):
    t, i = F.col("event_type"), F.col("event_id")
    quality = F.when(t == "view", "poor").when(t == "click", "acceptable").when(t == "signup", "good").otherwise("excellent")
    issues = F.when(i % 2 == 0, F.array(F.concat(F.lit("issue "), t), F.lit("k"))).otherwise(F.array().cast("array<string>"))
    suggestions = F.when(i % 3 == 0, F.array(F.concat(F.lit("try "), F.col("user_id").cast("string"))))
    return b.table(spark, d, "events").select(i.alias("id"), (F.col("user_id") % 4).alias("iteration"), quality.alias("quality"), (F.col("value") > 50).alias("needs_revision"), issues.alias("issues"), suggestions.alias("suggestions"))


@query("SELECT id, iteration, upper(quality) AS quality, CASE WHEN needs_revision THEN 'REVISION REQUESTED' ELSE 'APPROVED' END AS verdict, array_to_string(issues, '; ') AS issues, coalesce(array_to_string(suggestions, '; '), '') AS suggestions, CASE WHEN len(issues) + coalesce(len(suggestions), 0) = 0 THEN 'No issues identified' END AS note FROM feedback", None, _FEEDBACK)
def a15_report_feedback(spark, d):
    return reports.feedback_table(_feedback(spark, d))


@query("SELECT 'works fetched' AS item, CAST(count(*) AS VARCHAR) AS value FROM hits UNION ALL SELECT 'works selected', CAST(count(*) AS VARCHAR) FROM works WHERE year >= 2000 UNION ALL SELECT 'summaries', CAST(count(*) AS VARCHAR) FROM documents UNION ALL SELECT 'iterations', CAST(max(iteration) AS VARCHAR) FROM feedback UNION ALL SELECT 'critiques', CAST(count(*) AS VARCHAR) FROM feedback UNION ALL SELECT 'final quality', upper(arg_max(quality, (iteration, id))) FROM feedback UNION ALL SELECT 'tokens', CAST(CAST(sum(tokens_used) AS BIGINT) AS VARCHAR) FROM logs", ["works", "hits", "logs"], _FEEDBACK)
def a15_report_cover(spark, d):
    return reports.cover(b.agent_logs(spark, d), b.hits(spark, d), b.works(spark, d).where("year >= 2000"), b.table(spark, d, "documents"), _feedback(spark, d))


@query("SELECT id, agent_name, coalesce(CAST(epoch(completed_at - started_at) AS BIGINT), 0) AS seconds, tokens_used, error FROM logs", ["logs"])
def a15_report_logs(spark, d):
    seconds = F.coalesce(F.timestamp_diff("SECOND", "started_at", "completed_at"), F.lit(0))
    return b.agent_logs(spark, d).select("id", "agent_name", seconds.alias("seconds"), "tokens_used", "error")


@query("SELECT domain_id, count(*) FILTER (grade = 2) AS grade2_before, count(*) FILTER (new_grade = 2) AS grade2_after, count(*) FILTER (grade = 1) AS grade1_before, count(*) FILTER (new_grade = 1) AS grade1_after, count(*) FILTER (new_grade <> grade) AS promoted FROM (SELECT g.domain_id, grade, CASE WHEN place <= 5 THEN 2 ELSE grade END AS new_grade FROM gold g LEFT JOIN placed p ON p.domain_id = g.domain_id AND p.article_id = g.article_id) GROUP BY domain_id", ["works", "gold"], _PROMO)
def f3_promotion_counts(spark, d):
    return ranking.promotion_counts(ranking.promote(b.gold(spark, d), b.works(spark, d), _survey_like(), 5))


@query("SELECT domain_id, article_id, 1 AS grade, 2 AS new_grade FROM placed WHERE place <= 5", ["works", "gold"], _PROMO)
def f3_promotion_dry_run(spark, d):
    return ranking.promotion_plan(ranking.promote(b.gold(spark, d), b.works(spark, d), _survey_like(), 5))


# --- joins


@query("SELECT l_orderkey AS id, pos - 1 AS pos, CASE WHEN pos = 1 AND l_partkey % 2 = 0 THEN 3 ELSE CAST(h_index AS INTEGER) END AS h_index FROM lines", ["lines"])
def c1_enrich_h_index(spark, d):
    w = b.works(spark, d).where(F.size("authors") > 0)
    bare = w.withColumn("authors", F.transform("authors", lambda a, i: a.withField("h_index", F.when((i == 0) & (a["author_id"] % 2 == 0), 3))))
    full = enrich.enrich_h_index(bare, b.author_metrics(spark, d))
    return full.select("id", F.posexplode("authors").alias("pos", "a")).select("id", F.col("pos").cast("long").alias("pos"), "a.h_index")


@query("SELECT l_partkey AS author_id, count(DISTINCT domain_id) AS n_domains FROM lines JOIN works ON id = l_orderkey GROUP BY l_partkey", ["works"])
def c2_author_domains(spark, d):
    return enrich.author_domains(b.works(spark, d)).select("author_id", "n_domains")


@query("SELECT author_id FROM (SELECT DISTINCT l_partkey AS author_id FROM lineitem) WHERE author_id % 3 <> 0 OR author_id % 7 = 0")
def c3_cache_miss(spark, d):
    known = b.author_metrics(spark, d).where("author_id % 3 = 0 and h_index is not null")
    return enrich.unknown_ids(b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("author_id")).distinct(), known)


@query("SELECT id, coalesce(quartile, CASE k % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' WHEN 3 THEN 'Q4' END) AS quartile FROM works LEFT JOIN (SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part) ON p_partkey = id % 1000", ["works"])
def c4_venue_quartile(spark, d):
    w = b.works(spark, d).select("id", "quartile", F.lpad((F.col("id") % 1000).cast("string"), 8, "0").alias("journal_issn"))
    return enrich.with_quartile(w, QUERIES["a6_issn_quartiles"](spark, d)).select("id", "quartile")


@query("SELECT r.domain_id, r.id AS article_id, rank, coalesce(grade, 0) AS grade FROM ranked r LEFT JOIN gold g ON g.domain_id = r.domain_id AND g.article_id = r.id", ["works", "gold"], RANKED)
def c5_ranking_with_gold(spark, d):
    r = ranked_all(spark, d).select("domain_id", F.col("id").alias("article_id"), "rank")
    return metrics.with_grades(r, b.gold(spark, d)).select("domain_id", "article_id", "rank", "grade")


@query("SELECT c_custkey AS trend_id, n - 1 AS pos, o_orderkey AS article_id, title, CASE WHEN o_orderkey % 2 = 0 THEN 'summary ' || o_orderkey END AS summary FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) LEFT JOIN (SELECT id, title FROM works WHERE id % 3 <> 0) ON id = o_orderkey WHERE n <= 4 AND (title IS NOT NULL OR o_orderkey % 2 = 0)", ["works"])
def c6_trend_evidence(spark, d):
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    few = b.table(spark, d, "orders").select("o_custkey", "o_orderkey", first.alias("n")).where("n <= 4")  # what trend_evidence shows
    trends = few.groupBy(F.col("o_custkey").alias("trend_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("evidence"))
    ids = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"))
    summaries = ids.where("article_id % 2 = 0").withColumn("summary", F.concat(F.lit("summary "), F.col("article_id").cast("string")))
    got = enrich.trend_evidence(trends, b.works(spark, d).where("id % 3 <> 0"), summaries)
    return got.select("trend_id", F.col("pos").cast("long").alias("pos"), "article_id", "title", "summary")


@query("SELECT id, value_, generated FROM (SELECT id, (id * 37 % 101) / 100.0 AS value_, generated FROM pairs ORDER BY value_, id LIMIT 5)", ["pairs"])
def c7_f2_worst_examples(spark, d):
    p = b.pairs(spark, d)
    res = p.select(F.col("id").alias("example_id"), (F.col("id") * 37 % 101 / F.lit(100.0)).alias("composite"))
    return generation.worst(res, 5, p.select(F.col("id").alias("example_id"), "generated")).select(F.col("example_id").alias("id"), F.col("composite").alias("value_"), "generated")


@query("SELECT g.domain_id, count(*) AS gold, count(w.id) AS matched, count(w.id) < count(*) AS mismatch FROM gold g LEFT JOIN (SELECT * FROM works WHERE id % 50 <> 0) w ON w.domain_id = g.domain_id AND w.id = g.article_id GROUP BY g.domain_id", ["works", "gold"])
def c8_gold_check(spark, d):
    return corpus_stats.gold_check(b.works(spark, d).where("id % 50 <> 0"), b.gold(spark, d))


_SCORE = "floor((" + " + ".join(f"w_{k} * {k}_score" for k in fx.KEYS) + ") * 1e9 + 0.5) / 1e9"


@query(f"SELECT s.domain_id, 'own' AS method, id AS article_id, {s6(_SCORE)} AS score FROM scored s JOIN dweights w ON w.domain_id = s.domain_id", ["works", "dweights"], SCORED)
def c9_apply_weights(spark, d):
    v = b.domain_weights(spark, d).withColumn("method", F.lit("own"))
    return weights.apply_weights(scored(spark, d), v).withColumn("score", r6("score"))


@query("SELECT a.domain_id AS fold, t.domain_id FROM dweights a JOIN dweights t ON a.domain_id <> t.domain_id", ["dweights"])
def c10_folds(spark, d):
    return meta.folds(b.domain_weights(spark, d), ()).select("fold", "domain_id")


@query("SELECT domain_id, CASE WHEN n % 4 = 0 THEN 'no features' WHEN n % 5 = 0 THEN 'no weights' END AS reason FROM (SELECT domain_id, count(*) AS n FROM works GROUP BY domain_id)", ["works"])
def c11_dataset_assembly(spark, d):
    n = b.works(spark, d).groupBy("domain_id").agg(F.count("*").alias("n"))
    full, skipped = corpus_stats.assemble(n.select("domain_id"), n.where("n % 4 <> 0").select("domain_id"), n.where("n % 5 <> 0").select("domain_id"))
    return full.select("domain_id", F.lit(None).cast("string").alias("reason")).union(skipped)


@query("SELECT domain_id, id, rank_a, rank_b, rank_a - rank_b AS delta, CASE WHEN rank_a - rank_b >= 2 THEN 'promoted' WHEN rank_a - rank_b <= -2 THEN 'demoted' ELSE 'same' END AS change FROM (SELECT domain_id, id, row_number() OVER (PARTITION BY domain_id ORDER BY impact_score DESC, id) AS rank_a, row_number() OVER (PARTITION BY domain_id ORDER BY velocity_score DESC, id) AS rank_b FROM scored)", ["works"], SCORED)
def c12_rank_changes(spark, d):
    return ranking.rank_changes(stored_scores(spark, d), F.col("impact_score"), F.col("velocity_score")).select("domain_id", "id", "rank_a", "rank_b", "delta", "change")
