"""Registered queries on corpus statistics, ranking quality, weight search, meta-learning and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import generation as gx
from ..functions import text as tx
from ..operators import corpus_stats, generation, meta, metrics, ranking, reports, significance, weights
from ..sources import stores
from . import bindings as b
from .bindings import DEFAULT_WEIGHTS, RECENT_YEAR
from .registry import _F1, _LCS, _ROUGE, RANKED, SCORED, _SCORE, query, r6, ranked, s6, scored, stored_scores

FEATS = corpus_stats.FEATURES

# --- corpus statistics

_STATS = {
    "first_": "SELECT l_orderkey, 'Author ' || l_partkey AS name, h_index AS h FROM lines WHERE pos = 1",
    "base": f"""SELECT w.*, f.name, f.h, g.grade, row_number() OVER (PARTITION BY w.domain_id ORDER BY citation_count, w.id) AS i,
        len(list_filter(regexp_split_to_array(lower(topic), '\\s+'), lambda x: length(x) > 2 AND contains(lower(concepts_text), x))) > 0 AS overlap
        FROM works w LEFT JOIN first_ f ON f.l_orderkey = w.id LEFT JOIN gold g ON g.domain_id = w.domain_id AND g.article_id = w.id""",
    "stats": f"""SELECT domain_id, count(*) AS corpus_size, median(year) AS median_year, avg((year >= {RECENT_YEAR})::INT) AS pct_recent, stddev_pop(year) AS year_std,
        2 * sum(i * citation_count) / (count(*) * sum(citation_count)) - (count(*) + 1) / count(*) AS citation_gini, median(citation_count) AS citation_median,
        avg((citation_count > 100)::INT) AS pct_high_cited, count(DISTINCT name) / count(*) AS unique_author_ratio, coalesce(avg(h), 0) AS mean_h_index,
        avg(coalesce(best_h >= 20, false)::INT) AS pct_high_hindex, avg(coalesce(quartile = 'Q1', false)::INT) AS pct_q1, avg(overlap::INT) AS topic_concept_overlap,
        avg((grade IS NOT NULL)::INT) AS gold_ratio, avg(coalesce(grade = 2, false)::INT) AS grade2_ratio FROM base GROUP BY domain_id""",
}


def _features(spark, d):
    return corpus_stats.domain_features(b.works(spark, d), b.gold(spark, d), recent_year=RECENT_YEAR)


@query("SELECT domain_id, corpus_size, " + ", ".join(f"{s6(f)} AS {f}" for f in FEATS) + " FROM stats", ["works", "gold"], _STATS)
def d1_d13_domain_features(spark, d):
    return _features(spark, d).select("domain_id", "corpus_size", *(r6(f).alias(f) for f in FEATS))


_ALL = "domain_id, corpus_size, " + ", ".join(f"{s6(f)} AS {f}" for f in FEATS)


@query(f"SELECT 'all' AS loaded, {_ALL} FROM stats UNION ALL SELECT 'one', {_ALL} FROM stats WHERE domain_id = 'NATION_5'", ["works", "gold"], _STATS)
def a10_feature_store(spark, d):
    path = stores.scratch(spark, "features")
    stores.save_features(_features(spark, d), path)
    every, one = stores.load_features(spark, path), stores.load_features(spark, path, "NATION_5")
    both = every.withColumn("loaded", F.lit("all")).union(one.withColumn("loaded", F.lit("one")))
    return both.select("loaded", "domain_id", "corpus_size", *(r6(f).alias(f) for f in FEATS))


_EXACT_FEATS = [f for f in FEATS if f != "unique_author_ratio"]


@query("SELECT domain_id, corpus_size, " + ", ".join(f"{s6(f)} AS {f}" for f in _EXACT_FEATS) + ", true AS authors_within_error FROM stats", ["works", "gold"], _STATS)
def d1_d13_merged_state(spark, d):
    """Features from a state to which the works were added in three parts; the sketch's estimate is held against the exact ratio."""
    path = stores.scratch(spark, "corpus-state")
    needed = ("domain_id", "id", "year", "citation_count", "authors", "quartile", "concepts_text", "topic")
    every, gold = stores.stored(b.works(spark, d).select(*needed), "works"), stores.stored(b.gold(spark, d), "gold")  # read four times
    for i in range(3):
        stores.add_to_state(spark, path, corpus_stats.corpus_state(every.where(F.col("id") % 3 == i), gold, recent_year=RECENT_YEAR))
    made = corpus_stats.state_features(stores.load_state(spark, path))
    exact = every.groupBy("domain_id").agg((F.countDistinct(F.get("authors", F.lit(0))["name"]) / F.count("*")).alias("exact"))
    near = F.abs(F.col("unique_author_ratio") - F.col("exact")) <= 0.05 * F.col("exact")
    return made.join(exact, "domain_id").select("domain_id", "corpus_size", *(r6(f).alias(f) for f in _EXACT_FEATS), near.alias("authors_within_error"))


@query("SELECT w.domain_id, count(*) FILTER (grade = 2) AS grade2, count(*) FILTER (grade = 1) AS grade1, count(*) FILTER (grade IS NULL) AS background FROM works w LEFT JOIN gold g ON g.domain_id = w.domain_id AND g.article_id = w.id GROUP BY w.domain_id", ["works", "gold"])
def d14_grade_counts(spark, d):
    return corpus_stats.grade_counts(b.works(spark, d), b.gold(spark, d))


_CORR = _STATS | {
    "fl": "SELECT domain_id, feature, x FROM (" + " UNION ALL ".join(f"SELECT domain_id, '{f}' AS feature, {f}::DOUBLE AS x FROM stats" for f in FEATS) + ")",
    "wl": "SELECT domain_id, key, y FROM (" + " UNION ALL ".join(f"SELECT domain_id, '{k}' AS key, w_{k} AS y FROM dweights" for k in fx.KEYS) + ")",
    "r_": "SELECT feature, key, CASE WHEN count(*) < 2 OR stddev_pop(x) < 1e-12 OR stddev_pop(y) < 1e-12 THEN 0.0 ELSE corr(x, y) END AS r FROM fl JOIN wl USING (domain_id) GROUP BY feature, key",
}


@query(f"SELECT feature, key, {s6('r')} AS r FROM r_", ["works", "gold", "dweights"], _CORR)
def d23_correlations(spark, d):
    return corpus_stats.correlations(_features(spark, d), b.domain_weights(spark, d)).select("feature", "key", r6("r").alias("r"))


@query(f"SELECT feature, {s6('max(abs(r))')} AS max_abs_r, count(*) FILTER (abs(r) >= 0.4) AS strong_pairs, max(abs(r)) > 0.4 AS selected FROM r_ GROUP BY feature", ["works", "gold", "dweights"], _CORR)
def d24_d25_feature_selection(spark, d):
    r = corpus_stats.correlations(_features(spark, d), b.domain_weights(spark, d))
    return corpus_stats.feature_order(r).select("feature", r6("max_abs_r").alias("max_abs_r"), "strong_pairs", "selected")


# --- ranking quality

_METRICS = RANKED | {
    "ranking_": "SELECT domain_id, 'final' AS method, id AS article_id, rank FROM ranked UNION ALL SELECT domain_id, 'impact', id, row_number() OVER (PARTITION BY domain_id ORDER BY impact_score DESC, id) FROM ranked",
    "graded": "SELECT r.*, coalesce(g.grade, 0) AS grade, (coalesce(g.grade, 0) >= 1)::INT AS hit, sum((coalesce(g.grade, 0) >= 1)::INT) OVER (PARTITION BY r.domain_id, method ORDER BY rank) AS so_far FROM ranking_ r LEFT JOIN gold g ON g.domain_id = r.domain_id AND g.article_id = r.article_id",
    "ideal_": "SELECT domain_id, sum((2.0::DOUBLE ** grade - 1) / log2(n + 1)) FILTER (n <= 10) AS i10, sum((2.0::DOUBLE ** grade - 1) / log2(n + 1)) FILTER (n <= 15) AS i15, count(*) FILTER (grade >= 1) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY grade DESC, article_id) AS n FROM gold) GROUP BY domain_id",
    "found_": "SELECT domain_id, method, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10) AS d10, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) FILTER (rank <= 15) AS d15, avg(hit) FILTER (rank <= 5) AS p5, avg(hit) FILTER (rank <= 10) AS p10, sum(hit) FILTER (rank <= 30) AS f30, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS ps FROM graded GROUP BY domain_id, method",
    "evaluated": "SELECT domain_id, method, d10 / i10 AS ndcg10, d15 / i15 AS ndcg15, p5, p10, f30 / relevant AS recall30, ps / relevant AS map FROM found_ JOIN ideal_ USING (domain_id)",
}
_NAMES = ("ndcg10", "ndcg15", "p5", "p10", "recall30", "map")


def _rankings(spark, d):
    own = stored_scores(spark, d).select("domain_id", F.col("id").alias("article_id"), "final_score", "impact_score")
    by = lambda score, name: ranking.rank_all(own, F.col(score), position="article_id").select("domain_id", F.lit(name).alias("method"), "article_id", "rank")
    return by("final_score", "final").union(by("impact_score", "impact"))


@query("SELECT domain_id, method, " + ", ".join(f"{s6(m)} AS {m}" for m in _NAMES) + " FROM evaluated", ["works", "gold"], _METRICS)
def d26_d33_ranking_metrics(spark, d):
    return metrics.evaluate(_rankings(spark, d), b.gold(spark, d)).select("domain_id", "method", *(r6(m).alias(m) for m in _NAMES))


#: A few fixed methods: one key high each, and the default.
_METHODS = [("default", *(DEFAULT_WEIGHTS[k] for k in fx.KEYS))] + [(f"only_{a}", *(0.5 if k == a else 0.1 for k in fx.KEYS)) for a in fx.KEYS]
_W = [f"w_{k}" for k in fx.KEYS]


def _loo_sql(vectors: str, on: str = "") -> dict[str, str]:
    return SCORED | {
        "vec": vectors,
        "app": f"SELECT s.domain_id, method, id AS article_id, {_SCORE} AS score FROM scored s JOIN vec w ON " + (on or "true"),
        "placed": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, method ORDER BY score DESC, article_id) AS rank FROM app) WHERE rank <= 15",
        "dcg_": "SELECT p.domain_id, method, sum((2.0::DOUBLE ** coalesce(grade, 0) - 1) / log2(rank + 1)) AS dcg FROM placed p LEFT JOIN gold g ON g.domain_id = p.domain_id AND g.article_id = p.article_id GROUP BY p.domain_id, method",
        "ideal_": _METRICS["ideal_"],
        "loo": "SELECT d.domain_id, method, CASE WHEN coalesce(i15, 0) = 0 THEN 0.0 ELSE dcg / i15 END AS ndcg15 FROM dcg_ d LEFT JOIN ideal_ i ON i.domain_id = d.domain_id",
    }


def _values(rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows) + f") AS t(method, {', '.join(_W)})"


_LOO = _loo_sql(_values(_METHODS))


def _loo(spark, d):
    v = spark.createDataFrame(_METHODS, "method string, " + ", ".join(f"{w} double" for w in _W))
    return stores.stored(weights.ndcg(scored(spark, d), v, b.gold(spark, d)), "loo")  # a row for each domain and method; some join it with itself


@query(f"SELECT domain_id, method, {s6('ndcg15')} AS ndcg15 FROM loo", ["works", "gold"], _LOO)
def d29_ndcg_by_method(spark, d):
    return _loo(spark, d).select("domain_id", "method", r6("ndcg15").alias("ndcg15"))


_FOUR = _LOO | {"wide": "SELECT domain_id, max(ndcg15) FILTER (method = 'default') AS default_, max(ndcg15) FILTER (method = 'only_impact') AS only_impact, max(ndcg15) FILTER (method = 'only_relevance') AS only_relevance, max(ndcg15) FILTER (method = 'only_venue') AS only_venue FROM loo GROUP BY domain_id"}


@query(
    "SELECT domain_id, " + ", ".join(f"{s6(c)} AS {c}" for c in ("default_", "only_impact", "only_relevance", "only_venue")) + ", CASE WHEN list_sort([default_, only_impact, only_relevance, only_venue], 'DESC')[1] - list_sort([default_, only_impact, only_relevance, only_venue], 'DESC')[2] <= 0.001 THEN 'tie' WHEN default_ >= greatest(only_impact, only_relevance, only_venue) THEN 'default_' WHEN only_impact >= greatest(only_relevance, only_venue) THEN 'only_impact' WHEN only_relevance >= only_venue THEN 'only_relevance' ELSE 'only_venue' END AS winner FROM wide",
    ["works", "gold"], _FOUR,
)
def d34_four_way_comparison(spark, d):
    four = ["default", "only_impact", "only_relevance", "only_venue"]
    wide = _loo(spark, d).groupBy("domain_id").pivot("method", four).agg(F.max("ndcg15")).withColumnRenamed("default", "default_")
    names = ["default_", *four[1:]]
    return metrics.winner(wide, names).select("domain_id", *(r6(n).alias(n) for n in names), "winner")


#: Relevance by keywords or by embeddings, weights by default or learned.
_VARIANTS = ["keyword_default", "keyword_learned", "embedding_default", "embedding_learned"]
_DOTE = "list_sum(list_transform(list_zip(e.embedding, t.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _variant_sql() -> dict[str, str]:
    learned = "SELECT domain_id, 'learned' AS method, " + ", ".join(_W) + " FROM dweights UNION ALL SELECT domain_id, 'default', " + ", ".join(repr(float(DEFAULT_WEIGHTS[k])) + "::DOUBLE" for k in fx.KEYS) + " FROM dweights"
    other = {}
    keys = [f"{k}_score" if k != "relevance" else "sem.r AS relevance_score" for k in fx.KEYS]
    other["two"] = "SELECT 'keyword' AS variant, domain_id, id, " + ", ".join(f"{k}_score" for k in fx.KEYS) + " FROM scored UNION ALL SELECT 'embedding', domain_id, id, " + ", ".join(keys) + " FROM scored s JOIN sem ON sem.vec_id = s.id % 500"
    loo = _loo_sql(learned)
    return SCORED | {"sem": f"SELECT e.vec_id, {s6(f'greatest(({_DOTE} + 1) / 2, 0.05)')} AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) t"} | other | {
        "vec": learned,
        "app": f"SELECT s.domain_id, variant || '_' || method AS method, id AS article_id, {_SCORE} AS score FROM two s JOIN vec w ON w.domain_id = s.domain_id",
    } | {k: loo[k] for k in ("placed", "dcg_", "ideal_", "loo")} | {
        "wide": "SELECT coalesce(domain_id, 'MEAN') AS domain_id, " + ", ".join(f"avg(ndcg15) FILTER (method = '{m}') AS {m}" for m in _VARIANTS) + " FROM loo GROUP BY ROLLUP (domain_id)",
    }


_BEST = "list_sort([" + ", ".join(f"{{'v': {m}, 'm': '{m}'}}" for m in _VARIANTS) + "], 'DESC')"


@query("SELECT domain_id, " + ", ".join(f"{s6(m)} AS {m}" for m in _VARIANTS) + f", CASE WHEN {_BEST}[1].v - {_BEST}[2].v <= 0.001 THEN 'tie' ELSE {_BEST}[1].m END AS winner FROM wide", ["works", "gold", "dweights"], _variant_sql())
def d34_relevance_by_weights(spark, d):
    """Two relevance variants, each with default and with learned weights, per domain and on average."""
    keyword = stores.stored(scored(spark, d).select("domain_id", "id", *(f"{k}_score" for k in fx.KEYS)), "sub-scores")
    gold = stores.stored(b.gold(spark, d), "gold")
    e = b.table(spark, d, "embeddings")
    topic = e.where("vec_id = 0").select(F.col("embedding").alias("topic"))
    sem = e.crossJoin(F.broadcast(topic)).select("vec_id", r6(fx.semantic_relevance(F.col("embedding"), F.col("topic"))).alias("__r"))  # one topic vector
    other = keyword.join(sem, F.col("id") % 500 == F.col("vec_id")).withColumn("relevance_score", F.col("__r")).drop("vec_id", "__r")
    learned = b.domain_weights(spark, d)
    default = learned.select("domain_id", *(F.lit(float(DEFAULT_WEIGHTS[k])).alias(f"w_{k}") for k in fx.KEYS))
    vectors = learned.withColumn("method", F.lit("learned")).union(default.withColumn("method", F.lit("default")))
    of = lambda s, name: weights.ndcg(s, vectors.withColumn("method", F.concat(F.lit(name), "method")), gold)
    wide = metrics.comparison(of(keyword, "keyword_").union(of(other, "embedding_")), _VARIANTS)
    return wide.select("domain_id", *(r6(m).alias(m) for m in _VARIANTS), "winner")


_WINS = _LOO | {"won": "SELECT a.method, count(*) FILTER (a.ndcg15 - z.ndcg15 > 1e-9) AS wins, count(*) FILTER (a.ndcg15 - z.ndcg15 < -1e-9) AS losses, count(*) FILTER (abs(a.ndcg15 - z.ndcg15) <= 1e-9) AS ties, count(*) AS n FROM loo a JOIN loo z ON z.domain_id = a.domain_id AND z.method = 'default' WHERE a.method <> 'default' GROUP BY a.method"}


@query(f"SELECT method, wins, losses, ties, {s6('wins / n')} AS win_rate, CAST(ceil(0.75 * n) AS BIGINT) AS needed, wins >= ceil(0.75 * n) AS supported FROM won", ["works", "gold"], _WINS)
def d35_d36_wins_and_verdict(spark, d):
    loo = _loo(spark, d)
    won = metrics.wins(loo, "default")
    return metrics.verdict(won, F.col("wins") + F.col("losses") + F.col("ties")).withColumn("win_rate", r6("win_rate")).select("method", "wins", "losses", "ties", "win_rate", F.col("needed").cast("long").alias("needed"), "supported")


@query(f"SELECT method, {s6('m')} AS mean, {s6('(m / max(CASE WHEN method = ' + chr(39) + 'default' + chr(39) + ' THEN m END) OVER () - 1) * 100')} AS gain_pct FROM (SELECT method, avg(ndcg15) AS m FROM loo GROUP BY method)", ["works", "gold"], _LOO)
def d37_mean_by_method(spark, d):
    return metrics.mean_by_method(_loo(spark, d)).select("method", r6("mean").alias("mean"), r6("gain_pct").alias("gain_pct"))


_SWEEP_ROWS = [(f"a{i}", *(round(i / 10, 1) * DEFAULT_WEIGHTS[k] + (1 - i / 10) / 6 for k in fx.KEYS)) for i in range(11)]
_SWEEP = _loo_sql(_values(_SWEEP_ROWS + [_METHODS[1]]))


@query(f"SELECT alpha, wins, {s6('mean')} AS mean, row_number() OVER (ORDER BY wins DESC, floor(mean * 1e9 + 0.5) DESC, alpha) AS place FROM (SELECT CAST(substr(a.method, 2) AS INTEGER) / 10.0 AS alpha, count(*) FILTER (a.ndcg15 > z.ndcg15) AS wins, avg(a.ndcg15) AS mean FROM loo a JOIN loo z ON z.domain_id = a.domain_id AND z.method = 'only_venue' WHERE a.method <> 'only_venue' GROUP BY a.method)", ["works", "gold"], _SWEEP)
def d38_alpha_sweep(spark, d):
    v = spark.createDataFrame(_SWEEP_ROWS + [_METHODS[1]], "method string, " + ", ".join(f"{w} double" for w in _W))
    loo = stores.stored(weights.ndcg(scored(spark, d), v, b.gold(spark, d)), "loo")
    swept = loo.where("method <> 'only_venue'").select("domain_id", (F.substring("method", 2, 9).cast("int") / F.lit(10.0)).alias("alpha"), "ndcg15")
    return metrics.best_alpha(swept, loo.where("method = 'only_venue'")).select("alpha", "wins", r6("mean").alias("mean"), F.col("place").cast("long").alias("place"))


def _horner(cs: tuple[float, ...]) -> str:
    out = repr(cs[0]) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * abs(z) + {c!r}::DOUBLE)"
    return out


#: The normal distribution's tail beyond z, by the same approximation as in Spark.
_TAIL = f"CASE WHEN abs(z) > {tx.TAIL_FAR} THEN 0.0 WHEN abs(z) < {tx.TAIL_TO!r} THEN exp(-abs(z) * abs(z) / 2) * {_horner(tx.TAIL_ABOVE)} / {_horner(tx.TAIL_BELOW)} ELSE exp(-abs(z) * abs(z) / 2) / (abs(z) + 1 / (abs(z) + 2 / (abs(z) + 3 / (abs(z) + 4 / (abs(z) + 0.65::DOUBLE))))) / {tx.ROOT_TWO_PI} END"


def _signed_sql(loo: dict[str, str], value: str = "a.ndcg15 - z.ndcg15") -> dict[str, str]:
    """All sign patterns are counted by their positive rank sum, one rank after another (ranks times two are whole)."""
    return loo | {
        "diff": f"SELECT a.method, a.domain_id, CASE WHEN abs(round({value}, 12)) <= 1e-9 THEN 0.0 ELSE round({value}, 12) END AS d FROM loo a JOIN loo z ON z.domain_id = a.domain_id AND z.method = 'default' WHERE a.method <> 'default'",
        "rk": "SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2 AS r FROM diff",
        "own_": "SELECT method, sum(CASE WHEN d > 0 THEN q ELSE 0.0 END) AS a, sum(CASE WHEN d < 0 THEN q ELSE 0.0 END) AS b FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2 AS q FROM diff WHERE d <> 0) GROUP BY method",
        "tied_": "SELECT method, sum(t * t * t - t)::DOUBLE AS tied FROM (SELECT method, abs(d), count(*) AS t FROM diff GROUP BY 1, 2) GROUP BY method",
        "sums_": "SELECT method, count(*)::DOUBLE AS k, count(*) FILTER (d <> 0) AS n, count(*) FILTER (d = 0) AS zeros, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0.0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0.0 END)::DOUBLE AS w_minus, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END)::DOUBLE AS up, coalesce(list(CAST(2 * r AS BIGINT) ORDER BY r) FILTER (d <> 0), []) AS ranks FROM rk GROUP BY method",
        "ways_": "WITH RECURSIVE dp AS (SELECT method, 0 AS i, ranks, list_transform(range(0, CAST(coalesce(list_sum(ranks), 0) AS BIGINT) + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ways FROM sums_ UNION ALL SELECT method, i + 1, ranks, list_transform(range(0, len(ways)), lambda j: ways[j + 1] + CASE WHEN j >= ranks[dp.i + 1] THEN ways[j - ranks[dp.i + 1] + 1] ELSE 0.0::DOUBLE END) FROM dp WHERE dp.i < len(ranks)) SELECT method, ways FROM dp WHERE i = len(ranks)",
        "z_": "SELECT *, CASE WHEN n >= 5 THEN (w_plus - k * (k + 1) / 4) / sqrt((k * (k + 1) * (2 * k + 1) - tied / 2) / 24) END AS z FROM sums_ JOIN tied_ USING (method)",
        "exact_": f"SELECT z_.*, CASE WHEN n = 0 THEN 0.0 ELSE (a - b) / (a + b) END AS rb, CASE WHEN z > 0 THEN {_TAIL} ELSE 1 - {_TAIL} END AS p_normal, CASE WHEN n BETWEEN 5 AND 50 THEN list_sum(ways[CAST(2 * up AS BIGINT) + 1 :]) / 2.0::DOUBLE ** n END AS p_exact FROM z_ JOIN ways_ USING (method) LEFT JOIN own_ USING (method)",
    }


_SIGNED = _signed_sql(_LOO)
_TESTED = f"SELECT method, n, zeros, w_plus, w_minus, {s6('rb')} AS r_biserial, {s6('z')} AS z, {s6('p_normal')} AS p_normal, {s6('p_exact')} AS p_exact, CASE WHEN zeros = 0 AND n <= 50 THEN {s6('p_exact')} ELSE {s6('p_normal')} END AS p, CASE WHEN abs(rb) >= 0.5 THEN 'large' WHEN abs(rb) >= 0.3 THEN 'medium' ELSE 'small' END AS effect FROM exact_"


def _tested(loo):
    tested = significance.signed_rank_test(loo, "default")
    return tested.withColumns({c: r6(c) for c in ("r_biserial", "z", "p_normal", "p_exact", "p")})


@query(f"SELECT method, n, w_plus, w_minus, {s6('rb')} AS r_biserial FROM exact_", ["works", "gold"], _SIGNED, python=True)
def h14_h15_e3_signed_ranks(spark, d):
    return significance.signed_rank_test(_loo(spark, d), "default").select("method", "n", "w_plus", "w_minus", r6("r_biserial").alias("r_biserial"))


@query(_TESTED, ["works", "gold"], _SIGNED, python=True)
def h14_f4_signed_rank_p(spark, d):
    return _tested(_loo(spark, d))


_COARSE = "floor(a.ndcg15 * 10 + 0.5) / 10 - floor(z.ndcg15 * 10 + 0.5) / 10"


@query(_TESTED, ["works", "gold"], _signed_sql(_LOO, _COARSE), python=True)
def h14_signed_rank_zeros(spark, d):
    """On results of one decimal: many differences are zero, and many are equal."""
    return _tested(_loo(spark, d).withColumn("ndcg15", fx.half_up(F.col("ndcg15"), 1)))


@query(f"SELECT a.domain_id, {s6('a.ndcg15 - z.ndcg15')} AS delta FROM loo a JOIN loo z ON z.domain_id = a.domain_id AND z.method = 'default' WHERE a.method = 'only_impact'", ["works", "gold"], _LOO)
def f5_domains_by_delta(spark, d):
    loo = _loo(spark, d)
    z = loo.where("method = 'default'").select("domain_id", F.col("ndcg15").alias("z"))
    return loo.where("method = 'only_impact'").join(z, "domain_id").select("domain_id", r6(F.col("ndcg15") - F.col("z")).alias("delta")).orderBy(F.desc("delta"), "domain_id")


@query("SELECT domain_id, place, id FROM (SELECT domain_id, id, row_number() OVER (PARTITION BY domain_id ORDER BY citation_count DESC, id) AS place FROM works) WHERE place IN (1, 3, 7)", ["works"])
def e4_select_by_index(spark, d):
    return ranking.select_by_index(b.works(spark, d), [1, 3, 7]).select("domain_id", "place", "id")


@query("SELECT domain_id, place, n FROM (SELECT domain_id, count(*) AS n FROM works GROUP BY domain_id), (SELECT CAST(unnest([0, 3, 60, 100000000]) AS INTEGER) AS place) WHERE place > n OR place < 1", ["works"])
def e4_out_of_range(spark, d):
    return ranking.out_of_range(b.works(spark, d), [0, 3, 60, 100_000_000])


# --- several queries


@query("SELECT article_id, query_pos, result_pos, query FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY query_pos, result_pos) AS n FROM hits) WHERE n = 1", ["hits"])
def g1_multi_query_dedup(spark, d):
    return ranking.first_query_wins(b.hits(spark, d))


@query("SELECT row_number() OVER (ORDER BY p) AS pos, q AS query FROM (SELECT lower(q) AS k, min(p) AS p, arg_min(q, p) AS q FROM (SELECT 0 AS p, 'brand#7' AS q UNION ALL SELECT min(p_partkey) + 1, p_brand FROM part GROUP BY p_brand) GROUP BY lower(q))")
def g3_distinct_queries(spark, d):
    q = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("query")).agg(F.min("p_partkey").alias("pos"))
    return ranking.distinct_queries(q, "brand#7").select(F.col("pos").cast("long").alias("pos"), "query")


@query("SELECT q.query, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS productive FROM (SELECT DISTINCT p_type AS query FROM part UNION SELECT 'NOTHING') q LEFT JOIN (SELECT query, count(*) AS n FROM hits GROUP BY query) USING (query)", ["hits"])
def g4_productive_queries(spark, d):
    q = b.table(spark, d, "part").select(F.col("p_type").alias("query")).distinct().union(spark.createDataFrame([("NOTHING",)], "query string"))
    return ranking.productive_queries(q, b.hits(spark, d))


@query("SELECT query_pos, n_found, n_new, CAST(sum(n_new) OVER (ORDER BY query_pos) AS BIGINT) AS unique_so_far FROM (SELECT query_pos, count(*) AS n_found, count(*) FILTER (query_pos = f) AS n_new FROM (SELECT *, min(query_pos) OVER (PARTITION BY article_id) AS f FROM hits) GROUP BY query_pos)", ["hits"])
def d20_e6_query_observations(spark, d):
    return reports.query_observations(b.hits(spark, d))


@query("SELECT query_pos, concept, n, place FROM (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY n DESC, concept) AS place FROM (SELECT query_pos, p_type AS concept, count(*) AS n FROM hits JOIN lines ON l_orderkey = article_id WHERE pos <= 4 GROUP BY 1, 2)) WHERE place <= 5", ["hits", "lines"])
def d20_top_concepts(spark, d):
    return reports.top_concepts(b.hits(spark, d), b.works(spark, d)).select("query_pos", "concept", "n", F.col("place").cast("long").alias("place"))


@query("SELECT query_pos, place, article_id, year, title, citation_count FROM (SELECT query_pos, article_id, year, substr(title, 1, 65) AS title, citation_count, row_number() OVER (PARTITION BY query_pos ORDER BY citation_count DESC, result_pos) AS place FROM hits JOIN works ON id = article_id) WHERE place <= 3", ["hits", "works"])
def d20_top_cited(spark, d):
    return reports.top_cited(b.hits(spark, d), b.works(spark, d)).withColumn("place", F.col("place").cast("long"))


# --- weights: search and prediction


@query("SELECT domain_id, best_method, " + s6("best") + " AS best, " + s6("baseline") + " AS baseline FROM (SELECT domain_id, arg_max(method, (floor(ndcg15 * 1e9 + 0.5), -n)) AS best_method, max(ndcg15) AS best, max(ndcg15) FILTER (method = 'even') AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY method) AS n FROM loo) GROUP BY domain_id)", ["works", "gold"], _loo_sql(_values([(f"one_{a}", *(weights.HIGH if j == i else 0.08 for j in range(6))) for i, a in enumerate(fx.KEYS)] + [(f"two_{fx.KEYS[i]}_{fx.KEYS[j]}", *(0.35 if m in (i, j) else 0.075 for m in range(6))) for i in range(6) for j in range(i + 1, 6)] + [("even", *[1 / 6] * 6)])))
def h1_weight_search_grid(spark, d):
    loo = weights.ndcg(scored(spark, d), weights.grid(spark), b.gold(spark, d))
    return weights.best_of(loo, "even").select("domain_id", "best_method", r6("best").alias("best"), r6("baseline").alias("baseline"))


def _spread_sql(i: str, stride: float) -> str:
    return f"({i} * {stride!r}::DOUBLE - floor({i} * {stride!r}::DOUBLE))"


def _search_sql(n: int, spread: float = 0.1) -> dict[str, str]:
    norm = lambda: ", ".join(f"floor(v_{k} / ({' + '.join(f'v_{x}' for x in fx.KEYS)}) * 1e9 + 0.5) / 1e9 AS w_{k}" for k in fx.KEYS)
    first = f"SELECT 'default' AS method, " + ", ".join(f"{float(DEFAULT_WEIGHTS[k])!r}::DOUBLE AS w_{k}" for k in fx.KEYS) + f" UNION ALL SELECT 'r0_' || lpad(CAST(i AS VARCHAR), 5, '0'), {norm()} FROM (SELECT i, " + ", ".join(f"{weights.LOW}::DOUBLE + {weights.HIGH - weights.LOW!r}::DOUBLE * {_spread_sql('i', a)} AS v_{k}" for k, a in zip(fx.KEYS, weights.STRIDES)) + f" FROM range(1, {n + 1}) t(i))"
    rest = lambda r, vec, on: {
        f"app{r}": f"SELECT s.domain_id, method, id AS article_id, {_SCORE} AS score FROM scored s JOIN {vec} w ON {on}",
        f"placed{r}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, method ORDER BY score DESC, article_id) AS rank FROM app{r}) WHERE rank <= 15",
        f"dcg{r}": f"SELECT p.domain_id, method, sum((2.0::DOUBLE ** coalesce(grade, 0) - 1) / log2(rank + 1)) AS dcg FROM placed{r} p LEFT JOIN gold g ON g.domain_id = p.domain_id AND g.article_id = p.article_id GROUP BY p.domain_id, method",
        f"loo{r}": f"SELECT d.domain_id, method, CASE WHEN coalesce(i15, 0) = 0 THEN 0.0 ELSE dcg / i15 END AS ndcg15 FROM dcg{r} d LEFT JOIN ideal_ i ON i.domain_id = d.domain_id",
    }
    moved = ", ".join(f"greatest({weights.LOW}::DOUBLE, least({weights.HIGH}::DOUBLE, w_{k} + {spread}::DOUBLE * (2 * {_spread_sql(f'(i + {n})', a)} - 1))) AS v_{k}" for k, a in zip(fx.KEYS, weights.STRIDES))
    return SCORED | {"vec0": first, "ideal_": _METRICS["ideal_"]} | rest(0, "vec0", "true") | {
        "best0": "SELECT domain_id, w.* FROM (SELECT domain_id, method, row_number() OVER (PARTITION BY domain_id ORDER BY floor(ndcg15 * 1e9 + 0.5) DESC, method) AS p FROM loo0) JOIN vec0 w USING (method) WHERE p = 1",
        "vec1": f"SELECT domain_id, 'r1_' || lpad(CAST(i AS VARCHAR), 5, '0') AS method, {norm()} FROM (SELECT domain_id, i, {moved} FROM best0, range(1, {n + 1}) t(i))",
    } | rest(1, "vec1", "w.domain_id = s.domain_id") | {
        "both_": "SELECT * FROM loo0 UNION ALL SELECT * FROM loo1",
        "pool": "SELECT d.domain_id, v.* FROM (SELECT DISTINCT domain_id FROM scored) d, vec0 v UNION ALL SELECT * FROM vec1",
        "won": "SELECT domain_id, arg_max(method, (floor(ndcg15 * 1e9 + 0.5), -n)) AS best_method, max(ndcg15) AS best, max(ndcg15) FILTER (method = 'default') AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY method) AS n FROM both_) GROUP BY domain_id",
        "gained": "SELECT *, CASE WHEN baseline = 0 THEN CASE WHEN best > 0 THEN 100.0 ELSE 0.0 END ELSE (best - baseline) / baseline * 100 END AS pct FROM won",
    }


#: Candidates of each of the two rounds: 150 tried for each domain.
_EACH = 75


@query(f"SELECT g.domain_id, best_method, {s6('best')} AS best, {s6('baseline')} AS baseline, {s6('pct')} AS improvement_pct, pct >= 1 AS saved, " + ", ".join(f"{s6(w)} AS {w}" for w in _W) + " FROM gained g JOIN pool p ON p.domain_id = g.domain_id AND p.method = g.best_method", ["works", "gold"], _search_sql(_EACH))
def h1_weight_search_sampled(spark, d):
    found = weights.search(scored(spark, d), b.gold(spark, d), DEFAULT_WEIGHTS, n=_EACH)
    return found.select("domain_id", "best_method", r6("best").alias("best"), r6("baseline").alias("baseline"), r6("improvement_pct").alias("improvement_pct"), "saved", *(r6(w).alias(w) for w in _W))


def _domains(spark, d):
    """Features and weights of the domains, through the feature store: many small steps read them again."""
    path = stores.scratch(spark, "domains")
    stores.save_features(_features(spark, d).select("domain_id", *(r6(f).alias(f) for f in FEATS)).join(b.domain_weights(spark, d), "domain_id"), path)
    return stores.load_features(spark, path)


_KNN = _STATS | {
    "dom": "SELECT domain_id, " + ", ".join(f"{s6(f)} AS {f}" for f in FEATS) + ", " + ", ".join(_W) + " FROM stats JOIN dweights USING (domain_id)",
    "lim": "SELECT a.domain_id AS fold, " + ", ".join(f"min(t.{f}) AS lo_{f}, max(t.{f}) AS hi_{f}" for f in meta.SELECTED) + " FROM dom a JOIN dom t ON t.domain_id <> a.domain_id GROUP BY a.domain_id",
    "dist": "SELECT fold, t.domain_id, floor(sqrt(" + " + ".join(f"((t.{f} - a.{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1.0 ELSE hi_{f} - lo_{f} END) ** 2" for f in meta.SELECTED) + ") * 1e12 + 0.5) / 1e12 AS distance, " + ", ".join(f"t.{w}" for w in _W) + " FROM lim JOIN dom a ON a.domain_id = fold JOIN dom t ON t.domain_id <> fold",
    "near": "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY distance, domain_id) AS place, min(distance) OVER (PARTITION BY fold) AS least FROM dist",
}
for _k in (1, 2, 3):
    _KNN[f"knn{_k}"] = f"SELECT fold, 'knn{_k}' AS method, " + ", ".join(f"sum(s * {w}) / sum(s) AS {w}" for w in _W) + f" FROM (SELECT *, CASE WHEN {_k} = 1 OR least < 1e-10 THEN (place = 1)::INT ELSE 1 / (distance + 1e-10) END AS s FROM near WHERE place <= {_k}) GROUP BY fold"
_WOUT = ", ".join(f"{s6(w)} AS {w}" for w in _W)


@query(f"SELECT fold, domain_id, {s6('distance')} AS distance, place FROM near WHERE place = 1", ["works", "gold", "dweights"], _KNN)
def h2_e5_nearest_domain(spark, d):
    return meta.distances(_domains(spark, d)).where("place = 1").select("fold", "domain_id", r6("distance").alias("distance"), F.col("place").cast("long").alias("place"))


@query(f"SELECT fold, method, {_WOUT} FROM (SELECT * FROM knn1 UNION ALL SELECT * FROM knn2 UNION ALL SELECT * FROM knn3)", ["works", "gold", "dweights"], _KNN)
def h3_knn_weights(spark, d):
    dom = _domains(spark, d)
    out = meta.knn(dom, 1).union(meta.knn(dom, 2)).union(meta.knn(dom, 3))
    return out.select("fold", "method", *(r6(w).alias(w) for w in _W))


@query(f"SELECT fold, 'transfer' AS method, {_WOUT} FROM (SELECT a.domain_id AS fold, " + ", ".join(f"avg(t.{w}) AS {w}" for w in _W) + " FROM dweights a JOIN dweights t ON t.domain_id <> a.domain_id GROUP BY a.domain_id)", ["dweights"])
def h4_transfer_direct(spark, d):
    return meta.transfer_direct(b.domain_weights(spark, d)).select("fold", "method", *(r6(w).alias(w) for w in _W))


_POS = "list_position([" + ", ".join(f"'{k}'" for k in fx.KEYS) + "], key)"
_FUSE = _KNN | {
    "mem": "SELECT * FROM knn1 UNION ALL SELECT * FROM knn2 UNION ALL SELECT * FROM knn3",
    "long_": " UNION ALL ".join(f"SELECT fold, method, '{k}' AS key, w_{k} AS w FROM mem" for k in fx.KEYS),
    "pl": f"SELECT *, row_number() OVER (PARTITION BY fold, method ORDER BY floor(w * 1e12 + 0.5) DESC, {_POS}) AS place FROM long_",
    "fused": "SELECT fold, key, sum(6 - place) AS borda, sum(1 / (1 + place)) AS rrf FROM pl GROUP BY fold, key",
}


def _fused_sql(col: str) -> str:
    return f"SELECT fold, '{col}' AS method, " + ", ".join(s6(f"max({col}) FILTER (key = '{k}') / sum({col})") + f" AS w_{k}" for k in fx.KEYS) + " FROM fused GROUP BY fold"


def _members(spark, d):
    dom = _domains(spark, d)
    return meta.knn(dom, 1).union(meta.knn(dom, 2)).union(meta.knn(dom, 3))


@query(_fused_sql("borda"), ["works", "gold", "dweights"], _FUSE)
def h11_e2_borda(spark, d):
    return meta.borda(_members(spark, d)).select("fold", "method", *(r6(w).alias(w) for w in _W))


@query(_fused_sql("rrf"), ["works", "gold", "dweights"], _FUSE)
def h12_reciprocal_rank_fusion(spark, d):
    return meta.reciprocal_rank_fusion(_members(spark, d)).select("fold", "method", *(r6(w).alias(w) for w in _W))


def _vote_sql(f: str, name: str) -> str:
    total = " + ".join(f"v_{k}" for k in fx.KEYS)
    return f"SELECT fold, '{name}' AS method, " + ", ".join(s6(f"v_{k} / ({total})") + f" AS w_{k}" for k in fx.KEYS) + " FROM (SELECT fold, " + ", ".join(f"{f}(w_{k}) AS v_{k}" for k in fx.KEYS) + " FROM mem GROUP BY fold)"


@query(_vote_sql("avg", "soft_vote"), ["works", "gold", "dweights"], _FUSE)
def h9_soft_vote(spark, d):
    return meta.soft_vote(_members(spark, d)).select("fold", "method", *(r6(w).alias(w) for w in _W))


@query(_vote_sql("median", "hard_vote"), ["works", "gold", "dweights"], _FUSE)
def h10_hard_vote(spark, d):
    return meta.hard_vote(_members(spark, d)).select("fold", "method", *(r6(w).alias(w) for w in _W))


_COLS = ", ".join(_W)


def _ridge_sql() -> dict[str, str]:
    """Ridge in closed form: the inverse of each fold's and alpha's normal equations by elimination, a feature a step; errors by leverage."""
    n = range(len(meta.SELECTED))
    cs = ", ".join(f"c_{i}" for i in n)
    out = {
        "scaled_": "SELECT fold, domain_id, domain_id = fold AS is_test, " + ", ".join(f"(t.{f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1.0 ELSE hi_{f} - lo_{f} END AS x_{i}" for i, f in enumerate(meta.SELECTED)) + f", {_COLS} FROM lim CROSS JOIN dom t",
        "cent_": "SELECT fold, is_test, " + ", ".join(f"x_{i} - avg(x_{i}) FILTER (NOT is_test) OVER (PARTITION BY fold) AS c_{i}" for i in n) + f", {_COLS} FROM scaled_",
        "inv0_": "SELECT fold, alpha, " + ", ".join(f"g_{min(i, j)}_{max(i, j)} + {'alpha' if i == j else '0'} AS a_{i}_{j}" for i in n for j in n) + " FROM (SELECT fold, " + ", ".join(f"sum(c_{i} * c_{j}) AS g_{i}_{j}" for i in n for j in n if i <= j) + f" FROM cent_ WHERE NOT is_test GROUP BY fold), (SELECT unnest([{', '.join(map(repr, meta.ALPHAS))}])::DOUBLE AS alpha)",
    }

    def step(k: int, i: int, j: int) -> str:
        if i == k:
            return f"1 / a_{k}_{k}" if j == k else f"a_{k}_{j} / a_{k}_{k}"
        return f"-a_{i}_{k} / a_{k}_{k}" if j == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k}"

    for k in n:
        out[f"inv{k + 1}_"] = "SELECT fold, alpha, " + ", ".join(f"{step(k, i, j)} AS a_{i}_{j}" for i in n for j in n) + f" FROM inv{k}_"
    last = f"inv{len(meta.SELECTED)}_"
    keys = " UNION ALL ".join(f"SELECT fold, is_test, {cs}, '{k}' AS key, w_{k} AS y FROM cent_" for k in fx.KEYS)
    fitted = " + ".join(f"c_{i} * w_{i}" for i in n)
    leverage = " + ".join(f"c_{i} * a_{i}_{j} * c_{j}" for i in n for j in n)
    return _KNN | out | {
        "long_": f"SELECT *, avg(y) FILTER (NOT is_test) OVER (PARTITION BY fold, key) AS mean FROM ({keys})",
        "coef_": "SELECT fold, key, alpha, mean, n, " + ", ".join("(" + " + ".join(f"a_{i}_{j} * r_{j}" for j in n) + f") AS w_{i}" for i in n) + " FROM (SELECT fold, key, max(mean) AS mean, count(*) AS n, " + ", ".join(f"sum(c_{i} * (y - mean)) AS r_{i}" for i in n) + f" FROM long_ WHERE NOT is_test GROUP BY fold, key) JOIN {last} USING (fold)",
        "err_": f"SELECT l.fold, l.key, c.alpha, avg(((y - l.mean - ({fitted})) / (1 - 1.0::DOUBLE / n - ({leverage}))) ** 2) AS e FROM long_ l JOIN coef_ c ON c.fold = l.fold AND c.key = l.key JOIN {last} v ON v.fold = l.fold AND v.alpha = c.alpha WHERE NOT is_test GROUP BY l.fold, l.key, c.alpha",
        "best_": "SELECT fold, key, alpha, row_number() OVER (PARTITION BY fold, key ORDER BY floor(e * 1e14), alpha) AS place FROM err_",
        "ridge_": f"SELECT fold, key, c.mean + {fitted} AS value, alpha AS chosen FROM best_ JOIN coef_ c USING (fold, key, alpha) JOIN long_ l USING (fold, key) WHERE place = 1 AND is_test",
    }


@query(f"SELECT fold, key, {s6('value')} AS value, chosen FROM ridge_", ["works", "gold", "dweights"], _ridge_sql(), python=True)
def h5_ridge(spark, d):
    """Ridge's raw predictions and alphas."""
    return meta.regressions(_domains(spark, d), methods=("ridge",)).select("fold", "key", r6("value").alias("value"), "chosen")


@query(python=True)
def h5_h6_h7_regressions(spark, d):
    return meta.regressions(_domains(spark, d))


@query("SELECT fold, alpha, " + ", ".join(s6(f"alpha * k.{w} + (1 - alpha) * t.{w}") + f" AS {w}" for w in _W) + " FROM knn1 k JOIN (SELECT a.domain_id AS fold, " + ", ".join(f"avg(t.{w}) AS {w}" for w in _W) + " FROM dweights a JOIN dweights t ON t.domain_id <> a.domain_id GROUP BY a.domain_id) t USING (fold), (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS alpha)", ["works", "gold", "dweights"], _KNN)
def h8_blend(spark, d):
    dom = _domains(spark, d)
    return meta.blend(meta.knn(dom, 1), meta.transfer_direct(dom), "blend").select("fold", "alpha", *(r6(w).alias(w) for w in _W))


_RULES = SCORED | _KNN | {
    "transfer_": "SELECT a.domain_id AS fold, 'transfer' AS method, " + ", ".join(f"avg(t.{w}) AS {w}" for w in _W) + " FROM dweights a JOIN dweights t ON t.domain_id <> a.domain_id GROUP BY a.domain_id",
    "rules": f"SELECT * FROM knn1 UNION ALL SELECT * FROM knn2 UNION ALL SELECT * FROM knn3 UNION ALL SELECT * FROM transfer_ UNION ALL SELECT domain_id, 'searched', {_COLS} FROM dweights UNION ALL SELECT domain_id, 'default', " + ", ".join(f"{float(DEFAULT_WEIGHTS[k])!r}::DOUBLE" for k in fx.KEYS) + " FROM dweights",
} | {k: v for k, v in _loo_sql(f"SELECT fold AS domain_id, method, {_COLS} FROM rules", "w.domain_id = s.domain_id").items() if k not in SCORED}


@query(f"SELECT domain_id, method, {s6('ndcg15')} AS ndcg15 FROM loo", ["works", "gold", "dweights"], _RULES)
def h13_leave_one_out_by_rules(spark, d):
    """The evaluation of those methods that no regression is fitted for."""
    dom = _domains(spark, d)
    own = dom.select(F.col("domain_id").alias("fold"), *_W)
    base = own.select("fold", F.lit("default").alias("method"), *(F.lit(float(DEFAULT_WEIGHTS[k])).alias(f"w_{k}") for k in fx.KEYS))
    rules = meta.knn(dom, 1).union(meta.knn(dom, 2)).union(meta.knn(dom, 3)).union(meta.transfer_direct(dom)).union(own.select("fold", F.lit("searched"), *_W)).union(base)
    path = stores.scratch(spark, "rules")
    stores.save_features(rules.withColumnRenamed("fold", "domain_id"), path)
    loo = weights.ndcg(scored(spark, d), stores.load_features(spark, path), b.gold(spark, d))
    return loo.select("domain_id", "method", r6("ndcg15").alias("ndcg15"))


def _regressed(spark, d):
    """The domains and the regressions' weights, stored."""
    dom, path = _domains(spark, d), stores.scratch(spark, "regressions")
    meta.regression_weights(meta.regressions(dom)).write.parquet(path)
    return dom, spark.read.parquet(path)


@query(python=True)
def h8_blend_regressions(spark, d):
    """kNN(1) with ridge and with Bayesian ridge."""
    dom, fitted = _regressed(spark, d)
    near = meta.knn(dom, 1)
    both = [meta.blend(near, fitted.where(F.col("method") == m), f"blend_{m}") for m in ("ridge", "bayes")]
    return both[0].union(both[1]).select("fold", "method", "alpha", *(r6(w).alias(w) for w in _W))


@query(python=True)
def h9_h10_votes_with_bayes(spark, d):
    """Mean and median of the four members."""
    dom, fitted = _regressed(spark, d)
    members = meta.knn(dom, 1).union(meta.knn(dom, 2)).union(meta.knn(dom, 3)).union(fitted.where("method = 'bayes'"))
    return meta.soft_vote(members).union(meta.hard_vote(members)).select("fold", "method", *(r6(w).alias(w) for w in _W))


def _loo_store(spark, d, methods: str | None = None) -> str:
    """Leave-one-out results in the store: all of them, or those whose method meets a condition. Some folds are saved first and replaced."""
    predicted, path = stores.scratch(spark, "predicted"), stores.scratch(spark, "loo")
    stores.save_features(meta.leave_one_out(_domains(spark, d), DEFAULT_WEIGHTS), predicted)
    v = stores.load_features(spark, predicted)
    v = v.where(methods) if methods else v
    vectors = v.select(F.col("fold").alias("domain_id"), "method", *_W)
    loo = weights.ndcg(scored(spark, d), vectors, b.gold(spark, d))
    early = v.select(F.col("fold").alias("domain_id"), "method", F.lit(-1.0).alias("ndcg15"), "alpha").where("domain_id in ('NATION_2', 'NATION_5')")
    stores.save_results(early, path)
    stores.save_results(loo.join(v.select("method", "alpha").distinct(), "method", "left"), path)
    return path


@query(python=True)
def h13_a11_leave_one_out(spark, d):
    return stores.load_results(spark, _loo_store(spark, d))


_BLENDS = ("blend_ridge", "blend_bayes")


@query(python=True)
def d38_a11_blend_sweep(spark, d):
    """Both blends' alphas against transfer, from the store; only their partitions are read."""
    path = _loo_store(spark, d, "method like 'blend%' or method = 'transfer'")
    wanted = ["transfer", *(f"{blend}_{x:.1f}" for blend in _BLENDS for x in meta.BLEND)]
    return metrics.blend_sweep(stores.load_results(spark, path, wanted), _BLENDS)


# --- operations and reports


@query("SELECT coalesce(agent_name, 'TOTAL') AS agent_name, count(*) AS runs, CAST(sum(coalesce(date_diff('second', started_at, started_at) + CASE WHEN completed_at IS NULL THEN 0 ELSE CAST(epoch(completed_at - started_at) AS BIGINT) END, 0)) AS BIGINT) AS seconds, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(api_calls) AS BIGINT) AS calls, count(error) AS errors FROM logs GROUP BY ROLLUP (agent_name)", ["logs"])
def d15_run_log(spark, d):
    return reports.run_log(b.agent_logs(spark, d))


@query("SELECT (SELECT count(*) FROM hits) AS fetched, (SELECT count(*) FROM works WHERE year >= 2000) AS selected, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(api_calls) AS BIGINT) AS calls, count(*) FILTER (agent_name = 'click') AS iterations, floor(sum(coalesce(cost_usd, 0)) * 1e6 + 0.5) / 1e6 AS cost_usd, CAST(floor(epoch(max(completed_at) - min(started_at))) AS BIGINT) AS elapsed_s FROM logs", ["logs", "hits", "works"])
def d16_run_stats(spark, d):
    return reports.run_stats(b.agent_logs(spark, d), b.hits(spark, d), b.works(spark, d).where("year >= 2000"), critic="click")


@query(f"SELECT count(*) AS works, count(*) FILTER (id % 2 = 0) AS with_doi, count(*) FILTER (id % 3 = 0) AS open_access, count(*) FILTER (is_preprint) AS preprints, {s6('avg(citation_count)')} AS mean_citations FROM works", ["works"])
def d17_corpus_stats(spark, d):
    w = b.works(spark, d).withColumns({"doi": F.when(F.col("id") % 2 == 0, "x"), "open_access": F.col("id") % 3 == 0})
    return reports.corpus_stats(w).withColumn("mean_citations", r6("mean_citations"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS score, min({k}_score) AS least, {s6(f'avg({k}_score)')} AS mean, max({k}_score) AS greatest FROM ranked WHERE rank <= 15" for k in fx.KEYS), ["works"], RANKED)
def d18_score_diagnostics(spark, d):
    return reports.score_diagnostics(ranked(spark, d).where("rank <= 15"), fx.KEYS).withColumn("mean", r6("mean"))


@query(f"SELECT count(h_index) AS n, {s6('avg(h_index)')} AS mean_h, CAST(max(h_index) AS INTEGER) AS max_h, {s6('count(*) FILTER (h_index = 0) / count(h_index)')} AS share_zero, {s6('count(*) FILTER (h_index >= 20) / count(h_index)')} AS share_high FROM metrics", ["metrics"])
def d19_h_index_summary(spark, d):
    s = reports.h_index_summary(b.author_metrics(spark, d))
    return s.withColumns({c: r6(c) for c in ("mean_h", "share_zero", "share_high")})


@query(f"SELECT count(*) AS runs, {s6('avg(p)')} AS mean_improvement_pct, count(*) FILTER (p > 0.5) AS runs_improved FROM (SELECT (user_id % 20 - 10) / 4.0 AS p FROM events GROUP BY user_id)")
def d21_experiment_totals(spark, d):
    e = b.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("improvement_pct", (F.col("user_id") % 20 - 10) / F.lit(4.0))
    return reports.experiment_totals(e).withColumn("mean_improvement_pct", r6("mean_improvement_pct"))


_D22 = {"composite": "value", "rouge1": "value / 2", "rouge2": "value / 3", "rouge_l": "value / 4", "faithfulness": "CASE WHEN event_id % 4 > 0 THEN value / 5 END", "coverage": "event_id % 7"}


@query("SELECT event_type AS prompt_id, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, " + ", ".join(s6(f"avg(CASE WHEN event_id % 9 = 0 THEN 0 ELSE coalesce({e}, 0) END)") + f" AS {m}" for m, e in _D22.items()) + ", count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS errors FROM events GROUP BY ALL")
def d22_mean_by_prompt(spark, d):
    r = b.table(spark, d, "events").selectExpr("event_type AS prompt_id", "CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split", "CASE WHEN event_id % 9 = 0 THEN 'failed' END AS error", *(f"{e} AS {m}" for m, e in _D22.items()))
    means = generation.mean_by_prompt(r)
    return means.withColumns({m: r6(m) for m in _D22})


def _echo(prompts: list[str]) -> list[tuple[str | None, int, int, str | None]]:
    """A stand-in for a model: the first words of the prompt's last line; it fails on prompts of odd length in fives."""
    if any(len(p) % 5 == 1 for p in prompts):
        raise ValueError("odd prompt")
    return [(" ".join(p.split("\n")[-1].split()[:20]), len(p), 20, None) for p in prompts]


@query("SELECT id, CASE WHEN length('Summarise:' || chr(10) || generated) % 5 = 1 THEN 0 ELSE length('Summarise:' || chr(10) || generated) END AS input_tokens, length('Summarise:' || chr(10) || generated) % 5 = 1 AS failed FROM pairs", ["pairs"], python=True)
def j1_batch_completion(spark, d):
    rows = generation.render(b.pairs(spark, d).withColumn("title", F.lit("")), "Summarise:\n{abstract}", abstract="generated")
    return generation.complete(rows, _echo).select("id", "input_tokens", F.col("error").isNotNull().alias("failed"))


_START = ("start", "Summarise:\n{abstract}")
_TRIED = {1: [("short", "Short:\n{abstract}"), ("after", "Read this text. {abstract}")], 2: [("ended", "{abstract}\nEnd of text"), ("plain", "{abstract}")]}


def _search_steps_sql() -> dict[str, str]:
    """Every prompt on every example; which of them counts in which iteration comes after."""
    prompts = [(0, 0, *_START)] + [(i, k, *p) for i, tried in _TRIED.items() for k, p in enumerate(tried)]
    text = lambda t: " || ".join(x for x in ("replace('" + t.replace("\n", "' || chr(10) || '") + "', '{abstract}', generated)",))
    tall = " UNION ALL ".join(f"SELECT {i} AS iteration, {k} AS place, '{name}' AS prompt_id, id AS example, CASE WHEN id % 3 = 0 THEN 'train' ELSE 'validation' END AS split, {text(t)} AS prompt, reference AS ref FROM pairs" for i, k, name, t in prompts)
    first = "array_to_string(list_filter(regexp_split_to_array(list_extract(string_split(prompt, chr(10)), -1), '\\s+'), lambda x: x <> '')[1:20], ' ')"
    measures = ("composite", "rouge1", "rouge2", "rouge_l", "faithfulness", "coverage")
    renamed = lambda parts: {k: v.replace("FROM pairs", "FROM answers_") for k, v in parts.items()}
    return {
        "tall_": tall,
        "answers_": f"SELECT *, prompt_id || '/' || example AS id, length(prompt) % 5 = 1 AS failed, CASE WHEN length(prompt) % 5 <> 1 THEN {first} END AS generated, ref AS reference FROM tall_",
        **renamed(_ROUGE),
        "lcs_": _LCS["lcs_"],
        "one_f": f"SELECT one.id, {_F1} AS v FROM one LEFT JOIN c1 USING (id)",
        "two_f": f"SELECT two.id, {_F1} AS v FROM two LEFT JOIN c2 USING (id)",
        "measured_": "SELECT a.*, coalesce(o.v, 0) AS rouge1, coalesce(t.v, 0) AS rouge2, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE floor(2.0::DOUBLE * n / (len(g) + len(r)) * 1e4 + 0.5) / 1e4 END AS rouge_l, CASE WHEN example % 4 = 0 THEN 0.5 ELSE example % 10 / 10.0 END::DOUBLE AS faithfulness, CASE WHEN example % 4 = 0 THEN 0.5 ELSE example % 7 / 7.0 END::DOUBLE AS coverage FROM answers_ a LEFT JOIN one_f o USING (id) LEFT JOIN two_f t USING (id) LEFT JOIN toks_ k USING (id) LEFT JOIN lcs_ l USING (id)",
        "composed_": "SELECT *, CASE WHEN failed THEN 0 ELSE floor((0.4 * ((rouge1 + rouge2 + rouge_l) / 3) + 0.4 * faithfulness + 0.2 * coverage) * 1e4 + 0.5) / 1e4 END AS composite FROM measured_",
        "means_": "SELECT iteration, place, prompt_id, split, count(*) AS n, count(*) FILTER (failed) AS errors, " + ", ".join(f"avg(CASE WHEN failed THEN 0 ELSE {m} END) AS {m}" for m in measures) + " FROM composed_ GROUP BY ALL",
        "valid_": "SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY floor(composite * 1e9 + 0.5) DESC, place) AS f, max(floor(composite * 1e9 + 0.5)) OVER (ORDER BY iteration RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM means_ WHERE split = 'validation'",
        "bests_": "SELECT iteration, place, prompt_id, f = 1 AND (before IS NULL OR floor(composite * 1e9 + 0.5) > before) AS is_best FROM valid_",
        "trained_": "SELECT i.iteration, arg_max(v.prompt_id, v.iteration) AS prompt_id FROM (SELECT unnest([1, 2]) AS iteration) i JOIN bests_ v ON v.iteration < i.iteration AND v.is_best GROUP BY i.iteration",
        "worst_": "SELECT t.iteration, string_agg(example::VARCHAR, ',' ORDER BY k) AS worst FROM trained_ t JOIN (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY composite, example::VARCHAR) AS k FROM composed_ WHERE split = 'train') c USING (prompt_id) WHERE k <= 5 GROUP BY t.iteration",
    }


_HISTORY = "prompt_id, split, n, errors, " + ", ".join(f"{s6(m)} AS {m}" for m in generation.MEASURES)


@query(f"SELECT iteration, {_HISTORY}, is_best, NULL AS worst FROM means_ JOIN bests_ USING (iteration, place, prompt_id) WHERE split = 'validation' UNION ALL SELECT t.iteration, {_HISTORY}, false, worst FROM trained_ t JOIN (SELECT * EXCLUDE (iteration) FROM means_ WHERE split = 'train') m USING (prompt_id) JOIN worst_ w USING (iteration)", ["pairs"], _search_steps_sql(), python=True)
def j2_prompt_selection(spark, d):
    """The history of a search, interrupted after its first iteration and gone on with."""
    i = F.col("id")
    examples = b.pairs(spark, d).select(i.cast("string").alias("example_id"), F.when(i % 3 == 0, "train").otherwise("validation").alias("split"), F.col("generated").alias("article_text"), "reference")
    judged = b.pairs(spark, d).where(i % 4 != 0).select(i.cast("string").alias("example_id"), (i % 10 / F.lit(10.0)).alias("faithfulness"), (i % 7 / F.lit(7.0)).alias("coverage"))
    search = lambda: generation.PromptSearch(examples, _echo, path, lambda r: gx.attach_judge(r, judged, ["example_id"]))
    path = stores.scratch(spark, "prompt-search")
    search().run(_START, lambda k, best, bad: _TRIED[k], 1)
    search().run(_START, lambda k, best, bad: _TRIED[k], 2)
    h = search().history()
    return h.select(F.col("iteration").cast("int").alias("iteration"), "prompt_id", "split", "n", "errors", *(r6(m).alias(m) for m in generation.MEASURES), "is_best", "worst")
