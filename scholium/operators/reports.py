"""Rollups and report tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_all


def run_log(logs: DataFrame) -> DataFrame:
    """Per agent and in total: runs, seconds (unfinished count 0), tokens, calls, errors."""
    seconds = F.coalesce(F.timestamp_diff("SECOND", "started_at", "completed_at"), F.lit(0))
    out = logs.withColumn("s", seconds).rollup("agent_name").agg(F.count("*").alias("runs"), F.sum("s").alias("seconds"), F.sum("tokens_used").alias("tokens"), F.sum("api_calls").alias("calls"), F.count("error").alias("errors"))
    return out.withColumn("agent_name", F.coalesce("agent_name", F.lit("TOTAL")))


def run_stats(logs: DataFrame, n_fetched: DataFrame, n_selected: DataFrame, critic: str = "critic") -> DataFrame:
    """One row: fetched, selected, iterations (runs of the critic), tokens, calls, cost and elapsed seconds of a run."""
    cost = F.floor(F.sum(F.coalesce("cost_usd", F.lit(0.0))) * 1e6 + 0.5) / 1e6
    own = logs.agg(F.count_if(F.col("agent_name") == critic).alias("iterations"), F.sum("tokens_used").alias("tokens"), F.sum("api_calls").alias("calls"), cost.alias("cost_usd"), F.timestamp_diff("SECOND", F.min("started_at"), F.max("completed_at")).alias("elapsed_s"))
    return own.crossJoin(n_fetched.agg(F.count("*").alias("fetched"))).crossJoin(n_selected.agg(F.count("*").alias("selected")))  # three single rows


def corpus_stats(works: DataFrame) -> DataFrame:
    return works.agg(F.count("*").alias("works"), F.count_if(F.col("doi").isNotNull()).alias("with_doi"), F.count_if("open_access").alias("open_access"), F.count_if("is_preprint").alias("preprints"), F.avg("citation_count").alias("mean_citations"))


def score_diagnostics(scored: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Least, mean and greatest of each sub-score."""
    long = scored.unpivot([], [F.col(f"{n}_score").alias(n) for n in names], "score", "v")
    return long.groupBy("score").agg(F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("greatest"))


def h_index_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("h_index").alias("n"), F.avg("h_index").alias("mean_h"), F.max("h_index").alias("max_h"), (F.count_if(F.col("h_index") == 0) / F.count("h_index")).alias("share_zero"), (F.count_if(F.col("h_index") >= 20) / F.count("h_index")).alias("share_high"))


def query_observations(hits: DataFrame) -> DataFrame:
    """Per query: results, works no earlier query had, and distinct works so far."""
    first = hits.groupBy("article_id").agg(F.min("query_pos").alias("query_pos")).groupBy("query_pos").agg(F.count("*").alias("n_new"))
    n = hits.groupBy("query_pos").agg(F.count("*").alias("n_found"))
    both = n.join(first, "query_pos", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return both.withColumn("unique_so_far", F.sum("n_new").over(Window.orderBy("query_pos").rowsBetween(Window.unboundedPreceding, 0)))  # one row a query


def top_concepts(hits: DataFrame, works: DataFrame, first: int = 4, k: int = 5) -> DataFrame:
    """Per query: the k commonest of its works' first concepts."""
    c = hits.join(works.select(F.col("id").alias("article_id"), "concepts"), "article_id").select("query_pos", F.explode(F.slice("concepts", 1, first)).alias("concept"))
    n = c.groupBy("query_pos", "concept").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("query_pos").orderBy(F.desc("n"), "concept"))).where(F.col("place") <= k)


def top_cited(hits: DataFrame, works: DataFrame, k: int = 3, longest: int = 65) -> DataFrame:
    """Per query: its k most cited works, with the beginnings of their titles."""
    found = hits.join(works.select(F.col("id").alias("article_id"), "year", "title", "citation_count"), "article_id")
    place = F.row_number().over(Window.partitionBy("query_pos").orderBy(F.desc("citation_count"), "result_pos"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_pos", "place", "article_id", "year", F.substring("title", 1, longest).alias("title"), "citation_count")


def experiment_totals(experiments: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: runs, their mean improvement, and how many improved by more than ``least`` percent."""
    return experiments.agg(F.count("*").alias("runs"), F.avg("improvement_pct").alias("mean_improvement_pct"), F.count_if(F.col("improvement_pct") > least).alias("runs_improved"))


def cover(logs: DataFrame, fetched: DataFrame, selected: DataFrame, summaries: DataFrame, feedback: DataFrame) -> DataFrame:
    """A report's first page as (item, value): counts of works, summaries, iterations and critiques, the last quality, tokens."""
    count = lambda df, name: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("item"), "value")
    last = feedback.agg(F.upper(F.max_by("quality", F.struct("iteration", "id"))).alias("value")).select(F.lit("final quality").alias("item"), F.coalesce("value", F.lit("N/A")).alias("value"))
    rounds = feedback.agg(F.coalesce(F.max("iteration"), F.lit(1)).cast("string").alias("value")).select(F.lit("iterations").alias("item"), "value")
    tokens = logs.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("string").alias("value")).select(F.lit("tokens").alias("item"), "value")
    parts = [count(fetched, "works fetched"), count(selected, "works selected"), count(summaries, "summaries"), rounds, count(feedback, "critiques"), last, tokens]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def feedback_table(feedback: DataFrame) -> DataFrame:
    """Critiques (id, iteration, quality, needs_revision, issues, suggestions) for display; without both lists, a note."""
    n = F.coalesce(F.size("issues"), F.lit(0)) + F.coalesce(F.size("suggestions"), F.lit(0))
    verdict = F.when(F.col("needs_revision"), "REVISION REQUESTED").otherwise("APPROVED")
    return feedback.select("id", "iteration", F.upper("quality").alias("quality"), verdict.alias("verdict"), F.array_join(F.coalesce("issues", F.array().cast("array<string>")), "; ").alias("issues"), F.array_join(F.coalesce("suggestions", F.array().cast("array<string>")), "; ").alias("suggestions"), F.when(n <= 0, "No issues identified").alias("note"))


def experiment_summary(experiments: DataFrame) -> DataFrame:
    """Experiments by final composite, with the deltas of composite, faithfulness and coverage, and minutes.

    Places are counted by stripes of the composite, so that runs aren't sorted in one task.
    """
    placed = rank_all(experiments.withColumn("__all", F.lit(1)), F.col("final_composite"), "__all", "run_name", "place", steps=1_000)
    delta = lambda m: (F.col(f"final_{m}") - F.col(f"baseline_{m}")).alias("delta" if m == "composite" else f"delta_{m}")
    return placed.select("run_name", "place", *(delta(m) for m in ("composite", "faithfulness", "coverage")), "improvement_pct", (F.col("improvement_pct") > 0.5).alias("improved"), (F.col("duration_seconds") / 60).alias("minutes"))


#: Shown for what is absent.
ABSENT = "—"


def _short(text: Column, longest: int, mark: str) -> Column:
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, longest), F.lit(mark)))


def ranked_articles(ranked: DataFrame, longest: int = 78, venue_longest: int = 42) -> DataFrame:
    """Ranked works for display: short titles, the venue with (pp) for preprints, and the score to two places."""
    venue = F.concat(F.substring(F.when(F.coalesce("journal_name", F.lit("")) == "", ABSENT).otherwise(F.col("journal_name")), 1, venue_longest), F.when(F.coalesce("is_preprint", F.lit(False)), " (pp)").otherwise(""))
    return ranked.select("domain_id", "rank", "id", _short(F.col("title"), longest, "…").alias("title"), venue.alias("venue"), "year", "citation_count", _two(F.col("final_score")).alias("final_score"))


def _two(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def score_breakdown(ranked: DataFrame, longest: int = 42) -> DataFrame:
    """The scores for venue, authors, impact and relevance behind each ranked work's final score, to two places."""
    parts = [_two(F.col(f"{k}_score")).alias(k) for k in ("venue", "authors", "impact", "relevance")]
    return ranked.select("domain_id", "rank", "id", _short(F.col("title"), longest, "...").alias("title"), *parts, _two(F.col("final_score")).alias("final"))


def trend_table(trends: DataFrame, shown: int = 3) -> DataFrame:
    """Trends (trend_id, name, maturity, description, evidence) for display: maturity in capitals, the first ids of evidence joined."""
    few = F.array_join(F.slice("evidence", 1, shown), ", ")
    return trends.select("trend_id", "name", F.upper("maturity").alias("maturity"), "description", F.when(F.coalesce(few, F.lit("")) == "", ABSENT).otherwise(few).alias("evidence"))


def digest(problem: Column, method: Column, results: Column, narrative: Column, least: int = 20) -> Column:
    """A few sentences on a work: problem, method and the first sentence of the results where they are specified, or the first two long
    sentences of a narrative; sentences of ``least`` characters or fewer don't count. Null where nothing is left."""
    said = lambda c: F.when(~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "not specified"), c)
    first = F.trim(F.get(F.split(said(results), r"\."), F.lit(0)))
    structured = F.array(said(problem), said(method), F.when(F.length(first) > least, F.concat(first, F.lit("."))))
    sentences = F.filter(F.transform(F.split(narrative, r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    prose = F.transform(F.slice(sentences, 1, 2), lambda x: F.concat(x, F.lit(".")))
    text = F.array_join(F.when(narrative.isNotNull(), prose).otherwise(F.filter(structured, lambda x: x.isNotNull())), "  ")
    return F.when(text != "", text)


def emerging_trends(trends: DataFrame, articles: DataFrame, summaries: DataFrame, most: int = 4) -> DataFrame:
    """(trend_id, name, pos, article_id, heading, digest): the first evidence of emerging trends that has an article or a summary.

    ``summaries`` has (article_id, problem, method, results, narrative), narrative null for structured ones. An emerging trend
    without any such evidence has one row with null pos.
    """
    rising = trends.where("maturity = 'emerging'")
    each = rising.select("trend_id", F.posexplode(F.slice("evidence", 1, most)).alias("pos", "article_id"))
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("__title"), "year")
    s = summaries.select("article_id", "problem", "method", "results", "narrative", F.lit(True).alias("__summary"))
    found = each.join(a, "article_id", "left").join(s, "article_id", "left").where("__title is not null or __summary")
    heading = F.coalesce(F.concat(F.col("__title"), F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.col("__title"), F.col("article_id").cast("string"))
    shown = found.select("trend_id", "pos", "article_id", heading.alias("heading"), digest(*(F.col(c) for c in ("problem", "method", "results", "narrative"))).alias("digest"))
    return rising.select("trend_id", "name").join(shown, "trend_id", "left")
