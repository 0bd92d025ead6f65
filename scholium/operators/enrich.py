"""Joining author metrics, venue quartiles and trend evidence to works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_issn


def enrich_h_index(works: DataFrame, metrics: DataFrame, author_id: str = "author_id") -> DataFrame:
    """works with authors' null h_index filled from metrics (author id, h_index), order kept, and n_enriched.

    One row of metrics an author; authors without one stay null.
    """
    each = works.select("id", F.posexplode("authors").alias("pos", "a"))
    known = metrics.select(F.col(author_id).alias("__author"), F.col("h_index").alias("__h"))
    joined = each.join(known, each["a"][author_id] == F.col("__author"), "left")
    filled = F.col("a").withField("h_index", F.coalesce(F.col("a.h_index"), F.col("__h").cast("int")))
    new = F.col("a.h_index").isNull() & F.col("__h").isNotNull()
    again = joined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", filled.alias("a")))).alias("l"), F.count_if(new).alias("n_enriched"))
    again = again.select("id", F.transform("l", lambda x: x["a"]).alias("__authors"), "n_enriched")
    return works.join(again, "id", "left").withColumns({"authors": F.coalesce("__authors", "authors"), "n_enriched": F.coalesce("n_enriched", F.lit(0)).cast("long")}).drop("__authors")


def author_domains(works: DataFrame, author_id: str = "author_id") -> DataFrame:
    """Each known author and the domains their works are in."""
    ids = works.select("domain_id", F.explode(F.transform("authors", lambda a: a[author_id])).alias("author_id")).where("author_id is not null")
    return ids.groupBy("author_id").agg(F.collect_set("domain_id").alias("domains"), F.countDistinct("domain_id").alias("n_domains"))


def unknown_ids(wanted: DataFrame, known: DataFrame, key: str = "author_id") -> DataFrame:
    return wanted.join(known, key, "left_anti")


def with_quartile(works: DataFrame, issn_table: DataFrame) -> DataFrame:
    """A work's own quartile, else that of its normalised ISSN. Catalyst broadcasts the table while it is small."""
    q = issn_table.select(F.col("issn").alias("__issn"), F.col("quartile").alias("__quartile"))
    return works.join(q, normalise_issn(F.col("journal_issn")) == F.col("__issn"), "left").withColumn("quartile", F.coalesce("quartile", "__quartile")).drop("__issn", "__quartile")


def trend_evidence(trends: DataFrame, articles: DataFrame, summaries: DataFrame, most: int = 4) -> DataFrame:
    """(trend_id, pos, article_id, title, summary): the first evidence of each trend that has an article or a summary."""
    each = trends.select("trend_id", F.posexplode(F.slice("evidence", 1, most)).alias("pos", "article_id"))
    a, s = articles.select(F.col("id").alias("article_id"), "title"), summaries.select("article_id", "summary")
    return each.join(a, "article_id", "left").join(s, "article_id", "left").where("title is not null or summary is not null")
