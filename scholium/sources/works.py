"""Landed work records: pages of nested JSON to article rows; reference tables; bad rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_issn

WORK = (
    "id string, doi string, title string, publication_year int, cited_by_count long, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string,issn_l:string,type:string>>, "
    "open_access struct<is_oa:boolean>, concepts array<struct<display_name:string>>"
)
PAGE = f"meta struct<count:long,page:int>, results array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in WORK.split(', '))}>>, _corrupt_record string"
MOST_CONCEPTS = 5


#: Results on a page at most; a page with fewer is its topic's last one.
PER_PAGE = 100


def scan_pages(spark: SparkSession, path: str, n_results: int | None = None, per_page: int = PER_PAGE) -> tuple[DataFrame, DataFrame]:
    """(works, rejects): the records of all pages under a path, and what isn't a page or lacks id or title, with its file and block.

    With n_results, ``path`` has a folder topic=<topic> for each topic, and first_results() decides which records are taken, before
    those without id or title are set aside; works then have topic and result_pos.
    """
    parsed = F.from_json("value", PAGE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    raw = spark.read.text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    own = ["topic"] if "topic" in raw.columns else []
    pages = raw.select(F.explode(F.array(parsed)).alias("p"), "value", *own, *at)  # exploded, so that conditions on p don't parse a page again
    broken = pages.where("p._corrupt_record is not null").select(F.col("value").alias("record"), F.lit("not JSON").alias("reason"), "file", "block")
    whole = pages.where("p._corrupt_record is null")
    if n_results is None:
        works = whole.select(F.explode("p.results").alias("w"), *own, "file", "block").select("w.*", *own, "file", "block")
    else:
        numbered = whole.select("topic", F.col("p.meta.page").alias("page"), F.coalesce("p.results", F.array().cast(whole.schema["p"].dataType["results"].dataType)).alias("results"), "file", "block")
        works = first_results(numbered, n_results, per_page).select("w.*", "topic", "result_pos", "file", "block")
    fine = F.col("id").isNotNull() & F.col("title").isNotNull()
    partial = works.where(~fine).select(F.to_json(F.struct(*(c for c in works.columns if c not in ("file", "block")))).alias("record"), F.lit("missing id or title").alias("reason"), "file", "block")
    return works.where(fine).drop("file", "block"), broken.union(partial)


def first_results(pages: DataFrame, n_results: int, per_page: int = PER_PAGE) -> DataFrame:
    """Each topic's first n_results records w with their result_pos from 1, page after page up to the first page that isn't full.

    ``pages`` has (topic, page, results) and further columns, which are kept. A page asks for min(n_results, per_page) records. Pages before the
    first short one are full, so a page's place among its topic's pages says how many records precede it: only numbers of short
    pages are aggregated, and only the first pages of a topic are ranked. A page of more records than asked for counts as full and is cut.
    """
    full = max(1, min(n_results, per_page))
    sized = pages.withColumn("__n", F.least(F.size("results"), F.lit(full)))
    last = sized.where(F.col("__n") < full).groupBy("topic").agg(F.min("page").alias("__last"))
    heard = sized.join(last, "topic", "left").where(F.col("__last").isNull() | (F.col("page") <= F.col("__last")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy("page"))
    taken = heard.withColumn("__place", place).where(F.col("__place") <= -(-n_results // full))
    before = (F.col("__place") - 1) * full
    cut = F.slice("results", F.lit(1), F.greatest(F.lit(0), F.least(F.col("__n"), n_results - before)))
    rows = taken.select(*(c for c in pages.columns if c != "results"), before.alias("__before"), F.posexplode(cut).alias("__i", "w"))
    return rows.withColumn("result_pos", F.col("__before") + F.col("__i") + 1).drop("__before", "__i")


def invert_abstract(words: Column) -> Column:
    """An inverted index of a list of words: a map of each word to its positions; null for a null or empty list.

    Places are sorted by word and cut where the word changes, so a row takes time as sorting does, whatever the number of its words.
    """
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        entries = lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s))), lambda lo, hi: F.struct(F.get(s, lo)["w"].alias("w"), F.slice(s, lo + 1, hi - lo)["p"].alias("p")))
        return F.get(F.transform(F.array(starts), lambda b: F.map_from_entries(entries(b))), F.lit(0))

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(placed), cut), F.lit(0)))  # arrays of one: each is evaluated once a row


def rebuild_abstract(index: Column) -> Column:
    """The words of an inverted index at their positions; null for a null or empty one."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " "))


def _tail(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def to_articles(works: DataFrame) -> DataFrame:
    """One article for each work. An absent year stays null; absent citations are 0."""
    source = F.col("primary_location.source")
    return works.select(
        F.concat(F.lit("openalex_"), _tail(F.col("id"))).alias("id"),
        F.regexp_replace("doi", "^https?://(dx\\.)?doi\\.org/", "").alias("doi"),
        "title",
        rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform(
            "authorships",
            lambda a: F.struct(
                a["author"]["display_name"].alias("name"),
                F.lit(None).cast("int").alias("h_index"),
                F.get(a["institutions"], F.lit(0))["display_name"].alias("affiliation"),
                a["author"]["orcid"].alias("orcid"),
                _tail(a["author"]["id"]).alias("openalex_id"),
            ),
        ).alias("authors"),
        F.col("publication_year").alias("year"),
        source["display_name"].alias("journal_name"),
        source["issn_l"].alias("journal_issn"),
        F.coalesce(source["type"] == "repository", F.lit(False)).alias("is_preprint"),
        F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("citation_count"),
        F.coalesce("primary_location.landing_page_url", "id").alias("url"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("open_access"),
        F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, MOST_CONCEPTS).alias("concepts"),
    )


def issn_quartiles(table: DataFrame, issn: str = "Issn", quartile: str = "SJR Best Quartile", position: str | None = None) -> DataFrame:
    """(issn, quartile) from a journal table with several ISSNs a row; of repeated ISSNs the later row wins.

    ``position`` names the column that orders rows; without one, rows count in the order they are read.
    """
    at = F.col(f"`{position}`") if position else F.monotonically_increasing_id()
    rows = table.select(F.col(f"`{issn}`").alias("i"), F.col(f"`{quartile}`").alias("q"), at.alias("at")).where(F.col("q").isin("Q1", "Q2", "Q3", "Q4"))
    each = rows.select(F.explode(F.split("i", ",")).alias("i"), "q", "at").select(normalise_issn(F.trim("i")).alias("issn"), "q", "at").where("issn <> ''")
    return each.groupBy("issn").agg(F.max_by("q", "at").alias("quartile"))


def read_issn_csv(spark: SparkSession, path: str) -> DataFrame:
    """The journal table from its semicolon CSV; a byte-order mark before the first name is dropped."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    return issn_quartiles(raw.toDF(*(c.lstrip("﻿") for c in raw.columns)))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(domain_id, article_id, grade) from JSON files with a domain and a map of grades."""
    docs = spark.read.schema("domain_id string, relevance map<string,int>").option("multiLine", True).json(path)
    return docs.select("domain_id", F.explode("relevance").alias("article_id", "grade"))


#: An article of a gold corpus.
GOLD_ARTICLE = "id string, title string, abstract string, year int, citation_count long, journal_name string, is_preprint boolean"


def read_gold_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, gold, missing) of a corpus with folders articles/domain_id=<domain> and relevance/domain_id=<domain>.

    Article files hold JSON arrays of articles, one or several to a domain and one to a line; relevance files hold a JSON object of grades by article id
    to a line. articles has (domain_id, GOLD_ARTICLE), gold (domain_id, article_id, grade); missing names domains of which
    either half isn't there, with what is missing; they stay out of the other two.
    """
    articles = spark.read.schema(f"{GOLD_ARTICLE}, domain_id string").json(f"{path}/articles").where(F.col("id").isNotNull())
    maps = spark.read.schema("value string, domain_id string").text(f"{path}/relevance")
    gold = maps.select("domain_id", F.explode(F.from_json("value", "map<string,int>")).alias("article_id", "grade"))
    have, judged = articles.select("domain_id").distinct(), gold.select("domain_id").distinct()
    missing = have.join(judged, "domain_id", "left_anti").withColumn("missing", F.lit("relevance")).union(judged.join(have, "domain_id", "left_anti").withColumn("missing", F.lit("articles")))
    return articles.join(judged, "domain_id", "left_semi"), gold.join(have, "domain_id", "left_semi"), missing


def read_domain_config(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """(domain_id, topic) of the domains listed in JSON files {"domains": [{"id", "topic"}]}, without those to exclude; of repeated ids the smallest topic."""
    files = spark.read.schema("domains array<struct<id:string,topic:string>>").option("multiLine", True).json(path)
    rows = files.select(F.explode("domains").alias("x")).where("x.id is not null").groupBy(F.col("x.id").alias("domain_id")).agg(F.min("x.topic").alias("topic"))
    return exclude_domains(rows, exclude or [])


def exclude_domains(config: DataFrame, weak: list[str]) -> DataFrame:
    return config.where(~F.col("domain_id").isin(weak)) if weak else config


def search(hits: DataFrame, first_year: int | None = None, last_year: int | None = None, with_abstract: bool = False, per_query: int | None = None, query: str = "query", rank: str = "result_pos") -> DataFrame:
    """Rows that meet the predicates (on raw columns, so that scans can use them), at most per_query by rank for each query."""
    if first_year is not None:
        hits = hits.where(F.col("year") >= first_year)
    if last_year is not None:
        hits = hits.where(F.col("year") <= last_year)
    if with_abstract:
        hits = hits.where(F.col("abstract").isNotNull())
    if per_query is not None:
        n = F.row_number().over(Window.partitionBy(query).orderBy(rank))
        hits = hits.withColumn("__n", n).where(F.col("__n") <= per_query).drop("__n")
    return hits


def text_pairs(rows: DataFrame, article: str, abstract: str, key: str, prefix: str, longest: int, n: int | None = None, seed: int = 42) -> DataFrame:
    """(example_id, article_text, reference): blank rows dropped first, then a seeded sample of n, then texts cut.

    The sample orders rows by a hash of key and seed, so it doesn't depend on partitions.
    """
    full = rows.where((F.trim(F.coalesce(article, F.lit(""))) != "") & (F.trim(F.coalesce(abstract, F.lit(""))) != ""))
    if n is not None:
        full = full.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)
    return full.select(F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string")).alias("example_id"), F.substring(article, 1, longest).alias("article_text"), F.col(abstract).alias("reference"))
