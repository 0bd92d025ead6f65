"""Statistics that describe each domain's corpus, and how they relate to the domain's weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import KEYS
from ..sources.shared import scratch

RECENT_YEAR, HIGH_CITED, HIGH_H = 2024, 100, 20
#: The canonical order of the features.
FEATURES = (
    "median_year", "pct_recent", "year_std", "citation_gini", "citation_median", "pct_high_cited", "unique_author_ratio",
    "mean_h_index", "pct_high_hindex", "pct_q1", "topic_concept_overlap", "gold_ratio", "grade2_ratio",
)


#: Counts and sums of a domain's works that add up over disjoint parts of its corpus.
COUNTS = ("n", "recent", "high_cited", "h_sum", "h_known", "high_h", "q1", "overlapping", "golden", "grade2")
#: Precision of the sketch of first authors: an error of about 1.6 percent, 4 KB at most.
SKETCH_BITS = 12


def _per_work(works: DataFrame, gold: DataFrame, recent_year: int, high_cited: int, high_h: int) -> DataFrame:
    """One narrow row a work: what each statistic needs of it. Repeated (domain, article) gold rows count once, by their highest grade."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    first = F.get("authors", F.lit(0))
    topic_words = F.filter(F.split(F.lower("topic"), r"\s+"), lambda w: F.length(w) > 2)
    graded = gold.groupBy("domain_id", F.col("article_id").alias("id")).agg(F.max("grade").alias("__grade"))
    return works.join(graded, ["domain_id", "id"], "left").select(
        "domain_id",
        "year",
        "citation_count",
        first["name"].alias("first_name"),
        first["h_index"].alias("first_h"),
        flag(F.col("year") >= recent_year).alias("recent"),
        flag(F.col("citation_count") > high_cited).alias("high_cited"),
        flag(F.exists("authors", lambda a: a["h_index"] >= high_h)).alias("high_h"),
        flag(F.col("quartile") == "Q1").alias("q1"),
        flag(F.exists(topic_words, lambda w: F.contains(F.lower("concepts_text"), w))).alias("overlapping"),
        F.col("__grade").isNotNull().cast("int").alias("golden"),
        flag(F.col("__grade") == 2).alias("grade2"),
    )


def domain_features(works: DataFrame, gold: DataFrame, recent_year: int = RECENT_YEAR, high_cited: int = HIGH_CITED, high_h: int = HIGH_H) -> DataFrame:
    """One row a domain with corpus_size and the 13 features.

    ``works`` needs domain_id, id, year, citation_count, authors, quartile, concepts_text, topic. Shares
    divide by all of a domain's works; gold rows outside the corpus don't count; null years don't enter
    the year statistics. Repeated (domain, article) gold rows count once.
    """
    found = _per_work(works, gold, recent_year, high_cited, high_h)
    path = scratch(works.sparkSession, "per-work")  # stored: works may be costly, and four aggregates read them
    found.write.parquet(path)
    rows = works.sparkSession.read.schema(found.schema).parquet(path)
    n = F.count("*")
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = rows.groupBy("domain_id").agg(
        n.alias("corpus_size"),
        share("recent").alias("pct_recent"),
        F.when(F.count("year") < 2, 0.0).otherwise(F.stddev_pop("year")).alias("year_std"),
        share("high_cited").alias("pct_high_cited"),
        F.coalesce(F.avg("first_h"), F.lit(0.0)).alias("mean_h_index"),
        share("high_h").alias("pct_high_hindex"),
        share("q1").alias("pct_q1"),
        share("overlapping").alias("topic_concept_overlap"),
        share("golden").alias("gold_ratio"),
        share("grade2").alias("grade2_ratio"),
    )
    authors = rows.where(F.col("first_name").isNotNull()).select("domain_id", "first_name").distinct().groupBy("domain_id").agg(F.count("*").alias("__authors"))
    every = out.join(_counted_median(rows, "year").withColumnRenamed("median", "median_year"), "domain_id").join(_counted_median(rows, "citation_count").withColumnRenamed("median", "citation_median"), "domain_id")
    ratio = F.coalesce("__authors", F.lit(0)) / F.col("corpus_size")
    return every.join(citation_gini(rows), "domain_id").join(authors, "domain_id", "left").withColumn("unique_author_ratio", ratio).select("domain_id", "corpus_size", *FEATURES)


def _counted_median(rows: DataFrame, column: str) -> DataFrame:
    """(domain_id, median), exact: values are counted first, so that only distinct ones are put in order."""
    counts = rows.groupBy("domain_id", column).agg(F.count("*").alias("m"))
    return counts.groupBy("domain_id").agg(F.percentile(column, 0.5, F.col("m")).alias("median"))


def corpus_state(works: DataFrame, gold: DataFrame, recent_year: int = RECENT_YEAR, high_cited: int = HIGH_CITED, high_h: int = HIGH_H) -> DataFrame:
    """What the features of a part of a corpus come from, so that parts can be merged: rows (domain_id, kind, value, m, counts, authors).

    kind 'year' and 'citations' are counted histograms (value, m), which medians, deviation and gini follow from exactly; kind 'sums'
    is one row a domain with the sums COUNTS and a HyperLogLog sketch of first authors' names.
    One pass over the works: a narrow row of each is counted for its year, its citations and its domain within the task, so
    what is shuffled grows with tasks x distinct values, not with works.
    """
    rows = _per_work(works, gold, recent_year, high_cited, high_h)
    seen = {"n": F.lit(1), "h_sum": F.coalesce("first_h", F.lit(0)), "h_known": F.col("first_h").isNotNull().cast("int")}
    kind = lambda name, value, author: F.struct(F.lit(name).alias("kind"), value.cast("long").alias("value"), author.cast("string").alias("author"))
    nothing = F.lit(None)
    kinds = F.explode(F.array(kind("year", F.col("year"), nothing), kind("citations", F.col("citation_count"), nothing), kind("sums", nothing, F.col("first_name"))))
    each = rows.select("domain_id", *(seen.get(c, F.col(c)).alias(c) for c in COUNTS), kinds.alias("k"))
    summed = each.groupBy("domain_id", F.col("k.kind").alias("kind"), F.col("k.value").alias("value")).agg(F.count("*").alias("m"), *(F.sum(c).cast("long").alias(c) for c in COUNTS), F.hll_sketch_agg("k.author", SKETCH_BITS).alias("authors"))
    return _state_rows(summed)


def _state_rows(summed: DataFrame) -> DataFrame:
    own = F.col("kind") == "sums"
    return summed.select("domain_id", "kind", "value", "m", F.when(own, F.struct(*COUNTS)).alias("counts"), F.when(own, F.col("authors")).alias("authors"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of the parts together; parts must not share works. Equal for any order of parts, and for a merge of merges."""
    every = reduce(DataFrame.unionByName, states)
    sums = [F.sum(f"counts.{c}").alias(c) for c in COUNTS]
    return _state_rows(every.groupBy("domain_id", "kind", "value").agg(F.sum("m").alias("m"), *sums, F.hll_union_agg("authors").alias("authors")))


def state_features(state: DataFrame) -> DataFrame:
    """domain_features() of a corpus from its state; unique_author_ratio is the sketch's estimate, all else exact.

    Windows go over the distinct years and citation numbers of a domain, not over its works.
    """
    bins = state.where((F.col("kind") != "sums") & F.col("value").isNotNull())
    own = Window.partitionBy("domain_id", "kind")
    upto = F.sum("m").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = bins.withColumns({"upto": upto, "all": F.sum("m").over(own)}).withColumn("before", F.col("upto") - F.col("m"))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("value")))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    m, v, x = F.col("m"), F.col("value"), F.col("value").cast("double")
    known = placed.groupBy("domain_id", "kind").agg(
        F.max("all").alias("n"),
        ((at(low) + at(high)) / 2).alias("median"),
        F.sum(m * x).alias("total"),
        F.sum(x * (m * F.col("before") + m * (m + 1) / 2)).alias("placed"),
        F.sum(m * (x - F.lit(2000)) * (x - F.lit(2000))).alias("squares"),
        F.sum(m * (v - 2000)).alias("shifted"),
    )
    of = lambda kind, *cols: known.where(F.col("kind") == kind).select("domain_id", *(F.col(c).alias(f"{kind}_{c}") for c in cols))
    sums = state.where("kind = 'sums'").select("domain_id", "counts.*", "authors")
    every = sums.join(of("year", "n", "median", "squares", "shifted"), "domain_id", "left").join(of("citations", "n", "median", "total", "placed"), "domain_id", "left")
    n, years, cited = F.col("n"), F.col("year_n"), F.col("citations_n")
    mean = F.col("year_shifted") / years
    share = lambda c: (F.col(c) / n)
    total = F.col("citations_total")
    return every.select(
        "domain_id",
        n.alias("corpus_size"),
        F.col("year_median").alias("median_year"),
        share("recent").alias("pct_recent"),
        F.when(F.coalesce(years, F.lit(0)) < 2, 0.0).otherwise(F.sqrt(F.greatest(F.col("year_squares") / years - mean * mean, F.lit(0.0)))).alias("year_std"),
        F.when(F.coalesce(total, F.lit(0.0)) == 0, 0.0).otherwise(2 * F.col("citations_placed") / (cited * total) - (cited + 1) / cited).alias("citation_gini"),
        F.col("citations_median").alias("citation_median"),
        share("high_cited").alias("pct_high_cited"),
        (F.hll_sketch_estimate("authors") / n).alias("unique_author_ratio"),
        F.when(F.col("h_known") == 0, 0.0).otherwise(F.col("h_sum") / F.col("h_known")).alias("mean_h_index"),
        share("high_h").alias("pct_high_hindex"),
        share("q1").alias("pct_q1"),
        share("overlapping").alias("topic_concept_overlap"),
        share("golden").alias("gold_ratio"),
        share("grade2").alias("grade2_ratio"),
    )


def citation_gini(works: DataFrame) -> DataFrame:
    """(domain_id, citation_gini): each domain's works are counted by citations first, so that only distinct numbers are put in order."""
    counts = works.groupBy("domain_id", "citation_count").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("domain_id").orderBy("citation_count").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m, c = F.col("m"), F.col("citation_count")
    # places before + 1 to before + m, summed up
    sums = counts.withColumn("b", before).groupBy("domain_id").agg(F.sum(m).alias("n"), F.sum(m * c).alias("total"), F.sum(c * (m * F.col("b") + m * (m + 1) / 2)).alias("placed"))
    n, total = F.col("n"), F.col("total")
    return sums.select("domain_id", F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(2 * F.col("placed") / (n * total) - (n + 1) / n).alias("citation_gini"))


def grade_counts(works: DataFrame, gold: DataFrame) -> DataFrame:
    g = works.select("domain_id", "id").join(gold.select("domain_id", F.col("article_id").alias("id"), "grade"), ["domain_id", "id"], "left")
    return g.groupBy("domain_id").agg(F.count_if(F.col("grade") == 2).alias("grade2"), F.count_if(F.col("grade") == 1).alias("grade1"), F.count_if(F.coalesce("grade", F.lit(0)) == 0).alias("background"))


def unpivot(table: DataFrame, names: tuple[str, ...] | list[str], key: str, value: str, prefix: str = "") -> DataFrame:
    return table.unpivot(["domain_id"], [F.col(prefix + n).cast("double").alias(n) for n in names], key, value)


def correlations(features: DataFrame, weights: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Pearson's r over domains for each (feature, weight key); 0 where either hardly varies or fewer than two domains are known."""
    x, y = unpivot(features, names, "feature", "x"), unpivot(weights, KEYS, "key", "y", "w_")
    both = x.join(y, "domain_id").groupBy("feature", "key").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    flat = (F.col("n") < 2) | (F.col("sx") < 1e-12) | (F.col("sy") < 1e-12)
    return both.select("feature", "key", F.when(flat, 0.0).otherwise(F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def feature_order(r: DataFrame, strong: float = 0.4) -> DataFrame:
    """Features by their largest absolute correlation, with the number of strong pairs and whether to select them."""
    size = F.abs("r")
    return r.groupBy("feature").agg(F.max(size).alias("max_abs_r"), F.count_if(size >= strong).alias("strong_pairs"), F.max_by("key", F.struct(size, F.col("key"))).alias("best_key")).withColumn("selected", F.col("max_abs_r") > strong)


def assemble(config: DataFrame, features: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domains with both features and weights, skipped domains with the reason)."""
    full = config.join(features, "domain_id").join(weights, "domain_id")
    no_features = config.join(features, "domain_id", "left_anti").select("domain_id", F.lit("no features").alias("reason"))
    no_weights = config.join(features, "domain_id", "left_semi").join(weights, "domain_id", "left_anti").select("domain_id", F.lit("no weights").alias("reason"))
    return full, no_features.union(no_weights)


def gold_check(works: DataFrame, gold: DataFrame) -> DataFrame:
    """Per domain: gold rows, those in the corpus, and whether any is missing from it."""
    known = works.select("domain_id", F.col("id").alias("article_id"), F.lit(1).alias("__in"))
    j = gold.join(known, ["domain_id", "article_id"], "left")
    return j.groupBy("domain_id").agg(F.count("*").alias("gold"), F.count("__in").alias("matched")).withColumn("mismatch", F.col("matched") < F.col("gold"))
