"""Gating, ranking and selecting works; merging the results of several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import KEYS, gate_threshold


def resolve_weights(topics: DataFrame, learned: DataFrame, explicit: DataFrame, default: dict[str, float]) -> DataFrame:
    """Weights of each topic: learned before explicit before default, with where they come from."""
    cols = [f"w_{k}" for k in KEYS]
    a = learned.select("topic", F.struct(*cols).alias("__l"))
    b = explicit.select("topic", F.struct(*cols).alias("__e"))
    standard = F.struct(*(F.lit(float(default[k])).alias(f"w_{k}") for k in KEYS))
    joined = topics.join(a, "topic", "left").join(b, "topic", "left")
    chosen = joined.withColumn("__w", F.coalesce("__l", "__e", standard))
    origin = F.when(F.col("__l").isNotNull(), "learned").when(F.col("__e").isNotNull(), "explicit").otherwise("default")
    return chosen.select(*topics.columns, *(F.col(f"__w.{c}").alias(c) for c in cols), origin.alias("weights_from"))


def rank(scored: DataFrame, by: Column, key: str = "domain_id", position: str = "id") -> DataFrame:
    """1-based rank within a key by a descending score; ties in the order of ``position``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(by.desc(), F.col(position))))


def rank_all(scored: DataFrame, by: Column, key: str = "domain_id", position: str = "id", name: str = "rank", steps: float = 1_000_000, width: int = 1 << 22) -> DataFrame:
    """rank() for whole rankings: a key's rows are dealt by stripes of the score, with the rows before each stripe counted first.

    A stripe of one score only is dealt further by stripes of a numeric position. So no task sorts a whole key,
    however many rows it has. Null scores come last; rows with a null key are ranked among themselves.
    """
    numeric = scored.schema[position].dataType.typeName() in ("byte", "short", "integer", "long")
    stripe = {"__s": F.coalesce(F.floor(by * steps), F.lit(-(2**62))), "__p": F.coalesce(F.floor(F.col(position) / width), F.lit(0)) if numeric else F.lit(0)}
    striped = scored.withColumns(stripe)
    sizes = striped.groupBy(key, "__s", "__p").agg(F.count("*").alias("__n"), F.min(by).alias("__lo"), F.max(by).alias("__hi"))
    same = Window.partitionBy(key, "__s")
    tied = F.coalesce(F.min("__lo").over(same) == F.max("__hi").over(same), F.lit(True))  # all null: tied as well
    sizes = sizes.withColumn("__part", F.when(tied, F.col("__p")).otherwise(0))
    order = Window.partitionBy(key).orderBy(F.desc("__s"), F.asc("__part"))
    earlier = F.sum("__n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("__n").over(Window.partitionBy(key, "__s", "__part"))
    before = sizes.select(F.col(key).alias("__k"), F.col("__s").alias("__s2"), F.col("__p").alias("__p2"), "__part", earlier.alias("__before"))
    joined = striped.join(before, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__s") == F.col("__s2")) & (F.col("__p") == F.col("__p2")))
    own = F.row_number().over(Window.partitionBy(key, "__s", "__part").orderBy(by.desc(), F.col(position)))
    return joined.withColumn(name, (F.col("__before") + own).cast("int")).drop("__s", "__p", "__k", "__s2", "__p2", "__part", "__before")


def top_n(scored: DataFrame, by: Column, n: int, key: str = "domain_id", position: str = "id") -> DataFrame:
    return rank(scored, by, key, position).where(F.col("rank") <= n)


def gate(scored: DataFrame, learned_relevance_weight: Column | None = None) -> DataFrame:
    """Rows whose relevance reaches the threshold; what they are ranked by is the caller's."""
    weight = learned_relevance_weight if learned_relevance_weight is not None else F.lit(None).cast("double")
    return scored.where(F.col("relevance_score") >= gate_threshold(weight))


def first_query_wins(hits: DataFrame) -> DataFrame:
    """One row an article over all queries: the earliest query's, then the earliest result's."""
    best = hits.groupBy("article_id").agg(F.min(F.struct("query_pos", "result_pos", "query")).alias("b"))
    return best.select("article_id", "b.query_pos", "b.result_pos", "b.query")


def per_query_quota(n_raw: int, n_queries: int) -> int:
    return max(10, n_raw // max(1, n_queries))


def distinct_queries(queries: DataFrame, topic: str) -> DataFrame:
    """Queries without case-insensitive repeats, the topic itself first."""
    spark = queries.sparkSession
    all_ = spark.createDataFrame([(0, topic)], "pos long, query string").union(queries.select((F.col("pos") + 1).cast("long"), "query"))
    best = all_.groupBy(F.lower("query").alias("k")).agg(F.min(F.struct("pos", "query")).alias("b"))
    return best.select(F.row_number().over(Window.orderBy("b.pos")).alias("pos"), F.col("b.query").alias("query"))  # queries are a handful


def productive_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Each query with its number of results, and whether it had any."""
    n = hits.groupBy("query").agg(F.count("*").alias("n"))
    return queries.join(n, "query", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "productive": F.coalesce("n", F.lit(0)) > 0})


def rank_changes(scored: DataFrame, a: Column, b: Column, least: int = 2, key: str = "domain_id", position: str = "id") -> DataFrame:
    """Ranks by two scores, their difference, and whether the second promotes or demotes a work by at least ``least``."""
    both = rank_all(rank_all(scored, a, key, position, "rank_a"), b, key, position, "rank_b").withColumn("delta", F.col("rank_a") - F.col("rank_b"))
    return both.withColumn("change", F.when(F.col("delta") >= least, "promoted").when(F.col("delta") <= -least, "demoted").otherwise("same"))


def select_by_index(works: DataFrame, indices: list[int], key: str = "domain_id") -> DataFrame:
    """Works at the given 1-based places by falling citations; out_of_range() tells of places beyond the end."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("citation_count"), "id"))
    return works.withColumn("place", n).where((F.col("place") <= max(indices, default=0)) & F.col("place").isin(indices))


def out_of_range(works: DataFrame, indices: list[int], key: str = "domain_id") -> DataFrame:
    """(key, place, n): the given places that a key's n works don't reach, or that are below 1."""
    n = works.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(key, F.explode(F.array(*(F.lit(i) for i in indices))).alias("place"), "n").where((F.col("place") > F.col("n")) | (F.col("place") < 1))


def promotion_score(survey_like: Column, citations: Column, most: Column, bonus: float = 3.0) -> Column:
    return F.when(survey_like, bonus).otherwise(0.0) + F.when(most > 0, F.coalesce(citations, F.lit(0)) / most).otherwise(0.0)


def promotion_pool(gold: DataFrame, works: DataFrame, survey_like: Column) -> DataFrame:
    """The grade-1 works in the corpus (domain_id, article_id, title, citation_count) with their promotion score.

    A domain's most citations come from an aggregate that is joined back, so that no task gathers a domain.
    """
    pool = gold.where("grade = 1").join(works.select("domain_id", F.col("id").alias("article_id"), "title", "citation_count"), ["domain_id", "article_id"])
    most = pool.groupBy("domain_id").agg(F.max("citation_count").alias("__most"))
    return pool.join(most, "domain_id").withColumn("score", promotion_score(survey_like, F.col("citation_count"), F.col("__most"))).drop("__most")


def promote(gold: DataFrame, works: DataFrame, survey_like: Column, n: int = 5) -> DataFrame:
    """gold (domain_id, article_id, grade) with new_grade: the best n of a domain's grade-1 works in the corpus become 2."""
    scored = promotion_pool(gold, works, survey_like)
    chosen = top_n(scored, F.col("score"), n, position="article_id").select("domain_id", "article_id", F.lit(2).alias("__up"))
    return gold.join(chosen, ["domain_id", "article_id"], "left").withColumn("new_grade", F.coalesce("__up", "grade")).drop("__up")


def promotion_plan(promoted: DataFrame) -> DataFrame:
    """What promote() would change, and nothing else: a dry run to look at before the new grades are stored."""
    return promoted.where(F.col("new_grade") != F.col("grade")).select("domain_id", "article_id", "grade", "new_grade")


def promotion_counts(promoted: DataFrame) -> DataFrame:
    """Per domain: gold rows of grade 1 and 2 before and after, and how many rise."""
    n = lambda c, g: F.count_if(F.col(c) == g)
    return promoted.groupBy("domain_id").agg(n("grade", 2).alias("grade2_before"), n("new_grade", 2).alias("grade2_after"), n("grade", 1).alias("grade1_before"), n("new_grade", 1).alias("grade1_after"), F.count_if(F.col("new_grade") != F.col("grade")).alias("promoted"))
