"""Ranking quality against graded relevance, for every (domain, method) at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def with_grades(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    return ranking.join(gold.select("domain_id", "article_id", "grade"), ["domain_id", "article_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ideal(gold: DataFrame, ks: tuple[int, ...] = (10, 15)) -> DataFrame:
    """Per domain: ideal DCG at each k over all gold rows, and the numbers of relevant ones.

    The ideal order puts equal grades side by side, so the numbers of rows by grade say which places each grade takes; sums
    of 1 / log2(place + 1) up to any place stand in a table of max(ks) + 1 numbers.
    """
    sums = [0.0]
    for place in range(1, max(ks) + 1):
        sums.append(sums[-1] + 1 / math.log2(place + 1))
    table = F.array(*map(F.lit, sums))
    discounts = lambda upto, k: F.get(table, F.least(upto, F.lit(k)).cast("int"))
    counts = gold.groupBy("domain_id", "grade").agg(F.count("*").alias("m"))
    last = F.sum("m").over(Window.partitionBy("domain_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0))  # a row for each grade
    placed = counts.withColumn("last", last).withColumn("before", F.col("last") - F.col("m"))
    cols = [F.sum(gain(F.col("grade")) * (discounts(F.col("last"), k) - discounts(F.col("before"), k))).alias(f"idcg{k}") for k in ks]
    return placed.groupBy("domain_id").agg(*cols, F.coalesce(F.sum(F.when(F.col("grade") >= 1, F.col("m"))), F.lit(0)).alias("relevant"))


def evaluate(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (10, 15), precision_ks: tuple[int, ...] = (5, 10), recall_k: int = 30, least: int = 1) -> DataFrame:
    """ndcg@k, p@k, recall@k and map for each (domain_id, method) of ``ranking`` (rank from 1) in one pass.

    Precision divides by the rows that are in the top k; ideal DCG, recall and map count gold rows that
    aren't ranked. Without relevant gold, or without ranked rows, a measure is 0.
    """
    most = max(*ks, *precision_ks, recall_k)
    graded = with_grades(ranking, gold).withColumn("hit", (F.col("grade") >= least).cast("int")).where((F.col("rank") <= most) | (F.col("hit") == 1))
    # only hits and the top are left: the window's tasks grow with the gold rows, not with the ranking
    rows = graded.withColumn("so_far", F.sum("hit").over(Window.partitionBy("domain_id", "method").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    term = gain(F.col("grade")) / F.log2(F.col("rank") + 1)
    top = lambda k, c: F.when(F.col("rank") <= k, c)
    found = rows.groupBy("domain_id", "method").agg(
        *(F.coalesce(F.sum(top(k, term)), F.lit(0.0)).alias(f"dcg{k}") for k in ks),
        *(F.coalesce(F.avg(top(k, F.col("hit"))), F.lit(0.0)).alias(f"p{k}") for k in precision_ks),
        F.coalesce(F.sum(top(recall_k, F.col("hit"))), F.lit(0)).alias("found"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    joined = found.join(ideal(gold.withColumn("grade", F.col("grade")), ks), "domain_id", "left")
    per = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)
    return joined.select(
        "domain_id",
        "method",
        *(per(F.col(f"dcg{k}"), F.col(f"idcg{k}")).alias(f"ndcg{k}") for k in ks),
        *(f"p{k}" for k in precision_ks),
        per(F.col("found"), F.col("relevant")).alias(f"recall{recall_k}"),
        per(F.col("precisions"), F.col("relevant")).alias("map"),
    )


def wins(results: DataFrame, baseline: str, tolerance: float = 1e-9, value: str = "ndcg15") -> DataFrame:
    """Per method: domains where it beats, loses to and ties with the baseline method, and the share won."""
    base = results.where(F.col("method") == baseline).select("domain_id", F.col(value).alias("base"))
    d = results.where(F.col("method") != baseline).join(base, "domain_id").withColumn("d", F.col(value) - F.col("base"))
    return d.groupBy("method").agg(
        F.count_if(F.col("d") > tolerance).alias("wins"),
        F.count_if(F.col("d") < -tolerance).alias("losses"),
        F.count_if(F.abs("d") <= tolerance).alias("ties"),
        (F.count_if(F.col("d") > tolerance) / F.count("*")).alias("win_rate"),
    )


def verdict(won: DataFrame, n_domains: int | Column, share: float = 0.75) -> DataFrame:
    """Whether a method wins in at least ``share`` of the domains, rounded up."""
    n = F.lit(n_domains) if isinstance(n_domains, int) else n_domains
    return won.withColumn("needed", F.ceil(F.lit(share) * n)).withColumn("supported", F.col("wins") >= F.col("needed"))


def mean_by_method(results: DataFrame, default: str = "default", value: str = "ndcg15") -> DataFrame:
    """Mean of each method and its gain over the default in percent."""
    means = results.groupBy("method").agg(F.avg(value).alias("mean"))
    base = means.where(F.col("method") == default).select(F.col("mean").alias("base"))
    return means.crossJoin(F.broadcast(base)).select("method", "mean", F.when(F.col("base") == 0, 0.0).otherwise((F.col("mean") / F.col("base") - 1) * 100).alias("gain_pct"))  # base is one row


def winner(table: DataFrame, methods: list[str], band: float = 0.001) -> DataFrame:
    """A row's best column among ``methods``, or 'tie' if the next best is within the band."""
    ordered = F.reverse(F.array_sort(F.array(*(F.struct(F.col(m).alias("v"), F.lit(m).alias("m")) for m in methods))))
    return table.withColumn("__o", ordered).withColumn("winner", F.when(F.col("__o")[0]["v"] - F.col("__o")[1]["v"] <= band, "tie").otherwise(F.col("__o")[0]["m"])).drop("__o")


def comparison(results: DataFrame, methods: list[str], value: str = "ndcg15", band: float = 0.001) -> DataFrame:
    """One row a domain with a column for each method, one of their means (domain_id MEAN), and winner()."""
    wide = results.rollup("domain_id").agg(*(F.avg(F.when(F.col("method") == m, F.col(value))).alias(m) for m in methods))
    return winner(wide.withColumn("domain_id", F.coalesce("domain_id", F.lit("MEAN"))), methods, band)


def best_alpha(results: DataFrame, baseline: DataFrame, value: str = "ndcg15") -> DataFrame:
    """Per alpha: wins over the baseline, mean, and its place (more wins, then higher mean in billionths, then lower alpha).

    The best alpha is chosen on the folds it is reported on, so its mean is optimistic.
    """
    base = baseline.select("domain_id", F.col(value).alias("base"))
    swept = results.join(base, "domain_id").groupBy("alpha").agg(F.count_if(F.col(value) > F.col("base")).alias("wins"), F.avg(value).alias("mean"))
    return swept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("wins"), F.desc(F.floor(F.col("mean") * 1e9 + 0.5)), "alpha")))  # a dozen alphas


def blend_sweep(results: DataFrame, blends: tuple[str, ...], baseline: str = "transfer") -> DataFrame:
    """(blend, alpha, wins, mean, best) of stored results (domain_id, method, ndcg15, alpha) of blends, each against the baseline method.

    A blend's methods are named <blend>_<alpha>. best marks each blend's own alpha with most wins, then the highest mean, then the lowest alpha;
    as it is chosen on the folds it is reported on, its mean is optimistic.
    """
    base = results.where(F.col("method") == baseline).select("domain_id", F.col("ndcg15").alias("base"))
    named = F.coalesce(*(F.when(F.startswith("method", F.lit(f"{b}_")), b) for b in blends))
    swept = results.where(F.col("alpha").isNotNull()).withColumn("blend", named).where(F.col("blend").isNotNull()).join(base, "domain_id")
    each = swept.groupBy("blend", "alpha").agg(F.count_if(F.col("ndcg15") > F.col("base")).alias("wins"), F.avg("ndcg15").alias("mean"))
    order = Window.partitionBy("blend").orderBy(F.desc("wins"), F.desc(F.floor(F.col("mean") * 1e9 + 0.5)), "alpha")  # a dozen alphas
    return each.withColumn("best", F.row_number().over(order) == 1)
