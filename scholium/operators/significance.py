"""The signed-rank test of a method against a baseline over domains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.generation import effect_size_label
from ..functions.text import normal_tail

#: Fewer differences that aren't zero give no p.
LEAST = 5
#: Up to so many differences the sign patterns are enumerated; beyond that the normal approximation stands alone.
MOST_EXACT = 50


def signed_ranks(results: DataFrame, baseline: str, value: str = "ndcg15", tolerance: float = 1e-9) -> DataFrame:
    """(method, domain_id, d, r): every difference from the baseline, zeros included, with the mean rank of its size among equals.

    Differences up to the tolerance are zeros (d = 0.0); they are alike and rank lowest.
    """
    base = results.where(F.col("method") == baseline).select("domain_id", F.col(value).alias("base"))
    d = F.round(F.col(value) - F.col("base"), 12)
    both = results.where(F.col("method") != baseline).join(base, "domain_id").select("method", "domain_id", F.when(F.abs(d) <= tolerance, 0.0).otherwise(d).alias("d"))
    size = F.abs("d")
    w = Window.partitionBy("method").orderBy(size)
    same = Window.partitionBy("method", size)
    return both.withColumn("r", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


@F.pandas_udf(DoubleType())
def _exact_p(doubled_ranks: pd.Series, doubled_plus: pd.Series) -> pd.Series:
    """One-sided: the share of sign patterns whose positive rank sum reaches the observed one (ranks times two are whole)."""
    out = []
    for ranks, plus in zip(doubled_ranks, doubled_plus):
        ways = {0: 1}
        for r in ranks:
            more: dict[int, int] = dict(ways)
            for s, n in ways.items():
                more[s + int(r)] = more.get(s + int(r), 0) + n
            ways = more
        out.append(sum(n for s, n in ways.items() if s >= plus) / 2 ** len(ranks))
    return pd.Series(out, dtype="float64")


def signed_rank_test(results: DataFrame, baseline: str, value: str = "ndcg15", tolerance: float = 1e-9) -> DataFrame:
    """One-sided test per method that it exceeds the baseline, by p.

    Zeros are split: they take part in the ranking, and half of their rank sum goes to either side (w_plus, w_minus). n counts
    the differences that aren't zero, zeros the others. z and p_normal are the normal approximation, its variance reduced
    for ties, zeros being one tie. p_exact enumerates the signs of the differences that aren't zero at their ranks
    (null above MOST_EXACT differences). p is p_exact without zeros up to MOST_EXACT differences, else p_normal; all are null below LEAST
    differences that aren't zero. r_biserial and its label rest on the differences that aren't zero, ranked among themselves;
    it is 0 where all are zeros.
    """
    d, r, t = F.col("d"), F.col("r"), F.col("t")
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    size = F.abs("d")
    alike = F.count("*").over(Window.partitionBy("method", size)).cast("double")
    place = F.sum((d != 0).cast("int")).over(Window.partitionBy("method").orderBy(size, "domain_id").rowsBetween(Window.unboundedPreceding, 0))
    ranked = signed_ranks(results, baseline, value, tolerance).withColumns({"t": alike, "place": place})
    full = ranked.groupBy("method").agg(
        F.count_if(d != 0).alias("n"),
        F.count_if(d == 0).alias("zeros"),
        part(d > 0, r).alias("up"),
        part(d < 0, r).alias("down"),
        part(d == 0, r).alias("level"),
        F.count_if(d > 0).alias("__ups"),
        F.count_if(d < 0).alias("__downs"),
        F.sum(t * t - 1).alias("tied"),  # of t equal ones each bears a t-th of t^3 - t
        F.sort_array(F.collect_list(F.when((d != 0) & (F.col("place") <= MOST_EXACT), (r * 2).cast("long")))).alias("__ranks"),  # at most MOST_EXACT
    )
    every = (F.col("n") + F.col("zeros")).cast("double")
    plus, minus = F.col("up") + F.col("level") / 2, F.col("down") + F.col("level") / 2
    spread = F.sqrt((every * (every + 1) * (2 * every + 1) - F.col("tied") / 2) / 24)
    enough = F.col("n") >= LEAST
    z = F.when(enough, (plus - every * (every + 1) / 4) / spread)
    exact = F.when(enough & (F.col("n") <= MOST_EXACT), _exact_p("__ranks", (F.col("up") * 2).cast("long")))
    # without the zeros below it a rank is lower by their number
    own_up, own_down = F.col("up") - F.col("zeros") * F.col("__ups"), F.col("down") - F.col("zeros") * F.col("__downs")
    biserial = F.when(F.col("n") == 0, 0.0).otherwise((own_up - own_down) / (own_up + own_down))
    out = full.select("method", "n", "zeros", plus.alias("w_plus"), minus.alias("w_minus"), biserial.alias("r_biserial"), z.alias("z"), normal_tail(z).alias("p_normal"), exact.alias("p_exact"))
    p = F.when((F.col("zeros") == 0) & (F.col("n") <= MOST_EXACT), F.col("p_exact")).otherwise(F.col("p_normal"))
    return out.withColumns({"p": p, "effect": effect_size_label(F.col("r_biserial"))}).orderBy(F.asc_nulls_last("p"), "method")
