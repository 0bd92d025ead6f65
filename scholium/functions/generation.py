"""Columns around generated summaries: composites, costs, coercion, ordinal thresholds and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import half_up

QUALITY_ORDER = ("poor", "acceptable", "good", "excellent")
NEUTRAL_JUDGE = 0.5
#: US dollars for a million input and output tokens.
PRICES = (
    ("claude-haiku-4-5", 1.00, 5.00),
    ("claude-sonnet-4-6", 3.00, 15.00),
    ("claude-opus-4-7", 5.00, 25.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("llama3-8b-8192", 0.05, 0.08),
    ("mixtral-8x7b-32768", 0.24, 0.24),
    ("deepseek-ai/DeepSeek-V3.2", 0.14, 0.28),
    ("deepseek-ai/DeepSeek-V3.2-fast", 0.10, 0.20),
    ("deepseek-ai/DeepSeek-V4-Pro", 0.27, 1.10),
    ("meta-llama/Llama-3.3-70B-Instruct", 0.12, 0.30),
    ("Qwen/Qwen3-235B-A22B-Thinking-2507-fast", 0.20, 0.60),
    ("Qwen/Qwen3-32B", 0.10, 0.30),
)


def composite(rouge1: Column, rouge2: Column, rouge_l: Column, faithfulness: Column, coverage: Column) -> Column:
    """With overlap and judge .4/.4/.2; judge alone .6/.4; overlap alone the mean of the three. Null if neither is there."""
    overlap, judge = (rouge1 + rouge2 + rouge_l) / 3, faithfulness.isNotNull() & coverage.isNotNull()
    both = 0.4 * overlap + 0.4 * faithfulness + 0.2 * coverage
    return half_up(F.when(judge & overlap.isNotNull(), both).when(judge, 0.6 * faithfulness + 0.4 * coverage).otherwise(overlap), 4)


def attach_judge(results: DataFrame, judged: DataFrame, on: list[str]) -> DataFrame:
    """Judge scores by key; a failed or missing call counts as neutral."""
    j = judged.select(*on, "faithfulness", "coverage")
    return results.join(j, on, "left").withColumns({c: F.coalesce(c, F.lit(NEUTRAL_JUDGE)) for c in ("faithfulness", "coverage")})


def prices(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double")


def token_cost(usage: DataFrame, price_table: DataFrame) -> DataFrame:
    """``usage`` with cost_usd: cached reads at a tenth, cache writes at 1.25 of the input price; unknown models cost 0.

    ``price_table`` has one row a model (model, input_price, output_price).
    """
    fresh = F.greatest(F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_creation_tokens"), F.lit(0))
    cost = (fresh + 1.25 * F.col("cache_creation_tokens") + 0.1 * F.col("cache_read_tokens")) * F.col("input_price") / 1e6 + F.col("output_tokens") * F.col("output_price") / 1e6
    return usage.join(price_table, "model", "left").withColumn("cost_usd", F.coalesce(half_up(cost, 6), F.lit(0.0))).drop("input_price", "output_price")


def below_quality(quality: Column, threshold: str) -> Column:
    """Whether an ordinal label lies below the threshold; unknown labels don't."""
    order = F.array(*(F.lit(q) for q in QUALITY_ORDER))
    at = F.array_position(order, F.coalesce(quality, F.lit("")))
    return (at > 0) & (at < QUALITY_ORDER.index(threshold) + 1)


SUMMARY_TEXTS = ("problem", "method", "results")


def parse_summary(raw_json: Column) -> Column:
    """A summary from JSON: null required texts become empty, a lone contribution becomes a list, a blank one an empty list."""
    schema = "problem string, method string, dataset string, results string, limitations string, key_contributions array<string>"
    s = F.from_json(raw_json, schema)
    lone = F.get_json_object(raw_json, "$.key_contributions")
    listed = F.coalesce(s["key_contributions"], F.when(lone.startswith("["), F.from_json(lone, "array<string>")).when(F.trim(lone) != "", F.array(lone)), F.array().cast("array<string>"))
    texts = [F.coalesce(s[c], F.lit("")).alias(c) if c in SUMMARY_TEXTS else s[c].alias(c) for c in ("problem", "method", "dataset", "results", "limitations")]
    return F.struct(*texts, listed.alias("key_contributions"))


def flatten_summary(problem: Column, method: Column, dataset: Column, results: Column, limitations: Column, contributions: Column) -> Column:
    """A summary as one text; empty parts and 'not specified' are left out."""
    given = lambda c: F.when(c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "not specified"), c)
    parts = [given(problem), given(method), F.concat(F.lit("Dataset: "), given(dataset)), given(results), F.concat(F.lit("Limitations: "), given(limitations)), F.when(F.size(contributions) > 0, F.array_join(contributions, " "))]
    return F.concat_ws(" ", *parts)


def run_mode(use_rouge: Column, run_name: Column) -> Column:
    return F.when(F.coalesce(use_rouge, F.lit(False)), "narrative+rouge").when(F.lower(run_name).contains("narrative"), "narrative").otherwise("structured")


def run_provider(models: Column) -> Column:
    """The one vendor (before '/') of all model names in an array, or 'mixed'."""
    vendors = F.array_distinct(F.transform(F.filter(models, lambda m: m.contains("/")), lambda m: F.split(m, "/")[0]))
    return F.when(F.size(vendors) == 1, vendors[0]).otherwise("mixed")


def improvement_label(pct: Column) -> Column:
    number = F.format_string("%.1f", pct)
    return F.when(pct > 1.0, F.concat(F.lit("(+) +"), number, F.lit("%"))).when(pct < -0.5, F.concat(F.lit("(-) "), number, F.lit("%"))).otherwise(F.concat(F.lit("(=) "), F.format_string("%+.1f", pct), F.lit("%")))


def short_name(name: Column, longest: int = 26) -> Column:
    return F.when(F.length(name) <= longest, name).otherwise(F.concat(F.substring(name, 1, longest - 1), F.lit("…")))


def relative_improvement(best: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.when(best > 0, 100.0).otherwise(0.0)).otherwise((best - baseline) / baseline * 100)


def effect_size_label(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.5, "large").when(F.abs(r) >= 0.3, "medium").otherwise("small")
