"""Scores of a work as column expressions: venue, authors, impact, velocity, recency, relevance, and their weighting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bigrams, spaced_tokens, tokens

KEYS = ("venue", "authors", "impact", "velocity", "recency", "relevance")
REQUIRED = ("venue", "authors", "impact", "relevance")
QUARTILE_SCORES = {"Q1": 1.0, "Q2": 0.7, "Q3": 0.4, "Q4": 0.2}
#: Weight of a matched word, and of a matched word pair, in each field of a work.
FIELD_WEIGHTS = {"title": (3.0, 1.5), "abstract": (1.0, 0.5), "concepts": (2.0, 1.0)}
FLOOR = 0.05
GATE, GATE_LOW_WEIGHT, LOW_WEIGHT = 0.20, 0.06, 0.15


def half_up(value: Column, places: int = 6) -> Column:
    """Rounded half up; the same on every engine."""
    return F.floor(value * 10**places + 0.5) / 10**places


def venue_score(quartile: Column, journal: Column, is_preprint: Column) -> Column:
    """Preprints first, then works without a journal, then the journal's quartile; unknown ones are neutral."""
    known = reduce(lambda w, q: w.when(quartile == q, F.lit(QUARTILE_SCORES[q])), QUARTILE_SCORES, F.when(F.coalesce(is_preprint, F.lit(False)), 0.5).when(F.coalesce(journal, F.lit("")) == "", 0.3))
    return known.otherwise(0.5)


def authors_score(best_h: Column) -> Column:
    """From the highest known h-index of a work's authors; 0.3 if none is known."""
    return F.when(best_h.isNull(), 0.3).otherwise(F.least(F.ln(best_h + 1) / F.ln(F.lit(101.0)), F.lit(1.0)))


def best_h_index(authors: Column) -> Column:
    return F.array_max(F.transform(authors, lambda a: a["h_index"]))


def impact_score(citations: Column, year: Column, now: int) -> Column:
    age = F.greatest(now - year + 1, F.lit(1))
    return F.when((age <= 1) & (citations == 0), 0.5).otherwise(F.least(F.ln(citations / age + 1) / F.ln(F.lit(51.0)), F.lit(1.0)))


def velocity_score(citations: Column, year: Column, now: int) -> Column:
    age = F.greatest(now - year, F.lit(1))
    return F.when((age <= 1) & (citations == 0), 0.5).otherwise(F.least(citations / age / 20, F.lit(1.0)))


def recency_score(year: Column, now: int, half_life: float = 3.0) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) / half_life * F.greatest(now - year, F.lit(0)))


def _let(values: dict[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """``then`` of the values, each evaluated once a row, also where ``then`` uses it several times or inside lambdas."""
    bound = F.array(F.struct(*(c.alias(k) for k, c in values.items())))
    return F.get(F.transform(bound, lambda s: then({k: s[k] for k in values})), F.lit(0))


def _found(wanted: Column, spaced: Column) -> Column:
    """How many of the words or word pairs are in spaced_tokens()."""
    return F.size(F.filter(wanted, lambda x: F.contains(spaced, F.concat(F.lit(" "), x, F.lit(" ")))))


def relevance_score(topic: Column, title: Column, abstract: Column, concepts_text: Column) -> Column:
    """Share of the topic's words and word pairs found in each field, weighted by field; at least FLOOR.

    Works row by row, so the topic may be a literal or a joined column.
    """
    fields = {"title": title, "abstract": abstract, "concepts": concepts_text}

    def weighed(v: dict[str, Column]) -> Column:
        t, pairs = v["topic"], v["topic_pairs"]
        matched, paired, most, most_paired = [], [], 0.0, 0.0
        for name in fields:
            w, wb = FIELD_WEIGHTS[name]
            matched.append(_found(t, v[name]) / F.size(t) * w)
            paired.append(_found(pairs, v[name]) / F.size(pairs) * wb)
            most, most_paired = most + w, most_paired + wb
        words = reduce(lambda a, b: a + b, matched)
        both = words + reduce(lambda a, b: a + b, paired)
        return F.when(F.size(t) == 0, FLOOR).otherwise(F.greatest(F.when(F.size(t) > 1, both / (most + most_paired)).otherwise(words / most), F.lit(FLOOR)))

    own = {"topic": tokens(topic)} | {name: spaced_tokens(F.coalesce(field, F.lit(""))) for name, field in fields.items()}
    return _let(own, lambda v: _let(v | {"topic_pairs": bigrams(v["topic"])}, weighed))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_relevance(vector: Column, topic_vector: Column) -> Column:
    """Cosine of unit vectors, brought to 0..1; null where a vector is missing."""
    return F.when(vector.isNotNull() & topic_vector.isNotNull(), F.greatest((dot(vector, topic_vector) + 1) / 2, F.lit(FLOOR)))


def relevance_with_fallback(semantic: Column, keyword: Column) -> Column:
    return F.coalesce(semantic, keyword)


def final_score(prefix: str = "w_", suffix: str = "_score") -> Column:
    return reduce(lambda a, b: a + b, (F.col(f"{prefix}{k}") * F.col(f"{k}{suffix}") for k in KEYS))


def validate_weights(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of a weight table with columns w_<key>.

    Required keys must be there, none negative, not all zero; absent optional keys count 0; valid rows are
    divided by their total. Rejected rows keep their values and get a reason.
    """
    full = weights.withColumns({f"w_{k}": F.lit(None).cast("double") for k in KEYS if f"w_{k}" not in weights.columns})
    missing = reduce(lambda a, b: a | b, (F.col(f"w_{k}").isNull() for k in REQUIRED))
    negative = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"w_{k}") < 0, F.lit(False)) for k in KEYS))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"w_{k}"), F.lit(0.0)) for k in KEYS))
    judged = full.withColumn("reason", F.when(missing, "missing key").when(negative, "negative weight").when(total == 0, "all zero"))
    valid = judged.where("reason is null").drop("reason")
    return valid.withColumns({f"w_{k}": F.coalesce(F.col(f"w_{k}"), F.lit(0.0)) / total for k in KEYS}), judged.where("reason is not null")


def clip_and_normalise(columns: dict[str, Column]) -> dict[str, Column]:
    """Negative weights to 0, then divided by their total; uniform if the total is next to nothing."""
    clipped = {k: F.greatest(c, F.lit(0.0)) for k, c in columns.items()}
    total = reduce(lambda a, b: a + b, clipped.values())
    return {k: F.when(total < 1e-10, 1.0 / len(clipped)).otherwise(c / total) for k, c in clipped.items()}


def score_table(works: DataFrame, now: int) -> DataFrame:
    """Works with the six sub-scores. Needs best_h, quartile, journal_name, is_preprint, citation_count, year, title, abstract, concepts_text, topic."""
    return works.select(
        "*",
        venue_score(F.col("quartile"), F.col("journal_name"), F.col("is_preprint")).alias("venue_score"),
        authors_score(F.col("best_h")).alias("authors_score"),
        impact_score(F.col("citation_count"), F.col("year"), now).alias("impact_score"),
        velocity_score(F.col("citation_count"), F.col("year"), now).alias("velocity_score"),
        recency_score(F.col("year"), now).alias("recency_score"),
        relevance_score(F.col("topic"), F.col("title"), F.col("abstract"), F.col("concepts_text")).alias("relevance_score"),
    )


def weights_used() -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k in KEYS)), F.array(*(F.col(f"w_{k}") for k in KEYS)))


def gate_threshold(learned_relevance_weight: Column) -> Column:
    """Least relevance to be kept: lower where learned weights hardly look at relevance."""
    return F.when(learned_relevance_weight < LOW_WEIGHT, F.least(F.lit(GATE), F.lit(GATE_LOW_WEIGHT))).otherwise(GATE)
