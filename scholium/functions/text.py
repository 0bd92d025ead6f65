"""Text as columns: tokens, word pairs, slugs, overlap scores, and parsing of model responses."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The words that don't count.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might must shall can this that these those as if then than so very"
).split()
#: Words in the title of a survey.
SURVEY_WORDS = "survey review overview systematic comprehensive literature taxonomy tutorial benchmark roadmap".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def spaced_tokens(text: Column) -> Column:
    """tokens() as one string, a space before, between and after them: what is among them, or side by side, can be looked up without a list."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def bigrams(words: Column) -> Column:
    """Neighbouring tokens joined by a space; empty for fewer than two."""
    shorter = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(shorter, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def work_text(title: Column, abstract: Column, concepts: Column) -> Column:
    return F.concat_ws(" ", title, abstract, F.when(F.size(concepts) > 0, F.array_join(concepts, " ")))


def slug(topic: Column) -> Column:
    made = F.trim(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(made == "", "unknown_topic").otherwise(made)


def normalise_issn(issn: Column) -> Column:
    return F.regexp_replace(issn, "[- ]", "")


def is_survey_like(title: Column) -> Column:
    return F.lower(title).rlike("|".join(SURVEY_WORDS))


# --- overlap of generated and reference texts


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _overlap_f1(a: Column, b: Column) -> Column:
    """F1 of the multiset overlap, row by row: both are sorted and walked side by side, in steps of one item."""

    def walk(z: Column) -> Column:
        steps = F.size(z["a"]) + F.size(z["b"])

        def step(s: Column, _: Column) -> Column:
            x, y = F.get(z["a"], s["i"]), F.get(z["b"], s["j"])  # null beyond the end: nothing moves any more
            one = lambda c: F.when(c, 1).otherwise(0)
            return F.struct((s["i"] + one(x <= y)).alias("i"), (s["j"] + one(y <= x)).alias("j"), (s["n"] + one(x == y)).alias("n"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        shared = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["n"])
        return F.when((F.size(z["a"]) == 0) | (F.size(z["b"]) == 0), 0.0).otherwise(_f1(shared, F.size(z["a"]), F.size(z["b"])))

    sides = F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b"))
    return F.element_at(F.transform(F.array(sides), walk), 1)  # bound once: inside, both are at hand as values


def _f1(shared: Column, of_a: Column, of_b: Column) -> Column:
    return F.when(shared == 0, 0.0).otherwise(2 * (shared / of_a) * (shared / of_b) / (shared / of_a + shared / of_b))


def rouge_1(generated: Column, reference: Column) -> Column:
    return _round4(_overlap_f1(rouge_tokens(generated), rouge_tokens(reference)))


def rouge_2(generated: Column, reference: Column) -> Column:
    return _round4(_overlap_f1(bigrams(rouge_tokens(generated)), bigrams(rouge_tokens(reference))))


def _round4(x: Column) -> Column:
    return F.floor(x * 1e4 + 0.5) / 1e4


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence of two space-joined token lists, by bit-parallel rows."""
    x, y = a.split(), b.split()
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        m = row & places.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(x) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(p, q) for p, q in zip(a, b)], dtype="int32")


def rouge_l(generated: Column, reference: Column) -> Column:
    a, b = rouge_tokens(generated), rouge_tokens(reference)
    n = lcs_length(F.array_join(a, " "), F.array_join(b, " "))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (n == 0), 0.0).otherwise(_round4(2.0 * n / (F.size(a) + F.size(b))))


# --- responses


def response_json(raw: Column) -> Column:
    """The outermost {...} of a response, without thinking blocks and code fences; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


# --- probability

#: The rational approximation of the normal distribution's tail (Hart, 1968; West, 2005), highest power first.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_TO, TAIL_FAR, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to some 14 digits; null for null."""
    x = F.abs(z)
    horner = lambda cs: reduce(lambda a, c: a * x + F.lit(c), cs[1:], F.lit(cs[0]))
    near = F.exp(-x * x / 2) * horner(TAIL_ABOVE) / horner(TAIL_BELOW)
    far = F.exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / ROOT_TWO_PI
    upper = F.when(x > TAIL_FAR, 0.0).when(x < TAIL_TO, near).otherwise(far)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z > 0, upper).otherwise(1 - upper)
