"""How filters of documents interact: what every order of them removes, step by step.

Spark reduces all documents to counts by part and mask, a mask being the set of filters that a document fails. The rest is
matrix work on those counts. M holds 0 where mask m fails filter f and infinity elsewhere, P the position of f in order p
(the inverse permutation); their min-plus product (M * P)[m, p] = min over f of M[m, f] + P[p, f] is the step at which
order p removes mask m. A scatter of counts by that step gives what each step removes, and a document is redundant at
a later step whose filter it fails too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recompression import _LOWEST

#: Filters that look at a text alone, by letter; the duplicate filter comes after them.
WORDS, VARIETY, CAPITALS, SYMBOLS, COPY = "ABCDE"
LEAST_WORDS, LEAST_VARIETY, MOST_CAPITALS, SYMBOL_CLASS = 100, 80, 10, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """For each letter whether a text fails: too few words, too few distinct ones, too many capitals, a symbol."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        WORDS: F.size(words) < LEAST_WORDS,
        VARIETY: F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_VARIETY,
        CAPITALS: capitals.cast("long") * 100 > F.char_length(text).cast("long") * MOST_CAPITALS,
        SYMBOLS: text.rlike(SYMBOL_CLASS),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents by part and by the filters they fail, bit i for the i-th letter.

    A null text is empty, a null part the empty string, a null id the smallest. A document is a copy if its text equals (by SHA-256)
    that of a smaller id in the whole table; rows that share an id and a text aren't copies of each other. An id with several
    labels has each that one of them gives. Only ids, hashes and counts are shuffled, and equal rows are counted in
    each task before that, so a text that a third of the rows share costs a row a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = text_failures(F.col("t"))
    mask = sum((F.shiftleft(f.cast("int"), i) for i, f in enumerate(fails.values())), F.lit(0))
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = read.select("id", "part", F.unhex(F.sha2("t", 256)).alias("same"), mask.alias("mask")).groupBy("id", "part", "same", "mask").count()
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    judged = rows.join(known, "id", "left").select("id", "part", "same", "mask", "count", zero("good"), zero("toxic"))
    # of each kind of row: how many there are, the smallest id, and how many rows have it
    kinds = judged.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("count").alias("n"), F.min("id").alias("low"), F.min_by("count", "id").alias("first"))
    # a text has a row for each part and label here, not one for each document
    first = F.when(F.col("low") == F.min("low").over(Window.partitionBy("same")), F.col("first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("__first").alias("n")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("n") - F.col("__first")).alias("n"))))
    both = kinds.withColumn("__first", first).select("part", "good", "toxic", split.alias("s")).where("s.n > 0")
    return both.groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product: for each mask and order the position of the first filter that the mask fails, and as many as there are filters if none.

    ``masks`` is masks x filters (true: fails), ``positions`` orders x filters.
    """
    n = positions.shape[1]
    cost = np.where(masks, 0, n)
    out = np.full((len(masks), len(positions)), n)
    for f in range(n):
        np.minimum(out, cost[:, f, None] + positions[None, :, f], out=out)
    return out


def audit(counts: DataFrame, letters: str = WORDS + VARIETY + CAPITALS + SYMBOLS + COPY) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part and order.

    ``counts`` is failure_counts(). A part has at most as many rows as there are masks, so parts are worked on
    independently in tasks; without rows there are no parts. There are as many orders as permutations of the letters.
    """
    k = len(letters)
    orders = np.array(list(permutations(range(k))))
    names = ["".join(letters[f] for f in order) for order in orders]
    positions = np.argsort(orders, axis=1)
    fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 == 1
    step = removal_steps(fails, positions)  # masks x orders
    n_orders = len(orders)
    places = np.arange(n_orders)[None, :]
    again = fails[:, orders] & (step[:, :, None] < np.arange(k))  # masks x orders x steps: fails what stands there, removed before
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weight = np.zeros((3, 1 << k), np.int64)
                for row in seen:
                    weight[:, row["mask"]] = row["n"], row["good"], row["toxic"]
                lost = np.zeros((3, n_orders, k + 1), np.int64)
                for out, w in zip(lost, weight):
                    np.add.at(out, (np.broadcast_to(places, step.shape), step), np.broadcast_to(w[:, None], step.shape))
                removed, good, toxic = lost[:, :, :k]
                share = np.zeros(k, np.int64)
                np.add.at(share, orders, removed)
                values = (weight[0].sum() - removed.cumsum(axis=1), removed, np.einsum("m,mps->ps", weight[0], again), weight[0][1 << orders], good, toxic, share[orders])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (n_orders * k)), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n_orders)), *(pa.array(v.ravel()) for v in values)],
                    names=["part", "filter_order", "step", *columns],
                )

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))
