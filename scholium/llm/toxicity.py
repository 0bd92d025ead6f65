"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Token scores are log-odds of a token's presence in toxic and in clean labelled texts under a
Dirichlet prior proportional to overall use; tokens whose log-odds isn't significant count as neutral, and a small
drift makes the walk over a clean text fall. A linear-time scan finds every maximal-scoring segment
of a text. Its score S becomes a significance by the extreme-value law of such walks,
P(best >= S) = 1 - exp(-K n exp(-lambda S)) for n words; a text's evidence is the sum of the
significant segments' normalised scores lambda S - ln(K n), and a logistic curve fitted on labelled
texts by token scores that haven't seen them turns it into a score between 0 and 1.

A token is a run of letters, lower-cased; a rare word falls back on its first letters, so that
inflected forms share their evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread, stored, sweep, within
from .language_id import _lower
from .ragged import chunks, codepoints, owners, slice_hashes, spans

#: Bound of the training sample: about so many labelled rows of each class. The model has all significant tokens of it.
SAMPLE_PER_CLASS = 10_000
PREFIX = 5
#: Dirichlet prior on the numbers of texts with a token: in all, and the least for one token.
PRIOR = 1_000.0
LEAST_PRIOR = 0.5
LEAST_Z = 3.0
DRIFT = 0.1
PREDICT_FROM = 0.7


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, hashes of their beginnings (0 for short words), and each text's first word."""
    flat, cuts = codepoints(data, offsets)
    low = _lower()[flat]
    starts, ends = spans(low != 32, cuts)
    whole, _ = slice_hashes(low, starts, ends)
    long = ends - starts > PREFIX
    begin = np.zeros(len(starts), np.uint64)
    begin[long] = slice_hashes(low, starts[long], starts[long] + PREFIX)[1]
    return whole, begin, np.searchsorted(starts, cuts)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa, 1999)."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    up = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], up.astype(np.int8), [0]])))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # for each: the nearest one to the left whose sum before is lower, or -1
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = sums[start], sums[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                back.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(s, e, float(b - a)) for s, e, a, b in found]


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes, of words and of beginnings
    scores: np.ndarray
    lam: float
    k: float
    slope: float
    offset: float

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each word, and each text's first word."""
        whole, begin, first = words(data, offsets)
        out = np.full(len(whole), -DRIFT)
        if len(self.tokens):
            for hashes in (begin, whole):  # a word's own evidence replaces that of its beginning
                at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
                hit = self.tokens[at] == hashes
                out[hit] = self.scores[at[hit]]
        return out, first

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments as (first word, word after, normalised score)."""
        n = max(1, len(scores))
        return [(s, e, x) for s, e, raw in segments(scores) if (x := self.lam * raw - np.log(self.k * n)) > 0]

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.offset)))


def _evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float]]]:
    scores, first = model.walk(data, offsets)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
    for i in np.unique(owners(np.flatnonzero(scores > 0), first)).tolist() if len(scores) else []:
        out[i] = model.passages(scores[first[i] : first[i + 1]])
    return out


def held_out(id_col: str = "doc_id", parts: int = 3):
    return F.crc32(F.col(id_col).cast("string")) % parts == 1


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, key, y, text) of about SAMPLE_PER_CLASS labelled rows of either class, none of them held out, stored.

    A row is in the sample if the hash of its id and text is below its class's limit; only ids and hashes meet
    the labels. Rows alike in both count once.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    keyed = texts.withColumns({"key": F.xxhash64("id", "text"), "at": spread("id", "text")})
    labelled = keyed.select("id", "key", "at").join(known, "id")
    sizes = {r["y"]: r["count"] for r in labelled.groupBy((F.col("y") == 1).cast("int").alias("y")).count().collect()}
    limit = F.when(F.col("y") == 1, within(SAMPLE_PER_CLASS, max(1, sizes.get(1, 0)))).otherwise(within(SAMPLE_PER_CLASS, max(1, sizes.get(0, 0))))
    chosen = labelled.where(F.col("at") < limit).select("id", "key", "y").distinct()
    return materialize(texts.withColumn("key", F.xxhash64("id", "text")).join(F.broadcast(chosen), ["id", "key"]).dropDuplicates(["id", "key"]), "toxicity-sample")  # about two classes' rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about SAMPLE_PER_CLASS labelled rows of either class, none of them held out, by their whole texts.

    The sample is halved by a hash of id and text. Token scores come from all of it; the extreme-value constant and
    the logistic curve come from either half by the scores of the other. Null ids, texts and labels are left out,
    repeated rows count once; an id with several labels counts as toxic if one of them says so. Without rows of both
    classes every score is 0.5 or less.
    """
    spark, before = docs.sparkSession, stored()
    sample = sampled(docs, labels, id_col, text_col, label_col).withColumn("half", F.pmod(F.shiftright("key", 40), F.lit(2)).cast("int"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("half", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64()), ("used", pa.int64())])
        for rows, data, offsets in chunks(batches, "text"):
            whole, begin, first = words(data, offsets)
            doc = np.repeat(np.arange(len(rows)), np.diff(first))
            y, half = (np.array(rows.column(i).to_pylist(), np.int64) for i in (0, 1))
            pair = np.stack([np.concatenate([whole, begin[begin > 0]]), np.concatenate([doc, doc[begin > 0]]).astype(np.uint64)], axis=1)
            pair, uses = np.unique(pair, axis=0, return_counts=True)
            of_doc = pair[:, 1].astype(np.int64)
            toxic = y[of_doc] == 1
            key, of = np.unique(np.stack([pair[:, 0], half[of_doc].astype(np.uint64)], axis=1), axis=0, return_inverse=True)
            t = np.bincount(of, weights=toxic, minlength=len(key)).astype(np.int64)
            used = np.bincount(of, weights=uses * ~toxic, minlength=len(key)).astype(np.int64)
            columns = (np.ascontiguousarray(key[:, 0]).view(np.int64), key[:, 1].astype(np.int32), t, np.bincount(of, minlength=len(key)) - t, used)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    halves = sample.select("y", "half", "text").mapInArrow(count, "h long, half int, toxic long, clean long, used long")
    #: Which rows of the sample a model's scores come from: one half, the other, all.
    parts = {"a": F.col("half") == 0, "b": F.col("half") == 1, "all": F.lit(True)}
    named = [f"{c}_{p}" for p in parts for c in ("toxic", "clean", "used")]
    counts = materialize(halves.groupBy("h").agg(*(F.sum(F.when(own, F.col(c)).otherwise(0)).alias(f"{c}_{p}") for p, own in parts.items() for c in ("toxic", "clean", "used"))), "toxicity-counts")
    totals = {c: float(x or 0) for c, x in counts.agg(*(F.sum(c).alias(c) for c in named)).first().asDict().items()}
    if any(not totals[f"{c}_{p}"] for p in parts for c in ("toxic", "clean")):
        sweep(spark, [p for p in stored() if p not in before])
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 1.0, -3.0)

    def scored(p: str) -> Model:
        n1, n0, used = (totals[f"{c}_{p}"] for c in ("toxic", "clean", "used"))
        toxic, clean = F.col(f"toxic_{p}"), F.col(f"clean_{p}")
        prior = LEAST_PRIOR + (toxic + clean) * (PRIOR / (n1 + n0))
        odds = lambda c, n: F.log((c + prior) / (n + PRIOR - c - prior))
        table = counts.where(toxic + clean > 0).select("h", F.col(f"used_{p}").alias("used"), (odds(toxic, n1) - odds(clean, n0)).alias("delta"), F.sqrt(1 / (toxic + prior) + 1 / (clean + prior)).alias("sd"))
        rows = table.where(F.abs("delta") >= LEAST_Z * F.col("sd")).toPandas()  # the significant tokens of a bounded sample
        rows = rows.assign(u=rows.h.to_numpy().view(np.uint64)).sort_values("u")
        scores = rows.delta.to_numpy() - DRIFT
        # lambda: the positive root of E[exp(lambda s)] = 1 over the words of clean texts
        share = (rows.used.to_numpy() + LEAST_PRIOR) / (used + PRIOR)
        rest = max(0.0, 1 - share.sum())
        low, high = 1e-3, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            grown = float((share * np.exp(np.minimum(mid * scores, 600))).sum()) + rest * np.exp(-mid * DRIFT)
            low, high = (mid, high) if grown < 1 else (low, mid)
        return Model(rows.u.to_numpy(), scores, low, 1.0, 1.0, -3.0)

    model = scored("all")
    shared = spark.sparkContext.broadcast({0: scored("b"), 1: scored("a")})  # a half by the scores of the other

    def measure(batches: Iterable[pa.RecordBatch], k: float | None = None) -> Iterator[pa.RecordBatch]:
        """For each text its number of words and its best segment's score times lambda, or with k its evidence."""
        schema = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("x", pa.float64())])
        for rows, data, offsets in chunks(batches, "text"):
            x: list[float] = []
            for i, half in enumerate(rows.column(2).to_pylist()):
                own = shared.value[half]
                scores, _ = own.walk(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                found = own.lam * np.array([s for *_, s in segments(scores)])
                x.append(float(found.max(initial=0.0) if k is None else np.maximum(0.0, found - np.log(k * max(1, len(scores)))).sum()))
            _, _, first = words(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(first)), pa.array(x, pa.float64())], schema=schema)

    def measured(k: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sample.select("key", "y", "half", "text")
        seen = rows.mapInArrow(lambda it: measure(it, k), "key long, y int, n long, x double").toPandas().sort_values(["key", "y"])
        return seen.y.to_numpy(float), np.maximum(1, seen.n.to_numpy(float)), seen.x.to_numpy(float)

    y, n, best = measured()
    if (y == 0).any():
        model.k = float(np.clip((y == 0).sum() / np.sum((n * np.exp(-best))[y == 0]), 1e-6, 1.0))
    x = np.log1p(measured(model.k)[2])
    w = np.array([1.0, -3.0])
    a = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):  # Newton steps; a slight ridge keeps separable data finite
        q = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (q - y) + 0.01 * w
        w = w - np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 0.01 * np.eye(2), g)
    sweep(spark, [p for p in stored() if p not in before])
    model.slope, model.offset = (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, -3.0)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, passages) for each row, by its whole text.

    passages: the significant segments as words [first, after) with their normalised score. A null or
    empty text has none and the lowest score. Repeated rows and null ids get a result like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    piece = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(piece))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in chunks(batches, "text", 2 << 20):
            found = _evidence(own, data, offsets)
            chance = own.chance(np.array([sum(x for _, _, x in f) for f in found], float))
            listed = [[{"first": s, "after": e, "score": x} for s, e, x in f] for f in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(chance), pa.array((chance >= PREDICT_FROM).astype(np.int32)), pa.array(listed, pa.list_(piece))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int, passages array<struct<first:int,after:int,score:double>>")
