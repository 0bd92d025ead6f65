"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Every 2-, 3- and 4-gram of a text's lower-cased letters (other characters count as one space) is
hashed to a row of an embedding table; a text is the mean of its rows, and a linear softmax gives
the languages. Table and softmax are trained together by stochastic gradient descent in numpy on
pieces of a bounded sample of labelled rows, cut out by Spark wherever they lie in a text, so that no
text travels whole. On the whole texts of a held-back part of that sample a temperature is fitted, and
the confidence below which a text is rejected is set so that it rejects a given small share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, within
from .ragged import LETTER, chunks, classes, codepoints, mix

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"
#: Bounds of the training sample: about so many rows of each language and of all; and the languages, those with the most rows.
SAMPLE_PER_LANGUAGE = 1_500
SAMPLE_ROWS = 60_000
MOST_LANGUAGES = 1_000
#: Pieces cut from each row of the sample, and their least and greatest length in characters.
PIECES, SHORTEST, LONGEST = 4, 20, 400
#: A small sample is gone through more often, until so many steps are made.
LEAST_STEPS = 600
#: Languages with fewer rows are learned from all of them: none is held back for calibration.
CALIBRATED_FROM = 50
#: Share of the calibration rows (all of known language) that may be rejected.
REJECTED_SHARE = 0.001


@lru_cache(1)
def _lower() -> np.ndarray:
    """For each code point: its lower case if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    kind = classes()
    out = np.where(kind == LETTER, points, 32).astype(np.uint32)
    for p in np.flatnonzero(kind == LETTER).tolist():
        low = chr(p).lower()
        if len(low) == 1:
            out[p] = ord(low)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each gram size the buckets in text order, the first bucket and the number of buckets of each text; which texts have a letter."""
    flat, cuts = codepoints(data, offsets)
    low = _lower()[flat]
    keep = np.ones(len(low), bool)  # runs of spaces become one
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[cuts[:-1][cuts[:-1] < len(low)]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    low, cuts = low[keep], sums[cuts]
    size = np.diff(cuts)
    letters = np.concatenate([[0], np.cumsum(low != 32)])
    grams = low.astype(np.uint64)  # the code points of a gram side by side, 21 bits each; the fourth is mixed in
    out = []
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        after = low[n - 1 :].astype(np.uint64)
        grams = grams[: len(after)]
        grams = (grams << np.uint64(21)) | after if n < 4 else mix(grams) + after
        bucket = (mix(grams) & np.uint64(BUCKETS - 1)).astype(np.int32)
        out.append((bucket, cuts[:-1], count))
    return out, letters[cuts[1:]] > letters[cuts[:-1]]


def averaged(table: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean row of ``table`` over the grams of each text."""
    total = np.zeros((len(grams[0][1]), table.shape[1]))
    n = np.zeros(len(total))
    for bucket, first, count in grams:
        if not len(bucket):
            continue
        full = np.flatnonzero(count)
        for c in range(table.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(table[:, c][bucket], dtype=np.float64)])
            total[full, c] += sums[first[full] + count[full]] - sums[first[full]]
        n += count
    return total / np.maximum(n, 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # the embeddings already multiplied by the softmax weights: a text's logits are their mean
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        grams, has_letter = features(data, offsets)
        if not self.languages:
            return [UNKNOWN] * len(has_letter), np.zeros(len(has_letter))
        logits = (averaged(self.table, grams) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist())], np.where(has_letter, p.max(axis=1), 0.0)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _buckets(texts: list[str]) -> list[np.ndarray]:
    grams, _ = features(*_flat(texts))
    return [np.concatenate([b[f[i] : f[i] + c[i]] for b, f, c in grams]) for i in range(len(texts))]


def train(rows: list[tuple[str, str]], seed: int = 7, dim: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.5) -> Model:
    """A model from (piece of text, language) rows, not calibrated yet."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    own, ys = [], []
    for at in range(0, len(rows), 500):
        own += _buckets([t for t, _ in rows[at : at + 500]])
        ys += [number[lang] for _, lang in rows[at : at + 500]]
    y = np.array(ys)
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(own)))
    steps, done = epochs * (-(-len(own) // batch)), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(own)), -(-len(own) // batch)):
            lr = rate * (1 - done / steps)
            done += 1
            part = part[[len(own[i]) > 0 for i in part]]
            if not len(part):
                continue
            n = np.array([len(own[i]) for i in part])
            flat = np.concatenate([own[i] for i in part])
            x = np.add.reduceat(table[flat], np.cumsum(n) - n, axis=0) / n[:, None]
            logits = x @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = ((p @ weights.T) / n[:, None]).astype(np.float32)
            weights -= lr * (x.T @ p) / len(part) * 8
            bias -= lr * p.mean(axis=0)
            order = np.argsort(flat, kind="stable")  # a bucket's steps are summed up first
            new = np.flatnonzero(np.diff(flat[order], prepend=-1))
            of = np.repeat(np.arange(len(part)), n)[order]
            table[flat[order[new]]] -= lr * np.add.reduceat(back[of], new, axis=0)
    return Model(languages, (table @ weights).astype(np.float32), bias, 1.0, 0.0)


def calibrate(model: Model, logits: np.ndarray, truth: np.ndarray) -> None:
    """Set temperature and rejection limit by the logits of texts of known language (numbers) that training hasn't seen."""
    if not len(truth):
        return
    top = logits - logits.max(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(np.mean(np.log(np.exp(top / t).sum(axis=1)) - top[np.arange(len(truth)), truth] / t))

    model.temperature = min(np.geomspace(0.05, 10, 60).tolist(), key=loss)
    p = np.exp(top / model.temperature)
    # below half, a language isn't even likelier than all others together
    model.reject_below = float(min(np.quantile((p / p.sum(axis=1, keepdims=True)).max(axis=1), REJECTED_SHARE), 0.5))


def held_out(id_col: str = "doc_id", parts: int = 5):
    return F.crc32(F.col(id_col).cast("string")) % parts == 0


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, key, lang, text, calibrates): about SAMPLE_PER_LANGUAGE rows of each language, none of them held out.

    A row is in the sample if the hash of its id and text is below its language's limit, wherever it lies and
    whatever else is there: no task and no window sees more than its share. Rows alike in both are in it together.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    n = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(1, len(sizes)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in sizes], f"lang {known.schema['lang'].dataType.simpleString()}, size long")
    chosen = known.join(F.broadcast(limits), "lang").where(spread("id", "text") < within(n, F.col("size")))  # MOST_LANGUAGES rows at most
    keyed = chosen.withColumn("key", F.xxhash64("id", "text"))
    return keyed.select("id", "key", "lang", "text", ((F.col("size") >= CALIBRATED_FROM) & (F.pmod(F.shiftright("key", 40), F.lit(5)) == 0)).alias("calibrates"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on pieces of about SAMPLE_PER_LANGUAGE rows of each language, and calibrate on the whole texts of others.

    The sample is by a hash of id and text, so it is the same however the table is partitioned. Rows with a
    null text, language or id are not in it; texts of any length are. Repeated rows count once.
    """
    rows = sampled(docs, id_col, text_col, lang_col)
    pieces = []
    for k in range(PIECES):
        n = SHORTEST + F.pmod(F.xxhash64("key", F.lit(2 * k)), F.lit(LONGEST - SHORTEST))
        at = F.pmod(F.xxhash64("key", F.lit(2 * k + 1)), F.greatest(F.lit(1), F.length("text") - n + 1))
        pieces.append(F.substring(F.col("text"), (at + 1).cast("int"), n.cast("int")))
    few = rows.where(~F.col("calibrates")).select("id", "key", "lang", F.array(*pieces).alias("pieces")).dropDuplicates(["id", "key", "lang"])
    got = sorted(few.collect(), key=lambda r: (r.key, r.id, r.lang))  # short pieces of a bounded number of rows
    model = train([(p, r.lang) for r in got for p in r.pieces])
    if not model.languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = {lang: i for i, lang in enumerate(model.languages)}
    schema = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("logits", pa.list_(pa.float64()))])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in chunks(batches, "text", 2 << 20):
            grams, has_letter = features(data, offsets)
            y = [number.get(lang, -1) for lang in rows.column(1).to_pylist()]
            use = np.flatnonzero(has_letter & (np.array(y) >= 0))
            logits = (averaged(own.table, grams) + own.bias)[use]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(use)), pa.array([y[i] for i in use], pa.int32()), pa.array(list(logits), pa.list_(pa.float64()))], schema=schema)

    seen = rows.where("calibrates").select("key", "lang", "text").mapInArrow(measure, "key long, y int, logits array<double>").dropDuplicates(["key", "y"]).collect()
    seen.sort(key=lambda r: (r.key, r.y))
    if seen:
        calibrate(model, np.array([r.logits for r in seen]), np.array([r.y for r in seen]))
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row, by its whole text.

    lang_pred is ``und`` with score 0, and rejected, where the text is null or has no letter. A text
    whose score is below the model's limit is rejected too but keeps its likeliest language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in chunks(batches, "text", 2 << 20):
            lang, score = own.predict(data, offsets)
            lost = (score < own.reject_below) | np.array([x == UNKNOWN for x in lang], bool)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(lost)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in chunks(batches, text_col, 2 << 20):
            lang, score = own.predict(data, offsets)
            yield rows.filter(pa.array([x != UNKNOWN and s >= own.reject_below for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
