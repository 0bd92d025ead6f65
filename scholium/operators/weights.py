"""Weight vectors applied to sub-scores, and the parallel search for the best one in each domain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import KEYS
from ..functions.generation import relative_improvement
from ..sources.shared import scratch, ship
from .metrics import gain, ideal

LOW, HIGH = 0.05, 0.60
#: Candidates are broadcast to every task, in blocks of at most so many rows of six numbers.
MOST_CANDIDATES = 10_000


def _weighted(scores: DataFrame) -> DataFrame:
    score = reduce(lambda a, b: a + b, (F.col(f"w_{k}") * F.col(f"{k}_score") for k in KEYS))
    return scores.withColumn("score", F.floor(score * 1e9 + 0.5) / 1e9)


def _blocks(vectors: DataFrame) -> list[DataFrame]:
    """All rows of ``vectors`` in tables of about MOST_CANDIDATES, dealt by a hash of their content."""
    n = -(-vectors.count() // MOST_CANDIDATES)
    if n <= 1:
        return [vectors]
    placed = vectors.withColumn("__block", F.pmod(F.xxhash64(*vectors.columns), F.lit(n)))
    return [placed.where(F.col("__block") == i).drop("__block") for i in range(n)]


def apply_weights(scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """(domain_id, method, article_id, score): every method's vector on every work of its domain.

    ``vectors`` has (method, w_<key>) and, if vectors differ by domain, domain_id. They are broadcast in
    blocks of MOST_CANDIDATES, so that works stay where they are, however many a domain has.
    """
    cols = [f"w_{k}" for k in KEYS]
    narrow = scores.select("domain_id", F.col("id").alias("article_id"), *(f"{k}_score" for k in KEYS))
    own = ["domain_id"] if "domain_id" in vectors.columns else []
    blocks = _blocks(vectors.select(*own, "method", *cols))
    joined = reduce(DataFrame.union, (narrow.join(F.broadcast(v), own) if own else narrow.crossJoin(F.broadcast(v)) for v in blocks))
    return _weighted(joined).select("domain_id", "method", "article_id", "score")


#: Works and candidates that are multiplied at once, and numbers that a task keeps before it hands its best rows on.
BLOCK_WORKS, BLOCK_CANDIDATES, KEEP = 8_192, 512, 4_000_000
_UNKNOWN = -(2**42)  # stands for a null score: after all others


def _best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column the k largest entries and their rows, largest first, equal ones in row order.

    Entry and row are packed into one integer, so that one partition of each column settles ties as well.
    """
    m = len(scores)
    packed = scores * m + np.arange(m - 1, -1, -1)[:, None]
    if m > k:
        packed = np.partition(packed, m - k, axis=0)[m - k :]
    packed = -np.sort(-packed, axis=0)
    return packed // m, m - 1 - packed % m


def _products(features: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of all rows under all vectors in billionths, rounded half up; keys are added in order, as Spark's expression does."""
    out = np.zeros((len(features), len(vectors)))
    for j in range(features.shape[1]):
        out += features[:, j, None] * vectors[None, :, j]
    low = np.floor(out * 1e9 + 0.5)
    return np.where(np.isnan(low), _UNKNOWN, np.clip(low, _UNKNOWN, -_UNKNOWN)).astype(np.int64)


def top_rows(scores: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(domain_id, method, article_id, score, rank): the k best works of each domain under every vector, ties by article_id.

    The same as ranking apply_weights(), but no row is made for a work and a vector: a task multiplies blocks of works
    by all vectors of a broadcast block and keeps k rows of each (domain, vector), so that what is shuffled and sorted grows with
    tasks x vectors x k. A task whose kept rows exceed KEEP numbers (very many domains) hands them on and starts anew.
    Scores lie within +-4,398; null scores come last.
    """
    cols = [f"w_{key}" for key in KEYS]
    own = ["domain_id"] if "domain_id" in vectors.columns else []
    narrow = scores.select("domain_id", F.col("id").alias("article_id"), *(f"{key}_score" for key in KEYS))
    id_type = narrow.schema["article_id"].dataType.simpleString()
    domain_type = narrow.schema["domain_id"].dataType.simpleString()
    spark = scores.sparkSession
    ship(spark)

    def of(block: DataFrame) -> DataFrame:
        table = block.toPandas()  # at most about MOST_CANDIDATES rows
        if own:
            groups = {key: (part["method"].to_numpy(object), part[cols].to_numpy(float)) for key, part in table.groupby("domain_id")}
        else:
            groups = None
        shared = spark.sparkContext.broadcast((groups, table["method"].to_numpy(object), table[cols].to_numpy(float)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_domain, methods, matrix = shared.value
            kept: dict = {}  # domain: scores and ids, k x vectors each
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                for domain, (best, ids) in kept.items():
                    names = methods if by_domain is None else by_domain[domain][0]
                    score = best.ravel(order="F") / 1e9
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([domain] * best.size, kinds[0]), pa.array(np.repeat(names, len(best)), pa.string()), pa.array(ids.ravel(order="F"), kinds[1]), pa.array(score, mask=best.ravel(order="F") == _UNKNOWN)],
                        names=["domain_id", "method", "article_id", "score"],
                    )

            kinds: tuple = ()
            for batch in batches:
                kinds = kinds or (batch.schema.field(0).type, batch.schema.field(1).type)
                for at in range(0, batch.num_rows, BLOCK_WORKS):
                    part = batch.slice(at, BLOCK_WORKS).to_pandas().sort_values(["domain_id", "article_id"], kind="stable")
                    for domain, rows in part.groupby("domain_id", sort=False):
                        if by_domain is not None and domain not in by_domain:
                            continue
                        x, ids = rows.iloc[:, 2:].to_numpy(float), rows["article_id"].to_numpy()
                        w = matrix if by_domain is None else by_domain[domain][1]
                        found = []
                        for c in range(0, len(w), BLOCK_CANDIDATES):
                            best, row = _best_rows(_products(x, w[c : c + BLOCK_CANDIDATES]), k)
                            found.append((best, ids[row]))
                        best, own_ids = (np.concatenate(parts, axis=1) for parts in zip(*found))
                        if domain in kept:
                            size -= kept[domain][0].size
                            best, own_ids = np.concatenate([kept[domain][0], best]), np.concatenate([kept[domain][1], own_ids])
                            order = np.argsort(own_ids, axis=0, kind="stable")
                            best, own_ids = np.take_along_axis(best, order, 0), np.take_along_axis(own_ids, order, 0)
                            best, row = _best_rows(best, k)
                            own_ids = np.take_along_axis(own_ids, row, 0)
                        kept[domain] = best, own_ids
                        size += best.size
                    if size > KEEP:
                        yield from out()
                        kept.clear()
                        size = 0
            yield from out()

        return narrow.mapInArrow(run, f"domain_id {domain_type}, method string, article_id {id_type}, score double")

    found = reduce(DataFrame.union, map(of, _blocks(vectors.select(*own, "method", *cols))))
    place = F.row_number().over(Window.partitionBy("domain_id", "method").orderBy(F.desc("score"), "article_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ndcg(scores: DataFrame, vectors: DataFrame, gold: DataFrame, k: int = 15) -> DataFrame:
    """(domain_id, method, ndcg15) of each vector, from the k best works under it."""
    graded = top_rows(scores, vectors, k).join(gold.select("domain_id", "article_id", "grade"), ["domain_id", "article_id"], "left")
    term = F.struct("rank", (gain(F.coalesce("grade", F.lit(0))) / F.log2(F.col("rank") + 1)).alias("x"))
    # k terms, added in the order of their ranks: equal rankings get equal sums, to the last bit
    dcg = graded.groupBy("domain_id", "method").agg(F.aggregate(F.sort_array(F.collect_list(term)), F.lit(0.0), lambda s, t: s + t["x"]).alias("dcg"))
    top = ideal(gold, (k,))
    return dcg.join(top, "domain_id", "left").select("domain_id", "method", F.when(F.coalesce(f"idcg{k}", F.lit(0.0)) == 0, 0.0).otherwise(F.col("dcg") / F.col(f"idcg{k}")).alias("ndcg15"))


def grid(spark: SparkSession) -> DataFrame:
    """A fixed set of candidates: each key in turn high, the rest even; each pair of keys high; and all even."""
    rows = []
    for i, a in enumerate(KEYS):
        rows.append((f"one_{a}", *[HIGH if j == i else 0.08 for j in range(6)]))
        for j in range(i + 1, 6):
            rows.append((f"two_{a}_{KEYS[j]}", *[0.35 if m in (i, j) else 0.075 for m in range(6)]))
    rows.append(("even", *[1 / 6] * 6))
    return spark.createDataFrame(rows, "method string, " + ", ".join(f"w_{k} double" for k in KEYS))


#: The fractional parts of the square roots of the first six primes; multiples of them spread evenly.
STRIDES = (0.41421356237309515, 0.7320508075688772, 0.2360679774997898, 0.6457513110645907, 0.3166247903553998, 0.6055512754639891)


def _normal(raw: dict[str, Column]) -> list[Column]:
    total = reduce(lambda a, b: a + b, raw.values())
    return [(F.floor(c / total * 1e9 + 0.5) / 1e9).alias(f"w_{k}") for k, c in raw.items()]


def spread_candidates(spark: SparkSession, n: int) -> DataFrame:
    """n vectors spread evenly over [LOW, HIGH] in each weight before they are normalised: multiples of STRIDES, modulo 1."""
    i = F.col("id")
    raw = {k: LOW + (HIGH - LOW) * (i * F.lit(a) - F.floor(i * F.lit(a))) for k, a in zip(KEYS, STRIDES)}
    return spark.range(1, n + 1).select(F.concat(F.lit("r0_"), F.lpad(i.cast("string"), 5, "0")).alias("method"), *_normal(raw))


def near_candidates(best: DataFrame, n: int, round_: int, spread: float) -> DataFrame:
    """For each domain n vectors within ``spread`` of its best ones (domain_id, w_<key>), clipped to [LOW, HIGH]."""
    i = F.col("id") + n * round_
    around = best.select("domain_id", *(F.col(f"w_{k}").alias(f"b_{k}") for k in KEYS)).crossJoin(F.broadcast(best.sparkSession.range(1, n + 1)))  # n rows
    moved = {k: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col(f"b_{k}") + spread * (2 * (i * F.lit(a) - F.floor(i * F.lit(a))) - 1))) for k, a in zip(KEYS, STRIDES)}
    return around.select("domain_id", F.concat(F.lit(f"r{round_}_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("method"), *_normal(moved))


def best_of(results: DataFrame, baseline: str, least_gain_pct: float = 1.0) -> DataFrame:
    """Per domain: the best candidate (first by name on ties), baseline, improvement in percent, whether to save it."""
    order = F.struct(F.floor(F.col("ndcg15") * 1e9 + 0.5).alias("v"), F.col("n"))
    named = results.withColumn("n", -F.row_number().over(Window.partitionBy("domain_id").orderBy("method")))
    best = named.groupBy("domain_id").agg(F.max_by("method", order).alias("best_method"), F.max("ndcg15").alias("best"), F.max(F.when(F.col("method") == baseline, F.col("ndcg15"))).alias("baseline"))
    return best.withColumn("improvement_pct", relative_improvement(F.col("best"), F.col("baseline"))).withColumn("saved", F.col("improvement_pct") >= least_gain_pct)


def search(scores: DataFrame, gold: DataFrame, default: dict[str, float], n: int = 75, rounds: int = 2, spread: float = 0.1) -> DataFrame:
    """Population search for all domains at once: n candidates a round and domain, the first round's spread evenly, the
    others' near the domain's own best so far.

    Candidates of every round stay in the running, with the default as baseline. Returns best_of() with
    the winning weights. Sub-scores and each round's results are stored, so that later rounds don't compute them again.
    """
    spark = scores.sparkSession
    cols = [f"w_{k}" for k in KEYS]

    def stored(df: DataFrame, what: str) -> DataFrame:
        path = scratch(spark, what)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    narrow = stored(scores.select("domain_id", "id", *(f"{k}_score" for k in KEYS)), "sub-scores")
    base = spark.createDataFrame([("default", *(float(default[k]) for k in KEYS))], "method string, " + ", ".join(f"{c} double" for c in cols))
    first = base.union(spread_candidates(spark, n))
    pool = narrow.select("domain_id").distinct().crossJoin(F.broadcast(first))  # n + 1 rows are broadcast
    results = stored(ndcg(narrow, first, gold), "ndcg")
    for r in range(1, rounds):
        order = F.row_number().over(Window.partitionBy("domain_id").orderBy(F.desc(F.floor(F.col("ndcg15") * 1e9 + 0.5)), "method"))
        best = results.withColumn("__p", order).where("__p = 1").select("domain_id", "method").join(pool, ["domain_id", "method"])
        more = stored(near_candidates(best, n, r, spread), "candidates")
        results = results.union(stored(ndcg(narrow, more, gold), "ndcg"))
        pool = pool.union(more.select(pool.columns))
    return best_of(results, "default").join(pool.withColumnRenamed("method", "best_method"), ["domain_id", "best_method"])
