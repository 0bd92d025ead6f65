"""Predicting a domain's weights from other domains, each domain left out in turn.

Tables here have one row a domain (or fold, domain and key): their number doesn't grow with the works.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import KEYS, clip_and_normalise
from ..sources.shared import scratch
from .corpus_stats import FEATURES, unpivot

#: The features that predictors use.
SELECTED = ("grade2_ratio", "mean_h_index", "citation_median", "citation_gini", "pct_high_hindex", "pct_recent", "pct_high_cited")
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
MEMBERS = ("knn1", "knn2", "knn3", "bayes")
BLEND = tuple(round(0.1 * i, 1) for i in range(11))
W = [f"w_{k}" for k in KEYS]


def folds(domains: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(fold, domain_id, features, weights): each test domain with every other as training row. Domains are few."""
    test = domains.select(F.col("domain_id").alias("fold"))
    return test.join(domains, F.col("fold") != F.col("domain_id")).select("fold", "domain_id", *names, *W)


def _scaled(domains: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(fold, domain_id, is_test, x_<name>): features scaled to 0..1 by the fold's training domains only.

    A feature that is constant in training is shifted but not divided.
    """
    train = folds(domains, names)
    limits = train.groupBy("fold").agg(*(F.min(n).alias(f"lo_{n}") for n in names), *(F.max(n).alias(f"hi_{n}") for n in names))
    both = limits.join(domains.select("domain_id", *names, *W))
    x = lambda n: (F.col(n) - F.col(f"lo_{n}")) / F.when(F.col(f"hi_{n}") == F.col(f"lo_{n}"), 1.0).otherwise(F.col(f"hi_{n}") - F.col(f"lo_{n}"))
    return both.select("fold", "domain_id", (F.col("fold") == F.col("domain_id")).alias("is_test"), *(x(n).alias(f"x_{n}") for n in names), *W)


def distances(domains: DataFrame, names: tuple[str, ...] = SELECTED) -> DataFrame:
    """(fold, domain_id, distance, place, weights): training domains by Euclidean distance from the test domain."""
    s = _scaled(domains, names)
    test = s.where("is_test").select("fold", *(F.col(f"x_{n}").alias(f"t_{n}") for n in names))
    d = sum((F.pow(F.col(f"x_{n}") - F.col(f"t_{n}"), 2) for n in names), F.lit(0.0))
    far = s.where("not is_test").join(test, "fold").withColumn("distance", F.floor(F.sqrt(d) * 1e12 + 0.5) / 1e12)
    return far.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy("distance", "domain_id"))).select("fold", "domain_id", "distance", "place", *W)


def _normalised(table: DataFrame, method: str | None = None) -> DataFrame:
    cols = clip_and_normalise({w: F.col(w) for w in W})
    return table.select("fold", F.lit(method).alias("method") if method else F.col("method"), *(cols[w].alias(w) for w in W))


def knn(domains: DataFrame, k: int, names: tuple[str, ...] = SELECTED) -> DataFrame:
    """Inverse-distance mean of the k nearest domains' weights; an exact match's own."""
    near = distances(domains, names).where(F.col("place") <= k)
    least = F.min("distance").over(Window.partitionBy("fold"))
    share = F.when((F.lit(k) == 1) | (least < 1e-10), (F.col("place") == 1).cast("double")).otherwise(1 / (F.col("distance") + 1e-10))
    mean = near.withColumn("s", share).groupBy("fold").agg(*((F.sum(F.col("s") * F.col(w)) / F.sum("s")).alias(w) for w in W))
    return _normalised(mean, f"knn{k}")


def transfer_direct(domains: DataFrame) -> DataFrame:
    return _normalised(folds(domains, ()).groupBy("fold").agg(*(F.avg(w).alias(w) for w in W)), "transfer")


def _ridge(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[float, float, float]:
    """Prediction at t and the alpha with the least leave-one-out error; both centred."""
    mx, my = x.mean(axis=0), y.mean()
    a, b = x - mx, y - my
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    best = None
    for alpha in ALPHAS:
        shrink = s * s / (s * s + alpha)
        fitted = u @ (shrink * (u.T @ b))
        leverage = (u * u) @ shrink + 1 / len(y)
        error = float(np.mean(((b - fitted) / (1 - leverage)) ** 2))
        if best is None or error < best[0] - 1e-15:
            best = (error, alpha)
    w = vt.T @ ((s / (s * s + best[1])) * (u.T @ b))
    return float(my + (t - mx) @ w), best[1], 0.0


def _bayes(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[float, float, float]:
    """Ridge with both precisions from the evidence (MacKay, 1992)."""
    mx, my = x.mean(axis=0), y.mean()
    a, b = x - mx, y - my
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    e, n = s * s, len(y)
    noise, prior = 1 / (np.var(y) + 1e-12), 1.0
    w = np.zeros(x.shape[1])
    for _ in range(300):
        new = vt.T @ ((s / (e + prior / noise)) * (u.T @ b))
        gamma = float(np.sum(e * noise / (prior + e * noise)))
        rss = float(np.sum((b - a @ new) ** 2))
        prior = (gamma + 2e-6) / (float(new @ new) + 2e-6)
        noise = (n - gamma + 2e-6) / (rss + 2e-6)
        done = float(np.abs(new - w).sum()) < 1e-6
        w = new
        if done:
            break
    return float(my + (t - mx) @ w), prior / noise, 0.0


#: Bounds of the process's amplitude, length scale and noise, in logarithms, and the first start of the search.
GPR_LOW, GPR_HIGH, GPR_START = np.log([1e-3, 1e-2, 1e-5]), np.log([1e3, 10.0, 1.0]), np.log([1.0, 1.0, 0.1])
GPR_RESTARTS = 3


def _climb(f, x: np.ndarray, step: float = 1.0, least: float = 0.02, sweeps: int = 25) -> tuple[float, np.ndarray]:
    """A greatest value near x within the bounds, by steps along each axis that grow with success and shrink without."""
    best, steps = f(x), np.full(len(x), step)
    for _ in range(sweeps):
        if steps.max() <= least:
            break
        for j in range(len(x)):
            for sign in (1.0, -1.0):
                new = x.copy()
                new[j] = np.clip(new[j] + sign * steps[j], GPR_LOW[j], GPR_HIGH[j])
                value = f(new)
                if value > best + 1e-12:
                    best, x = value, new
                    steps[j] = min(2 * steps[j], 2.0)
                    break
            else:
                steps[j] /= 2
    return best, x


def _gauss(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[float, float, float]:
    """Gaussian process, constant times squared-exponential plus noise; the kernel with the greatest marginal likelihood
    that searches from the first start and from GPR_RESTARTS random ones find."""
    my = y.mean()
    b = y - my
    d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    dt = ((x - t) ** 2).sum(axis=-1)

    def parts(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        amplitude, length, noise = np.exp(theta)
        c = np.linalg.cholesky(amplitude * np.exp(-d / (2 * length**2)) + (noise + 1e-10) * np.eye(len(y)))
        return c, np.linalg.solve(c, b)

    def likelihood(theta: np.ndarray) -> float:
        c, z = parts(theta)
        return -0.5 * float(z @ z) - float(np.log(np.diag(c)).sum())

    rng = np.random.default_rng(42)
    starts = [GPR_START, *rng.uniform(GPR_LOW, GPR_HIGH, (GPR_RESTARTS, 3))]
    _, theta = max((_climb(likelihood, s) for s in starts), key=lambda r: r[0])
    _, theta = _climb(likelihood, theta, step=0.1, least=0.001, sweeps=400)  # the best one to the end: ridges are long and oblique
    c, z = parts(theta)
    amplitude, length, noise = np.exp(theta)
    v = np.linalg.solve(c, amplitude * np.exp(-dt / (2 * length**2)))
    return float(my + v @ z), float(length), float(np.sqrt(max(0.0, amplitude + noise - v @ v)))


def regressions(domains: DataFrame, names: tuple[str, ...] = SELECTED, methods: tuple[str, ...] = ("ridge", "bayes", "gpr")) -> DataFrame:
    """(fold, key, method, value, chosen, std): ridge, Bayesian ridge and Gaussian process for each key of each fold.

    Each fits deviations of a weight from the training mean (both are centred). chosen is ridge's alpha, the
    ratio of precisions, or the length scale; std the process's predictive deviation.
    """
    x = [f"x_{n}" for n in names]
    long = _scaled(domains, names).select("fold", "is_test", *x, F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"w_{k}").alias("w")) for k in KEYS))).alias("e")).select("fold", "is_test", *x, "e.key", "e.w")

    fits = {"ridge": _ridge, "bayes": _bayes, "gpr": _gauss}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        test = rows.is_test.to_numpy()
        train = rows[~test].sort_values(x)
        a, y, t = train[x].to_numpy(float), train.w.to_numpy(float), rows[test][x].to_numpy(float)[0]
        out = []
        for name in methods:
            value, chosen, std = fits[name](a, y, t)
            out.append((rows.fold.iloc[0], rows.key.iloc[0], name, value, chosen, std))
        return pd.DataFrame(out, columns=["fold", "key", "method", "value", "chosen", "std"])

    tasks = domains.sparkSession.sparkContext.defaultParallelism  # few rows, but each fit takes its time
    return long.repartition(tasks, "fold", "key").groupBy("fold", "key").applyInPandas(fit, "fold string, key string, method string, value double, chosen double, std double")


def regression_weights(fitted: DataFrame) -> DataFrame:
    wide = fitted.groupBy("fold", "method").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"w_{k}") for k in KEYS))
    return _normalised(wide)


def blend(first: DataFrame, second: DataFrame, name: str, alphas: tuple[float, ...] = BLEND) -> DataFrame:
    """alpha first + (1 - alpha) second for each alpha, as (fold, method, alpha, weights)."""
    spark = first.sparkSession
    a, b = (t.select("fold", *(F.col(w).alias(f"{p}{w}") for w in W)) for t, p in ((first, "a_"), (second, "b_")))
    table = a.join(b, "fold").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in alphas], "alpha double")))
    cols = clip_and_normalise({w: F.col("alpha") * F.col(f"a_{w}") + (1 - F.col("alpha")) * F.col(f"b_{w}") for w in W})
    return table.select("fold", F.concat(F.lit(f"{name}_"), F.format_string("%.1f", "alpha")).alias("method"), "alpha", *(cols[w].alias(w) for w in W))


def _long(members: DataFrame) -> DataFrame:
    return members.unpivot(["fold", "method"], [F.col(f"w_{k}").alias(k) for k in KEYS], "key", "w")


def _wide(table: DataFrame, value: str, method: str) -> DataFrame:
    return _normalised(table.groupBy("fold").agg(*(F.max(F.when(F.col("key") == k, F.col(value))).alias(f"w_{k}") for k in KEYS)), method)


def soft_vote(members: DataFrame) -> DataFrame:
    return _wide(_long(members).groupBy("fold", "key").agg(F.avg("w").alias("v")), "v", "soft_vote")


def hard_vote(members: DataFrame) -> DataFrame:
    return _wide(_long(members).groupBy("fold", "key").agg(F.median("w").alias("v")), "v", "hard_vote")


def _places(members: DataFrame) -> DataFrame:
    """Rank of each key within a member's prediction, ties in the order of the keys."""
    position = F.array_position(F.array(*(F.lit(k) for k in KEYS)), F.col("key"))
    order = Window.partitionBy("fold", "method").orderBy(F.desc(F.floor(F.col("w") * 1e12 + 0.5)), position)
    return _long(members).withColumn("place", F.row_number().over(order))


def borda(members: DataFrame) -> DataFrame:
    return _wide(_places(members).groupBy("fold", "key").agg(F.sum(len(KEYS) - F.col("place")).cast("double").alias("v")), "v", "borda")


def reciprocal_rank_fusion(members: DataFrame, k: int = 1) -> DataFrame:
    return _wide(_places(members).groupBy("fold", "key").agg(F.sum(1 / (k + F.col("place"))).alias("v")), "v", "rrf")


def leave_one_out(domains: DataFrame, default: dict[str, float], names: tuple[str, ...] = SELECTED) -> DataFrame:
    """(fold, method, alpha, weights) of all base methods and both blends; 'searched' is the domain's own weights."""
    spark = domains.sparkSession
    near = [knn(domains, k, names) for k in (1, 2, 3)]
    path = scratch(spark, "regressions")  # stored: four members read them
    regression_weights(regressions(domains, names)).write.parquet(path)
    fitted = spark.read.parquet(path)
    members = near[0].union(near[1]).union(near[2]).union(fitted.where("method = 'bayes'"))
    own = domains.select(F.col("domain_id").alias("fold"), *W)
    base = spark.createDataFrame([tuple(float(default[k]) for k in KEYS)], ", ".join(f"{w} double" for w in W))
    parts = [
        own.select("fold").crossJoin(F.broadcast(base)).select("fold", F.lit("default").alias("method"), *W),
        own.select("fold", F.lit("searched").alias("method"), *W),
        transfer_direct(domains), *near, fitted, soft_vote(members), hard_vote(members), borda(members), reciprocal_rank_fusion(members),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.select("fold", "method", F.lit(None).cast("double").alias("alpha"), *W)
    for second, name in (("ridge", "blend_ridge"), ("bayes", "blend_bayes")):
        out = out.union(blend(near[0], fitted.where(F.col("method") == second), name))
    return out
