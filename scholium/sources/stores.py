"""Tables that runs leave behind: weights, domain features, evaluation results, experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import KEYS, REQUIRED
from ..functions.text import slug
from .shared import children, exists, scratch  # noqa: F401  stores lie in scratch() unless a path is given


def stored(table: DataFrame, what: str) -> DataFrame:
    """The table written to scratch() and read again, for those who read it more than once."""
    path = scratch(table.sparkSession, what)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def save_weights(weights: DataFrame, path: str) -> None:
    """Weights by topic (columns topic, w_<key>), one partition a slug; topics that are saved again are replaced."""
    out = weights.withColumn("slug", slug(F.col("topic")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows that have all required keys; others count as absent."""
    rows = spark.read.schema("topic string, " + ", ".join(f"w_{k} double" for k in KEYS) + ", slug string").parquet(path)
    for k in REQUIRED:
        rows = rows.where(F.col(f"w_{k}").isNotNull())
    return rows


def save_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, domain_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if domain_id is None else rows.where(F.col("domain_id") == domain_id)


def save_state(state: DataFrame, path: str) -> int:
    """A new generation of a corpus state beside the earlier ones, which readers may still hold; its number."""
    n = (generations(state.sparkSession, path) or [0])[-1] + 1
    state.write.parquet(f"{path}/generation={n:06}")
    return n


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete generation, or None."""
    done = generations(spark, path)
    return spark.read.parquet(f"{path}/generation={done[-1]:06}") if done else None


def add_to_state(spark: SparkSession, path: str, part: DataFrame) -> int:
    """Merge the state of new works into the stored one without reading the old works again; the new generation's number."""
    from ..operators.corpus_stats import merge_states

    old = load_state(spark, path)
    return save_state(part if old is None else merge_states(old, part), path)


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the generations whose writers came to an end, in order."""
    return sorted(int(name.split("=")[1]) for name in children(spark, path) if name.startswith("generation=") and exists(spark, f"{path}/{name}/_SUCCESS"))


#: Parts of a method's results, by a hash of the domain: the number of files doesn't grow with the domains.
RESULT_PARTS = 8
RESULT = "domain_id string, ndcg15 double, alpha double, method string, part int"


def save_results(results: DataFrame, path: str) -> None:
    """Long results (domain_id, method, ndcg15, alpha or null), by method and a hash of the domain.

    Results that are there already stay, but for those of the same domain and method, which are replaced: only the parts that new rows fall in are
    read and written again.
    """
    spark = results.sparkSession
    new = results.select("domain_id", "ndcg15", "alpha", "method", F.pmod(F.xxhash64("domain_id"), F.lit(RESULT_PARTS)).cast("int").alias("part"))
    if _has_results(spark, path):
        staged = scratch(spark, "results")
        new.write.parquet(staged)
        new = spark.read.schema(RESULT).parquet(staged)
        touched = new.select("method", "part").distinct()
        kept = _results(spark, path).join(F.broadcast(touched), ["method", "part"], "left_semi").join(new.select("domain_id", "method").distinct(), ["domain_id", "method"], "left_anti")  # RESULT_PARTS rows a method
        merged = scratch(spark, "results")
        kept.select(new.columns).unionByName(new).write.parquet(merged)
        new = spark.read.schema(RESULT).parquet(merged)
    new.repartition("method", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "part").parquet(path)


def _has_results(spark: SparkSession, path: str) -> bool:
    return any(name.startswith("method=") for name in children(spark, path))


def _results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).parquet(path)


def load_results(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """Stored results; with ``methods`` only their partitions are read."""
    rows = _results(spark, path).drop("part")
    return rows if methods is None else rows.where(F.col("method").isin(methods))


def append_experiments(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


_SCORES = "struct<composite:double,rouge1:double,rouge2:double,rougeL:double,faithfulness:double,coverage:double>"
EXPERIMENT = (
    "run_name string, timestamp string, models struct<summarize:string,critic:string,judge:string>, "
    "params struct<n_train:int,n_val:int,n_iter:int,beam_size:int,n_worst:int,use_rouge:boolean,use_judge:boolean,seed:int>, "
    f"baseline {_SCORES}, final {_SCORES}, improvement_pct double, duration_seconds double, prompt_saved_to string"
)
#: Measures of both evaluations of an experiment, as they are named there and here.
EXPERIMENT_MEASURES = {"composite": "composite", "rouge1": "rouge1", "rouge2": "rouge2", "rougeL": "rouge_l", "faithfulness": "faithfulness", "coverage": "coverage"}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON Lines: a line that isn't a JSON object of the schema becomes a reject (record, file, block), block being the first
    byte of the part of the file that a task read."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("p"), F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    fine = F.col("p._corrupt_record").isNull()
    return lines.where(fine).select("p.*").drop("_corrupt_record"), lines.where(~fine).select("record", "file", "block")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """One flat row an experiment, from JSON Lines; experiment_rejects() has the lines that aren't JSON. Absent numbers and flags are 0 and false."""
    rows, _ = read_json_lines(spark, path, EXPERIMENT)
    of = lambda part, name: [F.coalesce(f"{part}.{k}", F.lit(0.0)).alias(f"{name}_{v}") for k, v in EXPERIMENT_MEASURES.items()]
    flat = rows.select(
        "run_name",
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        *(F.coalesce(f"models.{m}", F.lit("?")).alias(f"{m}_model") for m in ("summarize", "critic", "judge")),
        *(F.coalesce(f"params.{n}", F.lit(0)).alias(n) for n in ("n_train", "n_val", "n_iter", "beam_size", "n_worst", "seed")),
        *(F.coalesce(f"params.{n}", F.lit(False)).alias(n) for n in ("use_rouge", "use_judge")),
        *of("baseline", "baseline"),
        *of("final", "final"),
        F.coalesce("improvement_pct", F.lit(0.0)).alias("improvement_pct"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        "prompt_saved_to",
    )
    return flat


def experiment_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, block): lines of an experiment log that aren't JSON."""
    return read_json_lines(spark, path, EXPERIMENT)[1]


def save_run(iterations: DataFrame, path: str, bulky: tuple[str, ...] = ("gradient", "candidates"), best: DataFrame | None = None) -> None:
    """A run's iterations twice: a summary without the bulky columns, and in full; and ``best``, the best prompt of each run."""
    if best is not None:
        best.write.mode("overwrite").json(f"{path}/best")
    iterations.drop(*bulky).write.mode("overwrite").json(f"{path}/summary")
    iterations.write.mode("overwrite").json(f"{path}/detail")
