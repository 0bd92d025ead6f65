"""Batch completions and the evaluation of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.generation import composite
from ..functions.text import rouge_1, rouge_2, rouge_l
from ..sources.shared import exists

#: What a completion function returns for each prompt: text or None, input and output tokens, error or None.
Completion = Callable[[list[str]], list[tuple[str | None, int, int, str | None]]]


def render(rows: DataFrame, template: str | Column, title: str = "title", abstract: str = "abstract", placeholder: str = "(no abstract)") -> DataFrame:
    """Adds prompt: the template (one text, or a column of them) with {title} and {abstract} filled in."""
    body = F.when(F.trim(F.coalesce(abstract, F.lit(""))) == "", placeholder).otherwise(F.col(abstract))
    filled = F.replace(F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("{title}"), F.coalesce(title, F.lit(""))), F.lit("{abstract}"), body)
    return rows.withColumn("prompt", filled)


def complete(prompts: DataFrame, fn: Completion, key: str | list[str] = "id", batch: int = 32) -> DataFrame:
    """(key columns, response, input_tokens, output_tokens, error): one row a prompt; a failure stays with its row.

    If a batch as a whole raises, its prompts are tried one by one. Results of such calls differ from run to
    run: store them before anything else reads them.
    """
    keys = [key] if isinstance(key, str) else key
    kind = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)

    def one(prompt: str) -> tuple[str | None, int, int, str | None]:
        try:
            return fn([prompt])[0]
        except Exception as e:  # noqa: BLE001  whatever the caller's function raises is that row's error
            return None, 0, 0, f"{type(e).__name__}: {e}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got: list[tuple[str | None, int, int, str | None]] = []
            texts = frame["prompt"].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    out = fn(part)
                    if len(out) != len(part):
                        raise ValueError("as many results as prompts are asked for")
                except Exception:  # noqa: BLE001
                    out = [one(p) for p in part]
                got.extend(out)
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "response": [g[0] for g in got], "input_tokens": [g[1] for g in got], "output_tokens": [g[2] for g in got], "error": [g[3] for g in got]})

    return prompts.select(*keys, "prompt").mapInPandas(run, f"{kind}, response string, input_tokens long, output_tokens long, error string")


def evaluate_pairs(pairs: DataFrame, generated: str = "generated", reference: str = "reference") -> DataFrame:
    """Adds rouge1, rouge2, rouge_l."""
    g, r = F.col(generated), F.col(reference)
    return pairs.withColumns({"rouge1": rouge_1(g, r), "rouge2": rouge_2(g, r), "rouge_l": rouge_l(g, r)})


def score_results(results: DataFrame) -> DataFrame:
    """Adds composite; rows with an error count 0."""
    made = composite(*(F.col(c) for c in ("rouge1", "rouge2", "rouge_l", "faithfulness", "coverage")))
    return results.withColumn("composite", F.when(F.col("error").isNotNull(), 0.0).otherwise(made))


#: The measures of an answer.
MEASURES = ("composite", "rouge1", "rouge2", "rouge_l", "faithfulness", "coverage")


def mean_by_prompt(results: DataFrame, by: tuple[str, ...] = ("prompt_id", "split")) -> DataFrame:
    """Means of all MEASURES over a prompt's results on a set of examples; failed results, and measures that weren't taken, count 0."""
    zero = lambda c: F.when(F.col("error").isNotNull(), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return results.groupBy(*by).agg(*(F.avg(zero(m)).alias(m) for m in MEASURES), F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def worst(results: DataFrame, k: int, examples: DataFrame | None = None) -> DataFrame:
    """The k results with the lowest composite, with their examples if given."""
    low = results.orderBy("composite", "example_id").limit(k)
    return low if examples is None else low.join(examples, "example_id")


#: For an iteration, the best template so far and its worst training results with their examples: new prompts as (id, template).
Proposals = Callable[[int, str, list[Row]], list[tuple[str, str]]]


class PromptSearch:
    """A search for the best prompt whose every step is a table under ``path``, so that a rerun goes on where the last one ended.

    ``examples`` has (example_id, split, article_text, reference), split being 'train' or 'validation'. Results of a step
    lie in results/iteration=i/step=<split>, proposals in prompts/iteration=i; a step counts once its writer has come to an end.
    ``judge`` adds faithfulness and coverage to results; without it they are null.
    """

    def __init__(self, examples: DataFrame, fn: Completion, path: str, judge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.examples, self.fn, self.path, self.judge = examples.sparkSession, examples, fn, path, judge

    def _done(self, where: str) -> bool:
        return exists(self.spark, f"{self.path}/{where}/_SUCCESS")

    def _prompts(self, i: int, propose: Callable[[], list[tuple[str, str]]]) -> list[tuple[str, str]]:
        """The proposals of an iteration in order: the stored ones, else new ones, which are stored first."""
        where = f"prompts/iteration={i}"
        if not self._done(where):
            rows = [(k, name, template) for k, (name, template) in enumerate(propose())]
            self.spark.createDataFrame(rows, "place int, prompt_id string, template string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{where}")
        got = self.spark.read.parquet(f"{self.path}/{where}").orderBy("place").collect()  # as many as were proposed
        return [(r.prompt_id, r.template) for r in got]

    def _evaluate(self, i: int, split: str, prompts: list[tuple[str, str]]) -> DataFrame:
        """All of the prompts on all examples of a split in one job, stored: answers first, as they differ from call to call, then measures."""
        where = f"results/iteration={i}/step={split}"
        if not self._done(where):
            answers = f"{self.path}/answers/iteration={i}/step={split}"
            if not exists(self.spark, f"{answers}/_SUCCESS"):
                tried = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("prompt_id"), F.lit(template).alias("template")) for k, (name, template) in enumerate(prompts))))
                rows = self.examples.where(F.col("split") == split).withColumn("p", tried).select("*", "p.*").withColumn("title", F.lit(""))
                complete(render(rows, F.col("template"), abstract="article_text"), self.fn, ["place", "prompt_id", "example_id"]).write.mode("overwrite").parquet(answers)
            done = self.spark.read.parquet(answers).select("place", "prompt_id", "example_id", F.col("response").alias("generated"), "error")
            pairs = evaluate_pairs(done.join(self.examples.where(F.col("split") == split).select("example_id", "split", "reference"), "example_id"))
            judged = self.judge(pairs) if self.judge else pairs.withColumns({c: F.lit(None).cast("double") for c in ("faithfulness", "coverage")})
            score_results(judged).select("place", "prompt_id", "split", "example_id", "generated", "error", *MEASURES).write.mode("overwrite").parquet(f"{self.path}/{where}")
        return self.spark.read.parquet(f"{self.path}/{where}")

    def run(self, start: tuple[str, str], propose: Proposals, iterations: int, n_worst: int = 5) -> tuple[str, str]:
        """The best (id, template) after the iterations: each looks for the worst training results of the best prompt so far, asks for
        new prompts, and takes the first one with the highest validation mean if that is strictly above the best so far."""
        best = start
        self._prompts(0, lambda: [start])
        self._evaluate(0, "validation", [start])
        for i in range(1, iterations + 1):
            trained = self._evaluate(i, "train", [best])
            new = self._prompts(i, lambda: propose(i, best[1], worst(trained, n_worst, self.examples.select("example_id", "article_text", "reference")).orderBy("composite", "example_id").collect()))
            if new:
                self._evaluate(i, "validation", new)
            won = self.history().where((F.col("iteration") == i) & F.col("is_best")).select("prompt_id").collect()  # one row or none
            best = next(p for p in new if p[0] == won[0].prompt_id) if won else best
        return best

    def history(self, n_worst: int = 5) -> DataFrame:
        """(iteration, place, prompt_id, split, n, errors, MEASURES, is_best, worst): a row for each prompt and split that was evaluated.

        is_best: the validation mean is strictly above that of all earlier iterations and the first highest of its own. worst: for
        training rows, the n_worst examples with the lowest composite, joined by commas.
        """
        rows = self.spark.read.option("basePath", f"{self.path}/results").parquet(f"{self.path}/results")
        means = mean_by_prompt(rows, ("iteration", "place", "prompt_id", "split"))
        mark = F.floor(F.col("composite") * 1e9 + 0.5)  # sums of doubles differ in their last digits from run to run
        valid = means.where("split = 'validation'")
        earlier = Window.orderBy("iteration").rangeBetween(Window.unboundedPreceding, -1)  # one row for each prompt that was tried
        first = F.row_number().over(Window.partitionBy("iteration").orderBy(mark.desc(), "place"))
        before = F.max(mark).over(earlier)
        marked = valid.withColumns({"__first": first, "__before": before}).withColumn("is_best", (F.col("__first") == 1) & (F.col("__before").isNull() | (mark > F.col("__before")))).drop("__first", "__before")
        low = F.row_number().over(Window.partitionBy("iteration").orderBy("composite", "example_id"))
        bad = rows.where("split = 'train'").withColumn("n", low).where(F.col("n") <= n_worst).groupBy("iteration").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "example_id"))), lambda x: x["example_id"]), ",").alias("worst"))
        trained = means.where("split = 'train'").withColumn("is_best", F.lit(False)).join(bad, "iteration", "left")
        return marked.withColumn("worst", F.lit(None).cast("string")).unionByName(trained).select("iteration", "place", "prompt_id", "split", "n", "errors", *MEASURES, "is_best", "worst")
