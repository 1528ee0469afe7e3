"""Queries over run logs, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.operators import evaluate, runs
from latticeflow.session import table
from latticeflow.streaming.tokenize import log_windows


def _log(s: SparkSession, d: str) -> DataFrame:
    """Rows with a usable accuracy; the size of the data set is part of the run's name."""
    x = table(s, d, "run_log").where("run_id is not null and dev_accuracy between 0 and 1")
    return x.withColumn("size", F.regexp_extract("run_id", r"-v(\d+)-", 1)).withColumn("task", F.regexp_extract("run_id", r"^([a-z0-9]+)-", 1))


def best_run(s: SparkSession, d: str) -> DataFrame:
    x = runs.best_row(_log(s, d).groupBy("run_id", "step").agg(F.max("dev_accuracy").alias("dev_accuracy")), ["run_id"], "dev_accuracy", "step")
    return x.select("run_id", "step", "dev_accuracy")


def lowest_loss(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "run_log").where("run_id is not null").groupBy("run_id", "step").agg(F.min("train_loss").alias("train_loss"))
    return runs.best_row(x, ["run_id"], "train_loss", "step", maximise=False).select("run_id", "step", "train_loss")


def hyperopt_best(s: SparkSession, d: str) -> DataFrame:
    x = _log(s, d).groupBy("size", "task", "run_id", "step").agg(F.max("dev_accuracy").alias("dev_accuracy"))
    return runs.best_of_best(x, ["task", "run_id"], "size", "dev_accuracy", "step").select("size", "task", "run_id", "step", "dev_accuracy")


def metric_join(s: SparkSession, d: str) -> DataFrame:
    metrics = table(s, d, "run_log").where("run_id is not null").groupBy("run_id").agg(F.max("elapsed").alias("elapsed"), F.count("*").alias("rows"))
    return runs.join_metrics(best_run(s, d), metrics, ["run_id"], {"elapsed": "seconds"}).select("run_id", "step", "dev_accuracy", "seconds", "rows")


def report_format(s: SparkSession, d: str) -> DataFrame:
    return best_run(s, d).select("run_id", runs.report_row(["dev_accuracy"]).alias("row"))


def tumbling_mean(s: SparkSession, d: str) -> DataFrame:
    return runs.tumbling_mean(table(s, d, "run_log").where("run_id is not null and not isnan(train_entropy)"), ["run_id"], "step", "train_entropy", 1000).select("run_id", "window", F.round("mean", 6).alias("mean"))


def ramp(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "run_log").select("step", F.round(runs.ramp(F.col("step"), 100, 900), 6).alias("ramp")).distinct()


def aggregate_by(s: SparkSession, d: str) -> DataFrame:
    x = runs.aggregate_by(_log(s, d), ["task", "size"], {"dev_accuracy": "mean", "step": "max", "run_id": "count"})
    return x.withColumn("dev_accuracy_mean", F.round("dev_accuracy_mean", 6))


def group_lasso(s: SparkSession, d: str) -> DataFrame:
    return runs.group_lasso(table(s, d, "events"), "event_type", "value").select(F.round("group_lasso", 4).alias("group_lasso"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    x = log_windows(table(s, d, "events"))
    return x.select("user_id", F.col("window.start").alias("start"), F.round("mean", 6).alias("mean"), "n")


def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the next one by id."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(runs.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


def accuracy(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of calling every document English, by source; documents without a language don't count."""
    x = table(s, d, "documents").select("source", F.lower("lang").alias("label"), F.lit("en").alias("predicted"))
    a = evaluate.accuracy(x.withColumn("label", F.when(F.col("label") == "en", 1).when(F.col("label") == "und", -100).when(F.col("label").isNotNull(), 0)).withColumn("predicted", F.lit(1)), ["source"])
    return a.select("source", "n", F.round("accuracy", 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (best_run, lowest_loss, hyperopt_best, metric_join, report_format, tumbling_mean, ramp, aggregate_by, group_lasso, event_windows, cosine_pairs, accuracy)}

_LOG = "lg AS (SELECT *, regexp_extract(run_id, '-v(\\d+)-', 1) AS size, regexp_extract(run_id, '^([a-z0-9]+)-', 1) AS task FROM run_log WHERE run_id IS NOT NULL AND dev_accuracy BETWEEN 0 AND 1)"
_ST = f"{_LOG}, st AS (SELECT size, task, run_id, step, max(dev_accuracy) AS dev_accuracy FROM lg GROUP BY ALL)"
_BEST = f"{_ST}, best AS (SELECT run_id, step, dev_accuracy, size, task FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY dev_accuracy DESC, step) = 1)"

SQL = {
    "best_run": f"WITH {_BEST} SELECT run_id, step, dev_accuracy FROM best",
    "lowest_loss": "WITH x AS (SELECT run_id, step, min(train_loss) AS train_loss FROM run_log WHERE run_id IS NOT NULL AND train_loss IS NOT NULL GROUP BY ALL) SELECT run_id, step, train_loss FROM x WHERE NOT isnan(train_loss) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY train_loss, step) = 1",
    "hyperopt_best": f"WITH {_BEST} SELECT size, task, run_id, step, dev_accuracy FROM best QUALIFY row_number() OVER (PARTITION BY size ORDER BY dev_accuracy DESC, task, run_id) = 1",
    "metric_join": f"WITH {_BEST}, m AS (SELECT run_id, max(elapsed) AS seconds, count(*) AS rows FROM run_log WHERE run_id IS NOT NULL GROUP BY run_id) SELECT run_id, step, dev_accuracy, seconds, rows FROM best LEFT JOIN m USING (run_id)",
    "report_format": f"WITH {_BEST} SELECT run_id, printf('%.2f', dev_accuracy * 100) AS row FROM best",
    "tumbling_mean": "SELECT run_id, (step // 1000)::BIGINT AS window, round(avg(train_entropy), 6) AS mean FROM run_log WHERE run_id IS NOT NULL AND NOT isnan(train_entropy) GROUP BY 1, 2",
    "ramp": "SELECT DISTINCT step, round(least(1.0, greatest(0.0, (step - 100) / 800::DOUBLE)), 6) AS ramp FROM run_log",
    "aggregate_by": f"WITH {_LOG} SELECT task, size, round(avg(dev_accuracy), 6) AS dev_accuracy_mean, max(step) AS step_max, count(run_id) AS run_id_count FROM lg GROUP BY task, size",
    "group_lasso": "SELECT round(sum(g), 4) AS group_lasso FROM (SELECT sqrt(count(*)) * sqrt(sum(value * value)) AS g FROM events GROUP BY event_type)",
    "event_windows": "SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) AS start, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "accuracy": "SELECT source, count(*) AS n, round(avg(CASE WHEN lower(lang) = 'en' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM documents WHERE lang IS NOT NULL AND lower(lang) <> 'und' GROUP BY source",
}
