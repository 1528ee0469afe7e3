"""Run logs: best steps, joins of metrics, windows over steps, and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, groups: Sequence[str], metric: str, tie: str, maximise: bool = True) -> DataFrame:
    """The row of each group with the best metric, the earliest by `tie` among equals; null and NaN metrics are no candidates.

    One partial aggregate, so a group of any size is reduced before the shuffle. Other columns come along.
    """
    good = df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    key = F.struct((-F.col(metric) if maximise else F.col(metric)).alias("m"), F.col(tie).alias("t"))
    rest = [c for c in df.columns if c not in groups]
    best = (good.groupBy(*groups) if groups else good).agg(F.min_by(F.struct(*rest), key).alias("_b"))
    return best.select(*groups, "_b.*")


def best_of_best(df: DataFrame, run: Sequence[str], size: str, metric: str, tie: str) -> DataFrame:
    """Two levels: the best step of each run, then the best run of each `size`; ties by the run's key."""
    steps = best_row(df, [size, *run], metric, tie)
    return best_row(steps.withColumn("_key", F.struct(*run)), [size], metric, "_key").drop("_key")


def join_metrics(runs: DataFrame, metrics: DataFrame, keys: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Left join of metrics by the runs' keys; clashing names are told apart by `rename`."""
    return runs.join(metrics.withColumnsRenamed(rename or {}), list(keys), "left")


def tumbling_mean(df: DataFrame, groups: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """(groups, window, mean): mean of `value` over windows of `width` steps; null values don't count."""
    return df.groupBy(*groups, F.floor(F.col(order) / width).cast("long").alias("window")).agg(F.avg(value).alias("mean"))


def ramp(step: Column, begin: float, end: float) -> Column:
    """0 up to `begin`, 1 from `end`, a line between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - begin) / (end - begin)))


def report_row(cols: Sequence[str], scale: float = 100.0, digits: int = 2, sep: str = " & ") -> Column:
    """Columns scaled and formatted, joined into one string."""
    return F.concat_ws(sep, *[F.format_string(f"%.{digits}f", F.col(c) * scale) for c in cols])


def quantiles(df: DataFrame, value: Column, steps: int = 10) -> DataFrame:
    """(q, x): exact quantiles with linear interpolation, q = 0, 1/steps ... 1."""
    qs = [i / steps for i in range(steps + 1)]
    row = df.agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("x"))
    return row.select(F.posexplode("x").alias("i", "x")).select((F.col("i") / steps).alias("q"), "x")


def nearest_rank(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """(q, x): the value at place int(n * q) in ascending order, counted from 1 (at least 1), by cumulated counts of equal values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    # distinct values only; their counts are few against the rows
    cum = counts.withColumn("_to", F.sum("c").over(Window.orderBy(value)))
    total = counts.agg(F.sum("c").alias("_n"))
    wanted = total.select(F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "_n").withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("q"))))
    return cum.join(F.broadcast(wanted), (F.col("_to") >= F.col("_k")) & (F.col("_to") - F.col("c") < F.col("_k"))).select("q", F.col(value).alias("x"))


def group_lasso(counts: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: the sum over units of sqrt(size) times the norm of the unit's values."""
    each = counts.groupBy(unit).agg((F.sqrt(F.count("*")) * F.sqrt(F.sum(F.col(value) * F.col(value)))).alias("g"))
    return each.agg(F.sum("g").alias("group_lasso"))


def aggregate_by(df: DataFrame, keys: Sequence[str], methods: dict[str, str]) -> DataFrame:
    """Columns by name of method: mean, sum, min, max, count or std."""
    named = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_pop}
    return df.groupBy(*keys).agg(*[named[m](c).alias(f"{c}_{m}") for c, m in methods.items()])


def sweep(spark, **axes: Sequence) -> DataFrame:
    """All combinations of the axes' values, from the settings' own literals."""
    from itertools import product

    return spark.createDataFrame(list(product(*axes.values())), list(axes))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that the seed and the key settle, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)
