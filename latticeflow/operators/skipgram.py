"""Skip-gram co-occurrence: tokens and those some places further on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skipgrams(lines: DataFrame, tokens: str, distances: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dist, src, tgt): each token with the one `dist` places further, within its own row, without a shuffle."""
    def at_distance(d: int):
        n = F.greatest(F.size(tokens) - d, F.lit(0))
        return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, d + 1, n), lambda a, b: F.struct(F.lit(d).alias("dist"), a.alias("src"), b.alias("tgt")))

    pairs = F.flatten(F.array(*[at_distance(d) for d in distances]))
    return lines.where(F.size(tokens) > 0).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def skipgram_counts(lines: DataFrame, tokens: str, distances: Sequence[int]) -> DataFrame:
    """(dist, src, tgt, n)"""
    return skipgrams(lines, tokens, distances).groupBy("dist", "src", "tgt").agg(F.count("*").alias("n"))


def from_index(index: DataFrame, counts: str = "counts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dist, src, tgt, n) of JSON counts distance -> source -> target -> n; null or broken JSON has none."""
    m = index.withColumn("_m", F.from_json(counts, "map<string,map<string,map<string,bigint>>>"))
    a = m.select(*keys, F.explode("_m").alias("dist", "_a")).select(*keys, F.col("dist").cast("int").alias("dist"), F.explode("_a").alias("src", "_b"))
    return a.select(*keys, "dist", "src", F.explode("_b").alias("tgt", "n"))


def occurrences(counts: DataFrame) -> DataFrame:
    """One row per occurrence: a count of n gives n rows."""
    return counts.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def next_labels(lines: DataFrame, tokens: str) -> DataFrame:
    """Adds `labels`: each token's successor, null for the last."""
    return lines.withColumn("labels", F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit(None).cast("string"))))
