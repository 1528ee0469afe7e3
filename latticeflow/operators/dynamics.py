"""Tables of learning dynamics: weights, lattice edges and pairs, with text and tokens joined in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.text import two_digits


def weight_table(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """(step, token, weight, grad): ids replaced by tokens, numbers with two significant digits."""
    return values.join(vocab.select("token_id", "token"), "token_id").select("step", "token", two_digits(F.col("weight")).alias("weight"), two_digits(F.col("grad")).alias("grad"))


def lattice_table(edges: DataFrame, examples: DataFrame, by_example: bool = False) -> DataFrame:
    """Edges with the text and segmentation of their example; token first, or example first."""
    j = edges.join(examples.select("ex_id", "text", "segmentation"), "ex_id")
    numbers = [two_digits(-F.col(c)).alias(c) for c in ("grad_entropy", "grad_task")]
    head = ["text", "segmentation", "token"] if by_example else ["token", "text", "segmentation"]
    return j.select("step", *head, *numbers)


def pair_table(pairs: DataFrame, examples: DataFrame) -> DataFrame:
    """(step, src, tgt, text, segmentation, cond, attention) of pairs of edges that can attend each other."""
    return pairs.join(examples.select("ex_id", "text", "segmentation"), "ex_id").select("step", "src", "tgt", "text", "segmentation", two_digits(F.col("cond")).alias("cond"), two_digits(F.col("attention")).alias("attention"))


def node_view(edges: DataFrame, key: str) -> DataFrame:
    """(key, nodes): the lattice as JSON, a list over start nodes of their outgoing edges; padding is left out."""
    real = edges.where(F.col("token") != "[PAD]")
    node = real.groupBy(key, "s").agg(F.sort_array(F.collect_list(F.struct(F.length("token").alias("length"), F.col("token").alias("unit"), F.col("s").alias("start"), F.col("logp").alias("log_prob"), F.col("p").alias("marginal")))).alias("out"))
    return node.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s", "out"))), lambda n: n["out"])).alias("nodes"))


def attention_by_source(pairs: DataFrame, vocab_masked: str = "overlap", weight: str = "attention") -> DataFrame:
    """(over_count, over_mass, leakage, h) of each source edge: its attention above the conditional marginals, to overlapping edges, and its entropy."""
    over, w = F.greatest(F.col(weight) - F.col("cond"), F.lit(0.0)), F.col(weight)
    return pairs.groupBy("ex_id", "src").agg(
        F.count(F.when(over > 0, 1)).alias("over_count"),
        F.sum(over).alias("over_mass"),
        F.sum(F.when(F.col(vocab_masked), w).otherwise(0.0)).alias("leakage"),
        (-F.sum(F.when(w > 0, w * F.ln(w)))).alias("h"),
    )


def summed_sources(sources: DataFrame) -> DataFrame:
    """One row of `attention_statistics` from the sums of the source edges."""
    n, mass = F.coalesce(F.sum("over_count"), F.lit(0)), F.sum("over_mass")
    return sources.agg(n.alias("over_count"), F.when(n > 0, mass / n).alias("over_mean"), mass.alias("over_mass"), F.sum("leakage").alias("leakage"), F.avg("h").alias("entropy_mean"), F.stddev_pop("h").alias("entropy_std"))


def attention_statistics(pairs: DataFrame, vocab_masked: str = "overlap", weight: str = "attention") -> DataFrame:
    """One row: count, mean and mass of attention above the conditional marginal, leakage to overlapping edges, entropy mean and deviation."""
    return summed_sources(attention_by_source(pairs, vocab_masked, weight))
