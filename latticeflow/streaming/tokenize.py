"""The same tokenization on a stream: rows don't depend on each other, so append mode needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import semiring as S

#: Most units of a vocabulary that is carried in the expression.
LIMIT = 100_000


def stream_tokenize(texts: DataFrame, vocab: DataFrame, text: str = "word", max_unit: int = 4, max_length: int = 48, n: int = 1) -> DataFrame:
    """Adds `best`, the n best segmentations, to a (streaming or static) table of short texts.

    The vocabulary is static and bounded by `LIMIT`; it is a one-row map joined to every row. Null, empty and too long texts
    have a null result.
    """
    if vocab.limit(LIMIT + 1).count() > LIMIT:
        raise ValueError(f"a vocabulary of more than {LIMIT} units doesn't fit a streaming tokenizer")
    units = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", "logp"))).alias("_v"))  # at most LIMIT entries
    ok = (F.length(text) > 0) & (F.length(text) <= max_length)
    spots = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.length(text) - 1),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max_unit), F.length(text) - s)),
                lambda k: F.struct(s.alias("s"), (s + k).alias("e"), F.substr(F.col(text), s + 1, k).alias("token"), F.element_at(F.col("_v"), F.substr(F.col(text), s + 1, k)).alias("logp")),
            ),
        )
    )
    edges = F.filter(spots, lambda x: x["logp"].isNotNull())
    return texts.join(F.broadcast(units)).withColumn("best", F.when(ok, S.nbest(S.by_end(edges, F.length(text)), n))).drop("_v")


def log_windows(events: DataFrame, at: str = "ts", value: str = "value", run: str = "user_id", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean of a logged value per run and tumbling window of event time; rows later than the watermark are dropped by a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), run).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
