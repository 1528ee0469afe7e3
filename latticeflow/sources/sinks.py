"""Writers: vocabularies, tokenizations, metrics, logs, caches and views of lattices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary(df: DataFrame, path: str, weights: Sequence[str] = ("logp",), mode: str = "overwrite") -> None:
    """Lines token, weights, separated by tabs; ordered ranges in ordered files."""
    df.repartitionByRange("token").sortWithinPartitions("token").select(F.concat_ws("\t", "token", *[F.col(w).cast("string") for w in weights])).write.mode(mode).text(path)


def tokenization_json(text: Column, tokenizations: Column, weights: Column) -> Column:
    """The JSON line of a tokenization: units paired with their right boundaries."""
    pairs = F.transform(tokenizations, lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, lambda x: F.concat(F.lit("["), _quoted(x["unit"]), F.lit(", "), x["rb"].cast("string"), F.lit("]"))), ", "), F.lit("]")))
    return F.concat(F.lit('{"text": '), _quoted(text), F.lit(', "tokenizations": ['), F.array_join(pairs, ", "), F.lit('], "weights": '), F.to_json(weights), F.lit("}"))


def _quoted(s: Column) -> Column:
    j = F.to_json(F.struct(s.alias("v")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def tokenizations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(tokenization_json(F.col("text"), F.col("tokenizations"), F.col("weights")).alias("value")).write.mode(mode).text(path)


def metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of one row as one JSON line."""
    df.coalesce(1).write.mode(mode).json(path)


def log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def predictions(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    df.select(*columns).write.mode(mode).csv(path, sep="\t")


def cache(df: DataFrame, path: str, clear: bool = True) -> None:
    """A cache of examples; with `clear` an old one is replaced, else it is an error."""
    df.write.mode("overwrite" if clear else "errorifexists").parquet(path)


def index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A skip-gram index as (dist, src, tgt, n), partitioned by distance."""
    df.write.mode(mode).partitionBy("dist").parquet(path)


def dynamics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of learning dynamics, tab-separated, a folder per step."""
    df.write.mode(mode).partitionBy("step").csv(path, sep="\t")


#: Fields of an edge that can be logged.
LOGGERS = {"log_prob": "logp", "unit": "token", "marginal": "p", "token": "token", "ent": "entropy"}


def logged(edges: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Projection of edges by the names of the wanted fields."""
    return edges.select(key, *[F.col(LOGGERS[f]).alias(f) for f in fields])
