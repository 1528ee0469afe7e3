"""Readers of text files: vocabularies, weights, examples, corpora, dictionaries, logs and tokenizations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions.text import SPACE, SPECIALS, pretokens
from latticeflow.operators.vocab import dense_ids, last_weights, rank_all

# Column names of headerless files.
MORPHEME = "id INT, label STRING, text STRING, features STRING, segmentation STRING"
SCORED = "text STRING, score DOUBLE, label STRING"
LABELLED = "id STRING, label STRING, text STRING"
SENTIMENT = "label STRING, text STRING"
TOKENIZATION = "text STRING, tokenizations ARRAY<ARRAY<ARRAY<STRING>>>, weights ARRAY<DOUBLE>, reference_log_prob DOUBLE"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0 over all files in order; the number is an order key within the read."""
    raw = spark.read.text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    return rank_all(placed, ["_f", "_b", "_i"], "line_no").select("line_no", "value")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token): first column, repeated tokens once."""
    return dense_ids(lines(spark, path).select("line_no", F.split("value", "\t")[0].alias("token")).where("token <> ''"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(token, w): all columns after the first as doubles; of repeated tokens the last line."""
    cells = F.split("value", "\t")
    return last_weights(lines(spark, path).where("value <> ''").select("line_no", cells[0].alias("token"), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: x.cast("double")).alias("w")))


def log_weights(df: DataFrame) -> DataFrame:
    """Weights turned into logarithms."""
    return df.withColumn("w", F.transform("w", lambda x: F.ln(x)))


def labels(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("line_no", F.trim("value").alias("label")).where("label <> ''")


def morpheme_examples(df: DataFrame) -> DataFrame:
    """Rows of `MORPHEME`: text after the three slots' marks (the marks alone for null), features and segmentation as arrays."""
    marked = F.concat_ws(" ", F.lit("[SP1]"), F.lit("[SP2]"), F.lit("[SP3]"), "text").alias("text")
    return df.select("id", "label", marked, F.split("features", "-", -1).alias("features"), F.split("segmentation", "-", -1).alias("segmentation"))


def morphemes(spark: SparkSession, path: str, gold_share: float | None = None) -> DataFrame:
    """Morpheme examples; with `gold_share`, gold units for the first share of rows only."""
    out = morpheme_examples(spark.read.csv(path, schema=MORPHEME))
    if gold_share is None:
        return out
    ranked = rank_all(out, ["id"], "_r")
    n = out.count()
    return ranked.withColumn("segmentation", F.when(F.col("_r") < int(gold_share * n), F.filter("segmentation", lambda t: ~t.isin(*SPECIALS)))).drop("_r")


def short_texts(df: DataFrame, max_length: int = 48) -> DataFrame:
    """Texts that leave room for two marks, after a class mark and the space mark; null texts are dropped."""
    return df.where(F.length("text") <= max_length - 2).withColumn("text", F.concat(F.lit("[CLS]" + SPACE), "text"))


def scored(spark: SparkSession, path: str, max_length: int = 48) -> DataFrame:
    """(text, score, label) with a header."""
    return short_texts(spark.read.csv(path, schema=SCORED, header=True), max_length)


def labelled(spark: SparkSession, path: str, max_length: int = 48) -> DataFrame:
    return short_texts(spark.read.csv(path, schema=LABELLED), max_length)


def sentiment(spark: SparkSession, path: str, encoding: str = "UTF-8", prefix: str = "[SP1]") -> DataFrame:
    df = spark.read.csv(path, schema=SENTIMENT, encoding=encoding)
    return df.withColumn("tokens", F.concat(F.array(F.lit(prefix)), pretokens(F.col("text"))))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, tokens): lines split at spaces between begin and end marks."""
    return lines(spark, path).select("line_no", F.concat(F.array(F.lit("[BOS]")), F.split("value", " ", -1), F.array(F.lit("[EOS]"))).alias("tokens"))


def tokenizations(spark: SparkSession, path: str) -> DataFrame:
    """(row, text, tokenizations as arrays of (unit, rb), weights, reference_log_prob); rows numbered by their order."""
    parsed = lines(spark, path).select(F.col("line_no").alias("row"), F.from_json("value", TOKENIZATION).alias("j")).select("row", "j.*")
    return parsed.withColumn("tokenizations", F.transform("tokenizations", lambda t: F.transform(t, lambda x: F.struct(x[0].alias("unit"), x[1].cast("int").alias("rb")))))


def segmentation_lines(spark: SparkSession, path: str) -> DataFrame:
    """(word, units) of tab-separated lines."""
    c = F.split("value", "\t")
    return lines(spark, path).where(F.size(c) >= 2).select(c[0].alias("word"), F.split(c[1], " ").alias("units"))


def affixes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.lower(F.trim("value")).alias("affix")).where("affix <> ''")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with any keys; Infinity and NaN are numbers."""
    return spark.read.json(path, allowNonNumericNumbers=True)


def backslash_table(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Named columns, by place, of a file separated by backslashes; multi-word entries are left out."""
    c = F.split("value", r"\\")
    df = lines(spark, path).select(*[F.get(c, F.lit(i)).alias(n) for n, i in columns.items()])
    first = next(iter(columns))
    return df.where(~F.contains(first, F.lit(" ")))


def gold_slots(df: DataFrame, segmentation: str = "segmentation") -> DataFrame:
    """Adds (units, categories): filled slots, and prefix, stem or suffix by place."""
    parts = F.split(segmentation, "-")
    named = F.transform(parts, lambda x, i: F.struct(x.alias("unit"), F.element_at(F.array(F.lit("prefix"), F.lit("stem"), F.lit("suffix")), (i % 3).cast("int") + 1).alias("category")))
    kept = F.filter(named, lambda x: ~x["unit"].isin("[SP1]", "[SP2]", "[SP3]"))
    return df.withColumn("units", F.transform(kept, lambda x: x["unit"])).withColumn("categories", F.transform(kept, lambda x: x["category"]))


def checked_gold(df: DataFrame, word: str = "word", segmentation: str = "segmentation") -> DataFrame:
    """(word, segmentation); a word with two different gold segmentations is an error."""
    g = df.groupBy(word).agg(F.count_distinct(segmentation).alias("_n"), F.max(segmentation).alias(segmentation))
    return g.where(F.expr("if(_n <= 1, true, raise_error('two gold segmentations of one word'))")).drop("_n")


#: Readers by domain; further ones can be registered.
READERS: dict[str, Callable[..., DataFrame]] = {"morpheme_prediction": morphemes, "scored": scored, "labelled": labelled, "sentiment": sentiment, "language_modeling": corpus}


def register(domain: str, reader: Callable[..., DataFrame]) -> None:
    READERS[domain] = reader
