"""Scores of tokenizations against gold ones, alignment of tokens with words, and dictionary look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.text import with_boundaries


def prf(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1; nothing predicted gives precision 0, no gold gives recall null, no hit gives F1 0."""
    p = F.when(predicted == 0, F.lit(0.0)).otherwise(tp / predicted)
    r = F.try_divide(tp, gold)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1")]


def exploded(df: DataFrame, row: str, tokenizations: str, weights: str, side: str) -> DataFrame:
    """(row, {side}_toks, {side}_w): one row per weighted tokenization; tokens become (unit, rb)."""
    each = df.select(row, F.explode(F.arrays_zip(F.col(tokenizations).alias("t"), F.col(weights).alias("w"))).alias("x"))
    return each.select(row, with_boundaries(F.col("x.t")).alias(f"{side}_toks"), F.col("x.w").alias(f"{side}_w"))


def paired(gold: DataFrame, predicted: DataFrame, row: str = "row") -> DataFrame:
    """Every gold with every predicted tokenization of the same row, weight = product; an equi-join on the row."""
    g, p = exploded(gold, row, "tokenizations", "weights", "gold"), exploded(predicted, row, "tokenizations", "weights", "pred")
    return g.join(p, row).withColumn("w", F.col("gold_w") * F.col("pred_w"))


def _span(x: Column) -> Column:
    return F.struct((x["rb"] - F.length(x["unit"])).alias("lb"), x["rb"].alias("rb"))


def micro_scores(pairs: DataFrame) -> DataFrame:
    """One row: weighted token and boundary counts with precision, recall and F1; inner boundaries only."""
    g, p = F.transform("gold_toks", _span), F.transform("pred_toks", _span)
    gb, pb = (F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x["rb"]) for c in (g, p))
    hits = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    s = lambda n, name: F.sum(F.col("w") * n).alias(name)
    out = pairs.agg(s(hits(g, p), "token_tp"), s(F.size(p), "token_ap"), s(F.size(g), "token_at"), s(hits(gb, pb), "boundary_tp"), s(F.size(pb), "boundary_ap"), s(F.size(gb), "boundary_at"))
    cols = [c for k in ("token", "boundary") for c in [x.alias(f"{k}_{n}") for x, n in zip(prf(F.col(f"{k}_tp"), F.col(f"{k}_ap"), F.col(f"{k}_at")), ("precision", "recall", "f1"))]]
    return out.select("*", *cols)


def category_scores(pairs: DataFrame, categories: str = "categories") -> DataFrame:
    """Per category of gold tokens: token hits, gold tokens, predicted tokens within the gold span, and boundaries.

    The gold tokens are zipped with their categories; predictions within a span are found by a range on the row's own arrays.
    `boundary_at` counts the inner ends of a gold token, without weight.
    """
    each = pairs.select("w", "pred_toks", F.size("gold_toks").alias("size"), F.posexplode(F.arrays_zip(F.col("gold_toks").alias("t"), F.col(categories).alias("c"))).alias("i", "x")).where("x.t is not null and x.c is not null")
    span = _span(F.col("x.t"))
    e = each.select("w", F.col("x.c").alias("category"), span.alias("g"), F.transform("pred_toks", _span).alias("p"), "i", "size")
    inside = F.filter("p", lambda q: (q["lb"] >= F.col("g.lb")) & (q["rb"] <= F.col("g.rb")))
    ends = F.transform(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda q: q["rb"])
    edges = F.filter(F.array(F.when(F.col("i") > 0, F.col("g.lb")), F.when(F.col("i") < F.col("size") - 1, F.col("g.rb"))), lambda b: b.isNotNull())
    strict = F.filter(ends, lambda b: (b > F.col("g.lb")) & (b < F.col("g.rb")))
    return e.groupBy("category").agg(
        F.sum(F.col("w") * F.array_contains("p", F.col("g")).cast("int")).alias("token_tp"),
        F.sum(F.col("w") * F.size(inside)).alias("token_ap"),
        F.sum("w").alias("token_at"),
        F.sum(F.col("w") * F.size(F.filter(edges, lambda b: F.array_contains(ends, b)))).alias("boundary_tp"),
        F.sum(F.size(edges)).alias("boundary_at"),
        F.sum(F.col("w") * F.size(strict)).alias("oversegmented"),
    )


def unique_tokens(df: DataFrame, tokenizations: str = "tokenizations") -> DataFrame:
    """One row: the number of distinct tokens used."""
    return df.select(F.explode(F.flatten(tokenizations)).alias("t")).agg(F.count_distinct("t").alias("tokens"))


def reference_per_char(df: DataFrame, logp: str = "ref_logp", text: str = "word", weight: Column | None = None) -> DataFrame:
    """One row: summed log-probability per character; rows with -Infinity are skipped in the sum, but their characters count."""
    w = F.lit(1) if weight is None else weight
    total = F.sum(F.when(F.col(logp) > float("-inf"), F.col(logp) * w))
    return df.agg((total / F.sum(F.length(text) * w)).alias("logp_per_char"))


def positional_join(left: DataFrame, right: DataFrame, row: str = "row") -> DataFrame:
    """Joins by row number; a different number of rows is an error at run time."""
    same = left.agg(F.count("*")).scalar() == right.agg(F.count("*")).scalar()
    wrong = F.raise_error(F.lit("the two inputs have different numbers of rows")).cast("boolean")
    return left.join(right, row).where(F.when(same, F.lit(True)).otherwise(wrong))


def align(words: Sequence[str] | Column, tokens: Column) -> Column:
    """[(word, tokens)]: tokens grouped by the word of the same text in whose span they end; both are laid end to end."""
    words = F.array(*map(F.lit, words)) if not isinstance(words, Column) else words
    w, t = with_boundaries(words, ()), with_boundaries(tokens, ())
    return F.transform(w, lambda x: F.struct(x["unit"].alias("word"), F.transform(F.filter(t, lambda y: (y["rb"] > x["rb"] - F.length(x["unit"])) & (y["rb"] <= x["rb"])), lambda y: y["unit"]).alias("tokens")))


def segmentation_dictionary(lines: DataFrame, word: str = "word", units: str = "units") -> DataFrame:
    """(word, segs): distinct segmentations of each word, fewest units first, then by the units."""
    found = lines.groupBy(word).agg(F.collect_set(F.struct(F.size(units).alias("n"), F.col(units).alias("u"))).alias("_s"))
    return found.select(word, F.transform(F.array_sort("_s"), lambda x: x["u"]).alias("segs"))


def replace_by_dictionary(tokens: DataFrame, dictionary: DataFrame, vocab: DataFrame, word: str = "word", best: str = "tokens") -> DataFrame:
    """(word, tokens, outcome): the first segmentation whose units are all known replaces the best path.

    outcome is `replaced`, `unknown` (no segmentation is wholly known) or `missing`. Known units are found by a join.
    """
    option = dictionary.select(word, F.posexplode("segs").alias("i", "seg"))
    unit = option.select(word, "i", "seg", F.explode("seg").alias("token")).join(vocab.select("token", F.lit(1).alias("_k")), "token", "left")
    known = unit.groupBy(word, "i").agg(F.count("*").alias("n"), F.count("_k").alias("k"), F.first("seg").alias("seg")).where("n = k")
    first = known.groupBy(word).agg(F.min_by("seg", "i").alias("_seg"))
    j = tokens.join(dictionary.select(word, F.lit(1).alias("_in")), word, "left").join(first, word, "left")
    outcome = F.when(F.col("_seg").isNotNull(), "replaced").when(F.col("_in").isNotNull(), "unknown").otherwise("missing")
    return j.select(word, F.coalesce("_seg", best).alias("tokens"), outcome.alias("outcome"))


def signature_outcomes(tokens: DataFrame, gold: DataFrame, word: str = "word", best: str = "tokens") -> DataFrame:
    """(outcome, words): single- or multi-piece words, right if their lengths are one of the word's gold signatures.

    Words without gold signatures are `unknown`. The look-up is by the lower-cased word.
    """
    sig = F.transform(best, lambda t: F.length(t))
    j = tokens.withColumn("_k", F.lower(word)).join(gold.select(F.col(word).alias("_k"), "signatures"), "_k", "left")
    right = F.array_contains("signatures", sig)
    outcome = F.when(F.col("signatures").isNull(), "unknown").otherwise(F.concat(F.when(F.size(best) == 1, "mono").otherwise("multi"), F.when(right, " correct").otherwise(" incorrect")))
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("words"))


def accuracy(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions, and the mean probability of the gold label if `p_gold` is there; ignored labels (-100, null) don't count."""
    kept = df.where(F.col("label").isNotNull() & (F.col("label") != -100))
    cols = [F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy")]
    if "p_gold" in df.columns:
        cols.append(F.avg("p_gold").alias("expected_accuracy"))
    return (kept.groupBy(*keys) if keys else kept).agg(F.count("*").alias("n"), *cols)
