"""Evaluations in one call: tokenizations against gold ones, matches with dictionaries, lattices, language models, splits and hyperparameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import text as T
from latticeflow.operators import encode, evaluate, lattice, runs
from latticeflow.operators.evaluate import prf

_SCORES = ("precision", "recall", "f1")


def _scored(df: DataFrame, kind: str) -> list[Column]:
    return [c.alias(f"{kind}_{n}") for c, n in zip(prf(F.col(f"{kind}_tp"), F.col(f"{kind}_ap"), F.col(f"{kind}_at")), _SCORES)]


def tokenization_report(gold: DataFrame, predicted: DataFrame, row: str = "row", text: str = "text", categories: str | None = None, reference: str | None = None, skip_inf: bool = False) -> DataFrame:
    """One row for all tokens (`scope` is `all`) and, with `categories`, one for each category of gold tokens.

    Both tables have (row, text, tokenizations, weights); `categories` names an array of `gold` with a category per token of each tokenization,
    `reference` a log probability of `predicted`, which is reported per character. With `skip_inf`, rows whose reference is -Infinity count
    by their characters only. Gold tokens of one category and the predictions within them are compared on the row's own arrays.
    """
    p = predicted.select(row, F.col("tokenizations").alias("p_toks"), F.col("weights").alias("p_w"), *([F.col(reference).alias("_ref")] if reference else []))
    g = gold.select(row, text, F.col("tokenizations").alias("g_toks"), F.col("weights").alias("g_w"), *([F.col(categories).alias("g_cats")] if categories else []))
    both = g.join(p, row)
    seen = F.coalesce(F.col("_ref") > float("-inf"), F.lit(True)) if reference and skip_inf else F.lit(True)
    used = both.where(seen)
    cats = F.col("g_cats") if categories else F.transform("g_toks", lambda t: F.transform(t, lambda _: F.lit("")))
    golds = used.withColumn("x", F.explode(F.arrays_zip(F.col("g_toks").alias("t"), F.col("g_w").alias("w"), cats.alias("c"))))
    pairs = golds.withColumn("y", F.explode(F.arrays_zip(F.col("p_toks").alias("t"), F.col("p_w").alias("w"))))
    span = lambda t: F.transform(T.with_boundaries(t, ()), lambda z: F.struct((z["rb"] - F.length(z["unit"])).alias("lb"), z["rb"].alias("rb")))
    x = pairs.select((F.col("x.w") * F.col("y.w")).alias("w"), span(F.col("x.t")).alias("g"), F.array_distinct(span(F.col("y.t"))).alias("p"), F.col("x.c").alias("c"), F.col("x.t").alias("g_units"), F.col("y.t").alias("p_units"))
    inner = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda z: z["rb"])
    x = x.withColumns({"gb": inner(F.col("g")), "pb": inner(F.col("p"))})
    hits = lambda a, b: F.size(F.filter(a, lambda z: F.array_contains(b, z)))
    w = lambda n, name: F.sum(F.col("w") * n).alias(name)
    sums = x.agg(
        w(hits(F.col("g"), F.col("p")), "token_tp"), w(F.size("p"), "token_ap"), w(F.size("g"), "token_at"),
        w(hits(F.col("gb"), F.col("pb")), "boundary_tp"), w(F.size("pb"), "boundary_ap"), w(F.size("gb"), "boundary_at"),
    )
    distinct = x.select(F.explode("g_units").alias("u"), F.lit("g").alias("side")).unionByName(x.select(F.explode("p_units").alias("u"), F.lit("p").alias("side"))).distinct()
    unique = distinct.agg(F.count_if(F.col("side") == "g").alias("unique_gold_tokens"), F.count_if(F.col("side") == "p").alias("unique_predicted_tokens"))
    ref = both.agg((F.sum(F.when(seen, F.col("_ref"))) / F.sum(F.length(text))).alias("r")) if reference else None
    head = sums.select(
        F.lit("all").alias("scope"), *_scored(sums, "token"), *_scored(sums, "boundary"), unique.select("unique_gold_tokens").scalar().alias("unique_gold_tokens"),
        unique.select("unique_predicted_tokens").scalar().alias("unique_predicted_tokens"), (ref.scalar() if ref is not None else F.lit(None).cast("double")).alias("reference_log_prob"),
    )
    if not categories:
        return head
    each = x.select("w", "p", "pb", F.size("g").alias("n"), F.posexplode(F.arrays_zip(F.col("g").alias("s"), F.col("c").alias("c"), F.col("g_units").alias("u"))).alias("i", "z"))
    lb, rb = F.col("z.s.lb"), F.col("z.s.rb")
    within = lambda f: F.size(F.filter("pb", f))
    ends = F.when(F.col("i") < F.col("n") - 1, F.array_contains("pb", rb).cast("int")).otherwise(0) + F.when(F.col("i") > 0, F.array_contains("pb", lb).cast("int")).otherwise(0)
    by = each.groupBy(F.col("z.c").alias("scope")).agg(
        w(F.array_contains("p", F.col("z.s")).cast("int"), "token_tp"), w(within(lambda b: (b > lb) & (b < rb)) + 1, "token_ap"), F.sum("w").alias("token_at"),
        w(ends, "boundary_tp"), w(within(lambda b: (b >= lb) & (b <= rb)), "boundary_ap"), F.sum(F.when((F.col("i") == 0) | (F.col("i") == F.col("n") - 1), 1).otherwise(2)).alias("boundary_at"),
        F.count_distinct("z.u").alias("unique_gold_tokens"),
    )
    none = F.lit(None)
    return head.unionByName(by.select("scope", *_scored(by, "token"), *_scored(by, "boundary"), "unique_gold_tokens", none.cast("long").alias("unique_predicted_tokens"), none.cast("double").alias("reference_log_prob")))


def match_counters(tokens: DataFrame, gold: DataFrame, word: str = "word", best: str = "tokens", n: str = "n") -> DataFrame:
    """(outcome, word, signature, n): how often each word is cut with each signature, by outcome.

    `gold` is (word, signatures) of words of several pieces, by the lower-cased word: those are `multi-correct` if the signature is one of
    them, else `multi-incorrect`. Words that it lacks are of one piece: `mono-correct` if they are whole, else `mono-incorrect`.
    """
    j = tokens.select(F.lower(word).alias("word"), T.signature(F.col(best)).alias("signature"), F.col(n).alias("n")).join(gold.select(F.col(word).alias("word"), "signatures"), "word", "left")
    many = F.when(F.array_contains("signatures", F.col("signature")), "multi-correct").otherwise("multi-incorrect")
    one = F.when(F.size("signature") == 1, "mono-correct").otherwise("mono-incorrect")
    return j.groupBy(F.when(F.col("signatures").isNotNull(), many).otherwise(one).alias("outcome"), "word", "signature").agg(F.sum("n").alias("n"))


def match_report(counters: DataFrame) -> DataFrame:
    """One row: right, all, and their share, of words of several pieces, of one piece, and of all."""
    s = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), F.col("n")).otherwise(0))
    c, k, o, m = s("multi-correct"), s("multi-correct", "multi-incorrect"), s("mono-correct"), s("mono-correct", "mono-incorrect")
    out = counters.agg(c.alias("multi_correct"), k.alias("multi"), o.alias("mono_correct"), m.alias("mono"))
    share = lambda a, b: F.try_divide(a, b)
    return out.select("*", share(F.col("multi_correct"), F.col("multi")).alias("multi_share"), share(F.col("mono_correct"), F.col("mono")).alias("mono_share"), share(F.col("multi_correct") + F.col("mono_correct"), F.col("multi") + F.col("mono")).alias("share"))


def piece_usage(counters: DataFrame) -> DataFrame:
    """(piece, types, n): in how many segmentations each piece is used, and how often."""
    pieces = T.cut_by_signature(F.col("word"), F.col("signature"))
    each = counters.select(F.array_join(pieces, "-").alias("s"), F.explode(pieces).alias("piece"), "n")
    return each.groupBy("piece").agg(F.count_distinct("s").alias("types"), F.sum("n").alias("n"))


def lattice_report(lats: DataFrame, gold: DataFrame, key: str = "word", spans: str = "spans") -> DataFrame:
    """One row over all lattices with gold spans: mean share of the gold path and of its edges, how often the best path is the gold one,
    micro scores of the best path's spans, and entropy per character."""
    share = lattice.gold_marginals(lats, gold, key, spans)
    best = lattice.viterbi(lats, key).select(key, T.spans(F.col("tokens"), ()).alias("_best"))
    h = lattice.entropies(lats, key).select(key, "entropy")
    j = share.join(best, key).join(h, key).join(gold.select(key, spans), key)
    hit = F.size(F.array_intersect("_best", F.transform(spans, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e")))))
    sums = j.agg(
        F.avg("path_p").alias("path_p"), F.avg(F.col("edge_p") / F.size(spans)).alias("edge_p"), F.avg(((hit == F.size(spans)) & (hit == F.size("_best"))).cast("double")).alias("whole"),
        F.sum(hit).alias("token_tp"), F.sum(F.size("_best")).alias("token_ap"), F.sum(F.size(spans)).alias("token_at"), (F.sum("entropy") / F.sum(F.length(key))).alias("entropy_per_char"),
    )
    return sums.select("path_p", "edge_p", "whole", *_scored(sums, "token"), "entropy_per_char")


def language_report(tokenized: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: lines, tokens (marks of begin and end included), and the negative log probability per character and per token.

    `tokenized` is what `encode.tokenize_lines` gives, `texts` the lines' own texts.
    """
    j = tokenized.join(texts.select(key, text), key)
    loss = encode.loss_per_unit(j.withColumn("loss", -F.col("logp")), "loss", text, "tokens")
    return j.agg(F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("tokens")).select("lines", "tokens", *[loss.select(c).scalar().alias(c) for c in ("per_char", "per_token")])


def split_report(rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, n, accuracy, expected_accuracy, loss, entropy): the evaluation of each split's rows (label, predicted, p_gold, loss, entropy, chars)."""
    return evaluate.accuracy(rows, [split]).join(encode.mean_losses(rows, [split]), split)


def dictionary_report(best: DataFrame, dictionary: DataFrame, word: str = "word", tokens: str = "tokens", segs: str = "segs", n: str = "n") -> DataFrame:
    """One row: words and occurrences, those that the dictionary holds, and of the latter's tokens those that some segmentation has as a span."""
    j = best.join(dictionary.select(word, segs), word, "left")
    known = F.flatten(F.transform(segs, lambda s: T.spans(s, ())))
    hit = F.size(F.filter(T.spans(F.col(tokens), ()), lambda x: F.array_contains(known, x)))
    j = j.select(F.col(segs).isNotNull().alias("_held"), F.col(n).alias("_n"), F.size(tokens).alias("_size"), hit.alias("_hit"))
    s = lambda c: F.sum(F.when(F.col("_held"), c).otherwise(0))
    out = j.agg(
        F.count("*").alias("words"), F.count_if("_held").alias("words_held"), F.sum("_n").alias("occurrences"), s(F.col("_n")).alias("occurrences_held"),
        s(F.col("_size") * F.col("_n")).alias("tokens"), s(F.col("_hit") * F.col("_n")).alias("tokens_held"),
    )
    return out.select("*", F.try_divide("tokens_held", "tokens").alias("precision"), F.try_divide("occurrences_held", "occurrences").alias("coverage"))


def usage_counters(outcomes: DataFrame, dictionary: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """One row: occurrences in all, replaced, in the dictionary, with several segmentations, and replaced by what they were already.

    `outcomes` is (word, tokens, best, outcome, n), `dictionary` (word, segs).
    """
    j = outcomes.join(dictionary.select(word, F.size("segs").alias("_k")), word, "left")
    s = lambda c: F.sum(F.when(c, F.col(n)).otherwise(0))
    replaced = F.col("outcome") == "replaced"
    return j.agg(F.sum(n).alias("total"), s(replaced).alias("replaced"), s(F.col("_k").isNotNull()).alias("gold"), s(F.col("_k") > 1).alias("ambiguous"), s(replaced & (F.col("tokens") == F.col("best"))).alias("matching"))


def hyperparameter_report(log: DataFrame, run: Sequence[str], size: str, metric: str, tie: str, columns: Sequence[str], scale: float = 100.0, digits: int = 2) -> DataFrame:
    """(size, run, tie, row): the best step of the best run of each size, with its columns as one formatted line."""
    best = runs.best_of_best(log, run, size, metric, tie)
    return best.select(size, *run, tie, runs.report_row(columns, scale, digits).alias("row"))


def category_accuracy(rows: DataFrame, entropies: DataFrame, key: str, category: str = "category") -> DataFrame:
    """(category, n, accuracy, entropy): accuracy of each category, and the mean entropy of its rows that have one."""
    kept = rows.join(entropies.select(key, "entropy"), key, "left").where(F.col("label").isNotNull() & (F.col("label") != -100))
    return kept.groupBy(category).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg("entropy").alias("entropy"))


def scatter(points: DataFrame, others: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, x, y): the points that both tables have."""
    return points.select(*keys, F.col(x).alias("x")).join(others.select(*keys, F.col(y).alias("y")), list(keys)).where("x is not null and y is not null")


def violin(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, least, q1, median, q3, most) of the values that are numbers."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    return good.groupBy(*groups).agg(F.count("*").alias("n"), q).select(*groups, "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("least", "q1", "median", "q3", "most"))])


def checkpoints(log: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place, rows): the rows of each checkpoint in their order, the checkpoints numbered by where they first occur."""
    from latticeflow.operators.vocab import rank_all

    rest = [c for c in log.columns if c != key]
    packed = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"), F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("rows"))
    return rank_all(packed, ["_first", key], "place").select(key, "place", "rows")


def word_list(words: DataFrame, word: str = "word", n: str = "n") -> tuple[DataFrame, int]:
    """(the distinct words in order, the number of occurrences)."""
    return words.select(word).distinct().orderBy(word), words.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


def without_first(rows: DataFrame, k: int, order: str = "line_no") -> DataFrame:
    """The rows after the first k, by the number of their line from 0."""
    return rows.where(F.col(order) >= k)


def rows_where(rows: DataFrame, equal: dict[str, str], like: dict[str, str]) -> DataFrame:
    """Rows whose columns equal the given values and match the given patterns; a null does neither."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    for c, pattern in like.items():
        rows = rows.where(F.col(c).rlike(pattern))
    return rows
