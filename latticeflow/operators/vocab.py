"""Vocabularies: reading, building, normalising, comparing and sampling them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.functions import tensors
from latticeflow.functions.text import cut_long

#: Expected count of a character that no path uses; it stays possible.
LEAST = 1e-6


def dense_ids(tokens: DataFrame, token: str = "token", line: str = "line_no") -> DataFrame:
    """(token_id, token): ids from 0 by first occurrence; repeated tokens keep their first line. Null tokens are dropped.

    The ids need one global order; it runs over distinct tokens in sorted ranges, with the ranges' sizes added up.
    """
    first = tokens.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(line).alias("_first"))
    return rank_all(first, ["_first", token], "token_id").select("token_id", F.col(token).alias("token"))


def rank_all(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """A dense global rank from 0 without one task holding all rows: range partitions, ranked apart, then offset.

    `order` must be unique per row.
    """
    from latticeflow.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", rank).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def last_weights(weights: DataFrame) -> DataFrame:
    """One row per token of a weights file; the last line wins."""
    return weights.groupBy("token").agg(F.max_by("w", "line_no").alias("w"))


def word_counts(docs: DataFrame, text: str = "text", keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """(keys, word, n): words of lower-cased texts, split at spaces; empty words are dropped, null texts have none.

    With `block`, a word of more characters is cut into blocks of that many, all of which count.
    """
    chunks = F.split(F.lower(text), " ", -1)
    words = docs.select(*keys, F.explode(chunks if block is None else cut_long(chunks, block)).alias("word")).where("word <> ''")
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def substrings(words: DataFrame, max_length: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, token, n): how often each substring of at most `max_length` characters occurs, by distinct words and their counts."""
    spots = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("word") - s + 1)), lambda n: F.substr("word", s, n))))
    )
    return words.select(*keys, spots.alias("token"), "n").groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def build_vocabulary(words: DataFrame, max_length: int = 4, min_count: int = 2) -> DataFrame:
    """(token, n, logp): all characters, and the substrings that occur `min_count` times or more; logp to 6 digits."""
    kept = substrings(words, max_length).where((F.length("token") == 1) | (F.col("n") >= min_count))
    return with_log_share(kept)


def with_log_share(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.select("token", "n", F.round(F.ln(F.col("n") / total), 6).alias("logp"))


def normalise(weights: DataFrame, logp: str = "logp", keys: Sequence[str] = ()) -> DataFrame:
    """Log weights less their log-sum-exp (per key), added as `normalised`; two passes of partial aggregates."""
    if not keys:
        named = weights.withColumn("_m", weights.agg(F.max(logp)).scalar())
        total = named.agg(F.first("_m") + F.ln(F.sum(F.exp(F.col(logp) - F.col("_m"))))).scalar()
        return weights.withColumn("normalised", F.col(logp) - total)
    top = weights.groupBy(*keys).agg(F.max(logp).alias("_m"))
    joined = weights.join(top, list(keys))
    total = joined.groupBy(*keys).agg((F.first("_m") + F.ln(F.sum(F.exp(F.col(logp) - F.col("_m"))))).alias("_z"))
    out = weights.join(total, list(keys))
    return out.withColumn("normalised", F.col(logp) - F.col("_z")).drop("_z")


def l1(weights: DataFrame, avoid: Sequence[str] = ()) -> DataFrame:
    """One row: the mean real weight of all tokens but the given ones."""
    return weights.where(~F.col("token").isin(*avoid)).agg(F.avg(F.exp("logp")).alias("l1"))


def shared_tokens(a: DataFrame, b: DataFrame, specials: Sequence[str] = ()) -> DataFrame:
    """Tokens of both vocabularies, without the special ones."""
    return a.select("token").intersect(b.select("token")).where(~F.col("token").isin(*specials))


def movers(a: DataFrame, b: DataFrame, specials: Sequence[str] = ()) -> DataFrame:
    """(token, p_a, p_b, moved): the shared tokens by how far their weight moved."""
    pa = a.where(~F.col("token").isin(*specials)).select("token", F.exp("logp").alias("p_a"))
    pb = b.select("token", F.exp("logp").alias("p_b"))
    return pa.join(pb, "token").withColumn("moved", F.abs(F.col("p_a") - F.col("p_b")))


def subsample(weights: DataFrame, k: int, seed: int, specials: Sequence[str] = ()) -> DataFrame:
    """k tokens drawn without replacement by weight (exponential keys hashed from seed and token), and all special ones."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "token"), F.lit(2**52)).cast("double") + 1) / (2.0**52 + 1)
    ordinary = weights.where(~F.col("token").isin(*specials))
    drawn = ordinary.withColumn("_key", -F.ln(u) / F.exp("logp")).orderBy("_key", "token").limit(k).drop("_key")
    return drawn.unionByName(weights.where(F.col("token").isin(*specials)))


def clamped(weights: DataFrame, epsilon: float = 1e-6, specials: Sequence[str] = (), pin_singletons: bool = False) -> DataFrame:
    """Log weights at least ln(epsilon); special tokens (and, if wanted, single characters) have weight 1."""
    pinned = F.col("token").isin(*specials)
    if pin_singletons:
        pinned = pinned | (F.length("token") == 1)
    return weights.withColumn("logp", F.when(pinned, F.lit(0.0)).otherwise(F.greatest(F.col("logp"), F.ln(F.lit(epsilon)))))


def length_bias(vocab: DataFrame, tolerance: float = 1e-10) -> float:
    """x such that the log-sum-exp of length * x over the vocabulary is 1, by bisection over the counts of lengths."""
    import math

    counts = [(r["l"], r["n"]) for r in vocab.groupBy(F.length("token").alias("l")).agg(F.count("*").alias("n")).collect()]  # one row a length
    value = lambda x: (m := max(n_l * x for n_l, _ in counts)) + math.log(sum(n * math.exp(n_l * x - m) for n_l, n in counts)) - 1
    lo, hi = -1.0, 1.0
    while value(lo) > 0:
        lo *= 2
    while value(hi) < 0:
        hi *= 2
    while hi - lo > tolerance:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def type_entropy(expected: DataFrame, count: str = "expected") -> DataFrame:
    """One row: the entropy of the tokens' shares of the expected counts."""
    p = F.col("_p")
    shares = expected.where(F.col(count) > 0).select((F.col(count) / expected.agg(F.sum(count)).scalar()).alias("_p"))
    return shares.agg((-F.sum(p * F.ln(p))).alias("type_entropy"))


def initialised(tokens: DataFrame, sigma: float = 0.0, mu: float = 0.0, seed: int = 0) -> DataFrame:
    """(token, logp): first log weights, `mu` for all, or normally distributed around it with deviation `sigma` (weights then are lognormal).

    The draw hangs on seed and token only, not on partitions.
    """
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "token"), F.lit(2**52)).cast("double") + 0.5) / 2.0**52
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    return tokens.select("token", (F.lit(float(mu)) + (normal * sigma if sigma else F.lit(0.0))).alias("logp"))


def train(words: DataFrame, vocab: DataFrame, size: int, max_unit: int = 4, max_length: int = 48, shrink: float = 0.75, rounds: int = 16, tolerance: float = 1e-3) -> DataFrame:
    """(token, logp): a vocabulary of at most `size` units (and all characters), by expectation maximisation and pruning.

    Each round takes an EM step; then, while there are too many units, the least used are dropped, down to `shrink` of the present number but
    not below `size`; characters stay. It ends when the size is reached and the log likelihood per word grows by less than `tolerance`, or after `rounds`.
    While there are more than `lattice.SMALL_VOCABULARY` units, each round makes its lattices anew by a shuffle join, and their lineage is cut.
    From then on the lattices are made once and keep the units' numbers; a round sends the weights to them, by number.
    """
    from latticeflow.operators import lattice as L
    from latticeflow.session import cut

    before = None
    vocab = cut(vocab.select("token", "logp"))
    total = words.agg(F.sum("n")).first()[0] or 1
    for done in range(rounds):
        n = vocab.count()
        if n <= L.SMALL_VOCABULARY:
            return _train_numbered(words, vocab, size, max_unit, max_length, shrink, rounds - done, tolerance, total, before)
        lats = cut(L.lattices(L.lattice_edges(words, vocab, max_unit, max_length)))
        z = L.logz(lats).join(words, "word").where(F.col("logz") > float("-inf")).agg(F.sum(F.col("logz") * F.col("n"))).first()[0] or 0.0
        expected = cut(L.expected_counts(lats, words))
        if n <= size and before is not None and abs(z / total - before) < tolerance:
            break
        before = z / total
        keep = max(size, int(n * shrink)) if n > size else n
        single = F.length("token") == 1
        characters = vocab.where(single).select("token")
        longer = expected.where(~single & (F.col("expected") > 0)).orderBy(F.desc("expected"), "token").limit(max(0, keep - characters.count()))
        least = F.lit(LEAST)
        kept = characters.join(expected, "token", "left").select("token", F.greatest(F.coalesce("expected", least), least).alias("expected")).unionByName(longer)
        vocab = cut(kept.select("token", F.ln(F.col("expected") / kept.agg(F.sum("expected")).scalar()).alias("logp")))
    return vocab


def _numbered_lattices(words: DataFrame, ids: DataFrame, max_unit: int, max_length: int | None) -> DataFrame:
    """Groups of lattices as arrays of units' numbers, with the words' counts; cut."""
    from latticeflow.operators import lattice as L
    from latticeflow.session import cut

    edges = L.lattice_edges(words, ids.select("token", F.col("id").cast("double").alias("logp")), max_unit, max_length)  # numbers in place of weights
    packed = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.col("logp").cast("int").alias("id")))).alias("x"))
    counted = packed.join(words.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")), "word")
    plain = counted.select(F.length("word").alias("len"), "n", *[F.col("x")[c].alias(c) for c in ("s", "e", "id")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, n = (b.column(c).to_numpy().astype(np.int64) if c == "len" else b.column(c).to_numpy() for c in ("len", "n"))
            s, e, unit = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("s", "e", "id"))
            of = np.repeat(np.arange(b.num_rows), b.column("s").value_lengths().to_numpy())
            for g in tensors.lattices(lengths, of, s, e, np.zeros(len(s)), square=False):
                units = np.where(g.edge >= 0, unit[g.edge], -1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"nodes": [units.shape[1]], "copies": [g.copies], "lengths": [g.lengths.tobytes()], "n": [n[g.rows].tobytes()], "units": [units.tobytes()]}, schema=kind)

    kind = pa.schema([("nodes", pa.int32()), ("copies", pa.int32()), ("lengths", pa.binary()), ("n", pa.binary()), ("units", pa.binary())])
    return cut(plain.mapInArrow(pack, "nodes int, copies int, lengths binary, n binary, units binary"))


def _train_numbered(words: DataFrame, vocab: DataFrame, size: int, max_unit: int, max_length: int | None, shrink: float, rounds: int, tolerance: float, total: float, before: float | None) -> DataFrame:
    """The rounds of `train` for a vocabulary that fits on the driver, its units numbered in the order of tokens."""
    from latticeflow.session import cut

    spark = words.sparkSession
    ids = cut(rank_all(vocab.where("token is not null"), ["token"], "id"))
    known = ids.select("id", "logp", (F.length("token") == 1).alias("single")).toArrow()  # at most SMALL_VOCABULARY rows
    order = np.argsort(known["id"].to_numpy())
    logp, single = known["logp"].to_numpy()[order], known["single"].to_numpy()[order]
    lats, alive = _numbered_lattices(words, ids, max_unit, max_length), np.ones(len(logp), dtype=bool)

    for _ in range(rounds):
        weights = spark.sparkContext.broadcast(np.append(logp, -np.inf))  # number -1 is no unit

        def step(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            w = weights.value
            expected, z = np.zeros(len(w)), 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                for b in batches:
                    for r in b.to_pylist():
                        lengths, n = np.frombuffer(r["lengths"], dtype=np.int64), np.frombuffer(r["n"])
                        units = np.frombuffer(r["units"], dtype=np.int32).reshape(len(n), r["nodes"], -1)
                        g = tensors.Lattices(np.arange(len(n)), lengths, w[units], units, r["copies"])
                        al, be = g.forward(), g.backward()
                        logz = al[g.rows, lengths]
                        on = logz > -np.inf
                        z += float((logz[on] * n[on]).sum())
                        p = np.exp(al[:, :-1, None] + g.weights + g.ends(be) - logz[:, None, None]) * n[:, None, None]
                        expected += np.bincount(units[on].ravel() + 1, weights=p[on].ravel(), minlength=len(w))
            used = np.flatnonzero(expected[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(expected[1:][used], z))], names=["id", "expected"])

        got = lats.mapInArrow(step, "id long, expected double").groupBy("id").agg(F.sum("expected").alias("expected")).toArrow()
        weights.destroy()
        expected, at = np.zeros(len(logp) + 1), got["id"].to_numpy()
        expected[at] = got["expected"].to_numpy()
        z, expected, n = expected[-1], expected[:-1], int(alive.sum())
        if n <= size and before is not None and abs(z / total - before) < tolerance:
            break
        before = z / total
        keep = max(size, int(n * shrink)) if n > size else n
        longer = np.flatnonzero(alive & ~single & (expected > 0))
        longer = longer[np.lexsort((longer, -expected[longer]))[: max(0, keep - int(single.sum()))]]
        value = np.where(single, np.maximum(expected, LEAST), 0.0)
        value[longer] = expected[longer]
        alive = value > 0
        logp = np.log(value / value.sum(), out=np.full(len(value), -np.inf), where=alive)
    kept = np.flatnonzero(alive)
    trained = spark.createDataFrame(pa.table({"id": pa.array(kept), "logp": pa.array(logp[kept])}), "id long, logp double")
    return cut(ids.select("token", "id").join(F.broadcast(trained), "id").select("token", "logp"))
