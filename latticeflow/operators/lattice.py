"""Lattices of segmentations: edges between characters, and inference over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import semiring as S
from latticeflow.functions import tensors
from latticeflow.functions import text as T
from latticeflow.functions.text import SPACE
from latticeflow.session import spread

#: Most rows of a vocabulary that is broadcast; larger ones are joined by a shuffle.
SMALL_VOCABULARY = 1_000_000


def check(max_blocks: int, max_unit: int, max_length: int | None, split: bool = False, references: bool = False) -> None:
    """Arguments that make no sense are refused before anything runs."""
    if min(max_blocks, max_unit, 1 if max_length is None else max_length) < 1:
        raise ValueError("blocks, unit length and block length must be positive")
    if max_blocks > 1 and not split:
        raise ValueError("more than one block needs splitting on spaces")
    if references and split:
        raise ValueError("references need a text that isn't split")


def small(vocab: DataFrame) -> DataFrame:
    """The vocabulary, marked for broadcast only if it is proven small."""
    return F.broadcast(vocab) if vocab.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY else vocab


def candidate_units(words: DataFrame, text: str, max_unit: int, keys: Sequence[str]) -> DataFrame:
    """(keys, s, e, token): all substrings of at most `max_unit` characters, bounded by the text's own end."""
    spots = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.length(text) - 1),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max_unit), F.length(text) - s)),
                lambda n: F.struct(s.alias("s"), (s + n).alias("e"), F.substr(F.col(text), s + 1, n).alias("token")),
            ),
        )
    )
    return words.where(F.length(text) > 0).select(*keys, F.explode(spots).alias("_u")).select(*keys, "_u.*")


def lattice_edges(words: DataFrame, vocab: DataFrame, max_unit: int = 4, max_length: int | None = 48, text: str = "word", unk: float | None = None, fallback: bool = False) -> DataFrame:
    """(word, s, e, token, logp): the edges of each distinct word that has at most `max_length` characters (None: of every word).

    With `fallback` a unit that isn't in the vocabulary is tried with the space mark; with `unk` a single character that is neither
    becomes [UNK] with that weight. Words are distinct, so each lattice is made once, however often the word occurs. Null, empty and
    too long words have no lattice.
    """
    check(1, max_unit, max_length)
    # distinct first: it combines a hot word's rows before the shuffle
    distinct = spread(words.where((F.length(text) > 0) & (F.lit(True) if max_length is None else F.length(text) <= max_length)).select(F.col(text).alias("word")).distinct(), "word")
    units = candidate_units(distinct, "word", max_unit, ["word"])
    known = small(vocab.select("token", "logp"))
    if not fallback and unk is None:
        return units.join(known, "token").select("word", "s", "e", "token", "logp")
    found = units.join(known, "token", "left")
    token, logp = F.when(F.col("logp").isNotNull(), F.col("token")), F.col("logp")
    if fallback:
        marked = small(vocab.where(F.col("token").startswith(SPACE)).select(F.col("token").alias("_marked"), F.col("logp").alias("_logp")))
        found = found.join(marked, F.concat(F.lit(SPACE), F.col("token")) == F.col("_marked"), "left")
        token, logp = F.coalesce(token, F.col("_marked")), F.coalesce(logp, F.col("_logp"))
    if unk is not None:
        single = (F.col("e") - F.col("s") == 1) & logp.isNull()
        token, logp = F.when(single, F.lit("[UNK]")).otherwise(token), F.when(single, F.lit(float(unk))).otherwise(logp)
    return found.select("word", "s", "e", token.alias("token"), logp.alias("logp")).where("logp is not null")


def sentence_edges(lines: DataFrame, vocab: DataFrame, key: str, chunks: str = "chunks", max_unit: int = 4, max_length: int = 48, max_blocks: int = 8, unk: float | None = None, specials: Sequence[str] = T.SPECIALS) -> DataFrame:
    """(key, block, s, e, token, logp): the chunks of each line packed into blocks, their edges placed in the block.

    An edge never leaves its chunk; a special chunk is one edge of length 1 (with weight 1 if the vocabulary lacks it). A chunk over
    `max_length`, or a line of more than `max_blocks` blocks, is an error at run time. Null and empty lists have no edges. Chunks are
    segmented once each, however often they occur.
    """
    check(max_blocks, max_unit, max_length, split=True)
    wrong = (F.size(chunks) > 0) & (F.exists(chunks, lambda c: T.chunk_length(c, specials) > max_length) | (F.size("_blocks") > max_blocks))
    fits = F.when(wrong, F.raise_error(F.lit("a line doesn't fit its blocks")).cast("boolean")).otherwise(True)
    packed = lines.select(key, chunks, T.pack_blocks(F.col(chunks), max_length, specials).alias("_blocks")).where(fits)
    block = packed.select(key, F.posexplode("_blocks").alias("block", "_b"))
    placed = block.select(key, "block", F.explode(T.with_boundaries(F.col("_b"), specials)).alias("x")).select(key, "block", F.col("x.unit").alias("word"), (F.col("x.rb") - T.chunk_length(F.col("x.unit"), specials)).alias("_at"))
    ordinary = placed.where(~F.col("word").isin(*specials))
    found = lattice_edges(ordinary.select("word"), vocab, max_unit, max_length, unk=unk)
    inner = ordinary.join(found, "word").select(key, "block", (F.col("_at") + F.col("s")).alias("s"), (F.col("_at") + F.col("e")).alias("e"), "token", "logp")
    known = F.broadcast(vocab.where(F.col("token").isin(*specials)).select(F.col("token").alias("word"), "logp"))  # the special tokens only
    special = placed.where(F.col("word").isin(*specials)).join(known, "word", "left")
    return inner.unionByName(special.select(key, "block", F.col("_at").alias("s"), (F.col("_at") + 1).alias("e"), F.col("word").alias("token"), F.coalesce("logp", F.lit(0.0)).alias("logp")))


def lattices(edges: DataFrame, key: str = "word", length: str | None = None) -> DataFrame:
    """One row per lattice: (key, len, edges), the edges ordered by start, then end."""
    packed = spread(edges, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "token", "logp"))).alias("edges"))
    return packed.withColumn("len", F.length(key) if length is None else F.expr(length))


def infer(lats: DataFrame) -> DataFrame:
    """Adds ends, alpha, beta, logz and edges with marginals `p` to lattices."""
    a = lats.withColumn("ends", S.by_end(F.col("edges"), F.col("len"))).withColumn("alpha", S.forward(F.col("ends")))
    b = a.withColumn("beta", S.backward(S.by_start_reversed(F.col("edges"), F.col("len")), F.col("len"))).withColumn("logz", S.log_z(F.col("alpha")))
    return b.withColumn("edges", S.marginals(F.col("edges"), F.col("alpha"), F.col("beta")))


def logz(lats: DataFrame, key: str = "word") -> DataFrame:
    ends = S.by_end(F.col("edges"), F.col("len"))
    return lats.withColumn("ends", ends).select(key, S.log_z(S.forward(F.col("ends"))).alias("logz"), S.path_count(F.col("ends")).alias("paths"))


def edge_marginals(lats: DataFrame, key: str = "word") -> DataFrame:
    return infer(lats).select(key, F.explode("edges").alias("x")).select(key, "x.*")


def entropies(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, logz, entropy, tokens): with the expected number of tokens of a path."""
    z = F.col("logz")
    return infer(lats).select(key, "logz", S.entropy(F.col("edges"), z).alias("entropy"), S.expectation(F.col("edges"), lambda x: F.lit(1)).alias("tokens"))


def expected_counts(lats: DataFrame, counts: DataFrame, key: str = "word", n: str = "n") -> DataFrame:
    """(token, expected): expected number of uses of each token, every lattice weighted by its number of occurrences."""
    m = edge_marginals(lats, key).join(counts.select(key, n), key)
    return m.groupBy("token").agg(F.sum(F.col("p") * F.col(n)).alias("expected"))


def em_step(lats: DataFrame, counts: DataFrame, key: str = "word") -> DataFrame:
    """(token, logp): the expected counts as log shares; tokens without any use are left out."""
    e = expected_counts(lats, counts, key).where("expected > 0")
    return e.select("token", F.ln(F.col("expected") / e.agg(F.sum("expected")).scalar()).alias("logp"))


def nbest(lats: DataFrame, n: int, key: str = "word") -> DataFrame:
    """(key, rank, tokens, logw, weight): the n best paths, ranks from 1, their log weight, and their share among the n."""
    best = lats.withColumn("best", S.nbest(S.by_end(F.col("edges"), F.col("len")), n)).withColumn("w", S.softmax_weights(F.col("best")))
    each = best.select(key, F.posexplode(F.arrays_zip("best", "w")).alias("rank", "x"))
    return each.select(key, (F.col("rank") + 1).alias("rank"), F.col("x.best.path").alias("tokens"), (-F.col("x.best.cost")).alias("logw"), F.col("x.w").alias("weight"))


def viterbi(lats: DataFrame, key: str = "word") -> DataFrame:
    return nbest(lats, 1, key).drop("rank", "weight")


def segmented(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, tokens, logw, logz): the best path with its log weight, and the log weight of all paths."""
    ends = S.by_end(F.col("edges"), F.col("len"))
    x = T.let(ends, lambda named: F.struct(F.get(S.nbest(named, 1), F.lit(0)).alias("best"), S.log_z(S.forward(named)).alias("logz")))
    each = lats.select(key, x.alias("x")).where("x.best is not null")
    return each.select(key, F.col("x.best.path").alias("tokens"), (-F.col("x.best.cost")).alias("logw"), "x.logz")


def nbest_of_blocks(lats: DataFrame, n: int, key: str, block: str = "block") -> DataFrame:
    """(key, rank, tokens, logw, weight): the n best paths of each text of several blocks, merged from the n best of every block.

    A text with a block that has no path has none. Each block's paths are found in its own row; the merge sees n paths a block.
    """
    best = lats.select(key, block, S.nbest(S.by_end(F.col("edges"), F.col("len")), n).alias("best"))
    packed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(block, "best"))).alias("b"))
    merged = packed.select(key, S.merge_nbest(F.transform("b", lambda x: x["best"]), n).alias("best")).withColumn("w", S.softmax_weights(F.col("best")))
    each = merged.select(key, F.posexplode(F.arrays_zip("best", "w")).alias("rank", "x"))
    return each.select(key, (F.col("rank") + 1).alias("rank"), F.col("x.best.path").alias("tokens"), (-F.col("x.best.cost")).alias("logw"), F.col("x.w").alias("weight"))


def reference_logprob(lats: DataFrame, references: DataFrame, key: str = "word", spans: str = "spans") -> DataFrame:
    """(key, ref_logp): log share of the paths that use the reference's spans [(s, e)] only; -Infinity if there is none."""
    both = lats.join(references.select(key, spans), key)
    own = F.filter(F.col("edges"), lambda x: F.exists(F.col(spans), lambda r: (r["s"] == x["s"]) & (r["e"] == x["e"])))
    z = lambda edges: S.log_z(S.forward(S.by_end(edges, F.col("len"))))
    return both.select(key, (z(own) - z(F.col("edges"))).alias("ref_logp"))


def gold_marginals(lats: DataFrame, references: DataFrame, key: str = "word", spans: str = "spans") -> DataFrame:
    """(key, path_p, edge_p): share of the reference's whole path, and the summed marginals of its edges."""
    m = infer(lats).select(key, "edges").join(references.select(key, spans), key)
    on = F.filter("edges", lambda x: F.exists(F.col(spans), lambda r: (r["s"] == x["s"]) & (r["e"] == x["e"])))
    edge = m.select(key, F.aggregate(on, F.lit(0.0), lambda a, x: a + x["p"]).alias("edge_p"))
    return reference_logprob(lats, references, key, spans).select(key, F.exp("ref_logp").alias("path_p")).join(edge, key)


def _batched(lats: DataFrame, keys: Sequence[str], columns: str, rows: Callable[[tensors.Lattices], Iterator[tuple[np.ndarray, list[np.ndarray]]]], token: str | None = None) -> DataFrame:
    """(keys, columns): `rows` gives, for a group of lattices, places of lattices and the columns' values; with `token` the last of these are edges' numbers.

    Runs over Arrow batches, without a shuffle. Lattices without a length have no rows.
    """
    plain = lats.select(*keys, F.coalesce("len", F.lit(0)).alias("_len"), *[F.col("edges")[c].alias(f"_{c}") for c in ("s", "e", "logp", *([] if token is None else ["token"]))])
    kinds = dict(lats.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), columns, *([] if token is None else [f"{token} string"])])
    names = [c.split("`")[1] if "`" in c else c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("_len").to_numpy(zero_copy_only=False).astype(np.int64)
            s, e, logp = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_s", "_e", "_logp"))
            of = np.repeat(np.arange(b.num_rows), b.column("_s").value_lengths().fill_null(0).to_numpy())
            within = lengths[of] > 0
            if not within.all():
                of, s, e, logp = of[within], s[within], e[within], logp[within]
            units = None if token is None else b.column("_token").flatten().filter(pa.array(within))
            with np.errstate(divide="ignore", invalid="ignore"):
                for g in tensors.lattices(lengths, of, s.astype(np.int64), e.astype(np.int64), logp):
                    for at, values in rows(g):
                        last = [pa.array(v) for v in values]
                        if units is not None:
                            last[-1] = units.take(last[-1])
                        if len(at):
                            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in keys), *last], names=names)

    return plain.mapInArrow(run, schema)


def conditional_marginals(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, node, side, s, e, token, log_p): P(edge | the path visits node); side is `before` or `after` the node.

    Impossible combinations have no row. All is computed within a lattice's own row; only the finished rows leave it.
    """

    def rows(g: tensors.Lattices) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for node, before, after in g.conditionals():
            for x, first in ((before, 0), (after, node)):
                r, start, slot = np.nonzero(x > S.NEG_INF)
                start = start + first
                ends = start + slot // g.copies + 1
                full = lambda v: np.full(len(r), v, dtype=np.int32)  # noqa: B023, E731
                yield g.rows[r], [full(node), full(x is after), start.astype(np.int32), ends.astype(np.int32), x[r, start - first, slot], g.edge[r, start, slot]]

    out = _batched(lats, [key], "node int, after int, s int, e int, log_p double", rows, token="token")
    return out.select(key, "node", F.when(F.col("after") == 1, "after").otherwise("before").alias("side"), "s", "e", "token", "log_p")


def _sums(g: tensors.Lattices) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, masses) of the edges before and after each node, by side, row and node."""
    shape = (2, len(g.rows), g.weights.shape[1] + 1)
    count, mass = np.zeros(shape, dtype=np.int64), np.zeros(shape)
    for node, *sides in g.conditionals():
        for i, x in enumerate(sides):
            on = x > S.NEG_INF
            count[i, :, node] = on.sum(axis=(1, 2))
            mass[i, :, node] = np.exp(np.where(on, x, S.NEG_INF)).sum(axis=(1, 2))
    return count, mass


def _places(g: tensors.Lattices) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, start, end, edges with these ends) of every edge."""
    r, start, slot = np.nonzero(g.edge >= 0)
    length = slot // g.copies
    same = (g.edge >= 0).reshape(*g.edge.shape[:2], -1, g.copies).sum(axis=3)[r, start, length]
    return r, slot, start, start + length + 1, same


def conditional_mass(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, node, edges, before, after): number and mass of the conditional marginals at each node, summed where they are made.

    Equals `conditional_marginals` grouped by key and node, without its rows, whose number is the square of a lattice's size.
    """

    def rows(g: tensors.Lattices) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        count, (before, after) = _sums(g)
        total = count.sum(axis=0)
        r, node = np.nonzero(total)
        yield g.rows[r], [node.astype(np.int32), total[r, node], before[r, node], after[r, node]]

    return _batched(lats, [key], "node int, edges long, before double, after double", rows)


def nonoverlapping(edges: DataFrame, key: str = "word") -> DataFrame:
    """Ordered pairs of edges of one lattice that don't overlap: an equi-join on the lattice with a residual."""
    a, b = (edges.select(key, *[F.col(c).alias(f"{c}_{i}") for c in ("s", "e", "token")]) for i in (1, 2))
    return a.join(b, key).where((F.col("s_1") >= F.col("e_2")) | (F.col("s_2") >= F.col("e_1")))


def attention_bias(lats: DataFrame, key: str = "word", block: str | None = None, causal: bool = False) -> DataFrame:
    """(key, src, tgt, log_p), edges as (s, e): how likely the path of the source edge passes the target edge.

    Targets before the source are conditioned on its start, targets after it on its end; the edge itself has 0, overlapping edges
    have no row. With `block`, edges of other blocks of the same key have their plain marginal. With `causal`, targets after the
    source are left out.
    """
    group = [key] if block is None else [key, block]
    edge = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))

    def rows(g: tensors.Lattices) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        row, slot, start, end, _ = _places(g)
        ints = lambda *xs: [x.astype(np.int32) for x in xs]
        for c in range(g.copies):  # an edge, and those with its ends
            other = slot // g.copies * g.copies + c
            on = g.edge[row, start, other] >= 0
            yield g.rows[row[on]], [*ints(start[on], end[on], start[on], end[on]), np.zeros(on.sum())]
        for node, before, after in g.conditionals():
            for x, first, at in ((before, 0, start), *([] if causal else [(after, node, end)])):
                for c in range(g.weights.shape[2]):  # sources of one length share what the node conditions
                    own = np.flatnonzero((at == node) & (slot == c))
                    r, s, k = np.nonzero(x[row[own]] > S.NEG_INF)
                    source = own[r]
                    yield g.rows[row[source]], [*ints(start[source], end[source], s + first, s + first + k // g.copies + 1), x[row[source], s, k]]

    flat = _batched(lats, group, "s int, e int, ts int, te int, log_p double", rows)
    own = flat.select(*group, F.struct("s", "e").alias("src"), F.struct(F.col("ts").alias("s"), F.col("te").alias("e")).alias("tgt"), "log_p")
    if block is None:
        return own
    m = marginal_edges(lats, group).select(*group, F.explode("edges").alias("b"))
    targets = m.where("b.p > 0").select(key, F.col(block).alias("tgt_block"), edge(F.col("b")).alias("tgt"), F.ln(F.col("b.p")).alias("log_p"))
    apart = F.col("tgt_block") < F.col(block) if causal else F.col("tgt_block") != F.col(block)
    other = m.select(*group, edge(F.col("b")).alias("src")).join(targets, key).where(apart)
    cols = [*group, "tgt_block", "src", "tgt", "log_p"]
    return own.withColumn("tgt_block", F.col(block)).select(*cols).unionByName(other.select(*cols))


def attention_mass(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, s, e, targets, mass) of each source edge: number and mass of the edges that it can attend, summed where they are made.

    Equals `attention_bias` grouped by key and source. Targets before an edge hang on its start only, those after it on its end, so the
    edges' sums are those of their two nodes.
    """

    def rows(g: tensors.Lattices) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        (c_before, c_after), (before, after) = _sums(g)
        r, _, s, e, same = _places(g)
        yield g.rows[r], [s.astype(np.int32), e.astype(np.int32), same + c_before[r, s] + c_after[r, e], same + before[r, s] + after[r, e]]

    return _batched(lats, [key], "s int, e int, targets long, mass double", rows)


def even_attention(lats: DataFrame, keys: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(keys, s, e, targets, over_count, over_mass) of each source edge: for how many targets, and how far, attention spread evenly over
    all of them exceeds `attention_bias` (its marginals, rounded to `digits`). Every pair is compared, and summed where it is made.
    """

    def rows(g: tensors.Lattices) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        b, n, slots = g.weights.shape
        count, found = np.zeros((2, b, n + 1), dtype=np.int64), []
        for node, *sides in g.conditionals():
            for i, x in enumerate(sides):
                on = x > S.NEG_INF
                count[i, :, node] = on.sum(axis=(1, 2))
                found.append(np.where(on, np.round(np.exp(x), digits), np.inf).reshape(b, -1))
        r, slot, s, e, same = _places(g)
        targets = np.ones((b, n, slots), dtype=np.int64)
        targets[r, s, slot] = same + count[0, r, s] + count[1, r, e]
        even, over_count, over_mass = 1 / targets, np.zeros((b, n, slots), dtype=np.int64), np.zeros((b, n, slots))
        for start in range(n):
            for k in range(min(slots, (n - start) * g.copies)):
                for p in (found[2 * start], found[2 * (start + k // g.copies + 1) + 1]):
                    over = np.maximum(even[:, start, k, None] - p, 0.0)
                    over_count[:, start, k] += np.count_nonzero(over, axis=1)
                    over_mass[:, start, k] += over.sum(axis=1)
        own = r, s, slot
        yield g.rows[r], [s.astype(np.int32), e.astype(np.int32), targets[own], over_count[own], over_mass[own]]

    return _batched(lats, keys, "s int, e int, targets long, over_count long, over_mass double", rows)


def marginal_edges(lats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lattices' edges with marginals, and their keys."""
    return infer(lats).select(*keys, "edges")


def mixture(edges: DataFrame, parts: int, key: str = "word", part: str = "k") -> DataFrame:
    """(key, s, e, token, p, log_c): a uniform mixture of `parts` lattices of each text.

    `p` is the edge's marginal averaged over the parts (a part without the edge, or without any path, adds 0), `log_c` the log share of the
    edge among the mixture's paths that visit its start. The mass of a node is that of the edges that leave it.
    """
    lats = spread(edges, key).groupBy(key, part).agg(F.array_sort(F.collect_list(F.struct("s", "e", "token", "logp"))).alias("edges")).withColumn("len", F.length(key))
    each = infer(lats).where(F.col("logz") > S.NEG_INF).select(key, F.explode("edges").alias("x")).select(key, "x.*")
    mean = each.groupBy(key, "s", "e", "token").agg((F.sum("p") / parts).alias("p"))
    nodes = mean.groupBy(key, "s").agg(F.sum("p").alias("_node"))
    out = mean.join(nodes, [key, "s"])
    return out.select(key, "s", "e", "token", "p", F.when(F.col("p") > 0, F.ln(F.col("p") / F.col("_node"))).alias("log_c"))


def mixture_entropy(mixed: DataFrame, key: str = "word") -> DataFrame:
    """(key, entropy): the entropy of the mixture's walk from node to node, in nats."""
    return mixed.where("p > 0").groupBy(key).agg(F.abs(F.sum(F.col("p") * F.col("log_c"))).alias("entropy"))


def forward_normalised(lats: DataFrame, key: str = "word") -> DataFrame:
    """(key, s, e, token, log_p): log share of an edge among the paths that visit its start."""
    x = infer(lats).select(key, "beta", F.explode("edges").alias("x")).select(key, "beta", "x.*")
    out = x.select(key, "s", "e", "token", (F.col("logp") + F.get("beta", F.col("e")) - F.get("beta", F.col("s"))).alias("log_p"))
    return out.where((F.col("log_p") > S.NEG_INF) & ~F.isnan("log_p"))


def with_temperature(lats: DataFrame, inverse: float) -> DataFrame:
    """Edges with their log weights multiplied by an inverse temperature."""
    return lats.withColumn("edges", F.transform("edges", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["token"].alias("token"), (x["logp"] * inverse).alias("logp"))))


def edge_order(edges: DataFrame, key: str = "word") -> DataFrame:
    """(key, idx, s, e, token): edges numbered from 0 by start, then end."""
    packed = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "token"))).alias("_x"))
    return packed.select(key, F.posexplode("_x").alias("idx", "_x")).select(key, "idx", "_x.*")


def task_mask(src: Column, tgt: Column, first: int) -> Column:
    """Whether one slot may attend another: the first special slots are seen only by themselves."""
    return (tgt >= first) | (src == tgt)
