"""From segmentations to model inputs: ids, positions, masks, labels, packed blocks and tokenized lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import semiring as S
from latticeflow.functions import text as T
from latticeflow.operators import lattice as L


def unit_info(vocab: DataFrame, specials: Sequence[str] = T.SPECIALS) -> DataFrame:
    """The vocabulary with `is_special`, `is_singleton` and `len`."""
    special = F.col("token").isin(*specials)
    return vocab.withColumns({"is_special": special, "is_singleton": ~special & (F.length("token") == 1), "len": F.when(special, 1).otherwise(F.length("token"))})


def lattice_inputs(edges: DataFrame, vocab: DataFrame, keys: Sequence[str], block: str | None = None, length: int = 48) -> DataFrame:
    """(keys, input_ids, position_ids): a row per lattice (or group of blocks); edges in order of block, start and end.

    Positions are those of characters, blocks being `length` apart. Edges without an id are left out.
    """
    at = F.lit(0) if block is None else F.col(block)
    known = edges.join(L.small(vocab.select("token", "token_id")), "token")
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("b"), F.col("s").alias("s"), F.col("e").alias("e"), F.col("token_id").alias("id")))).alias("_x"))
    return rows.select(*keys, F.transform("_x", lambda x: x["id"]).alias("input_ids"), F.transform("_x", lambda x: x["b"] * length + x["s"]).alias("position_ids"))


def padded(ids: Column, width: int, pad: int) -> Column:
    """An array of exactly `width` ids: padded at its end. A longer one is kept whole."""
    return F.when(F.size(ids) >= width, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids))))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1))


def path_inputs(paths: DataFrame, vocab: DataFrame, keys: Sequence[str], tokens: str = "tokens", characters: bool = False) -> DataFrame:
    """(keys, input_ids, position_ids) of best paths: positions count tokens, or the characters before each token.

    Tokens without an id are left out.
    """
    starts = T.prefix_sums(F.transform(tokens, lambda t: T.chunk_length(t)), exclusive=True)
    each = paths.select(*keys, F.posexplode(F.arrays_zip(F.col(tokens).alias("t"), F.slice(starts, 1, F.size(tokens)).alias("c"))).alias("i", "x"))
    known = each.select(*keys, "i", F.col("x.t").alias("token"), F.col("x.c").alias("c")).join(L.small(vocab.select("token", "token_id")), "token")
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "c", "token_id"))).alias("_x"))
    return rows.select(*keys, F.transform("_x", lambda x: x["token_id"]).alias("input_ids"), F.transform("_x", lambda x: x["c"] if characters else x["i"]).alias("position_ids"))


def label_rows(examples: DataFrame, key: str, labels: str, vocab: DataFrame, stride: int = 1, ignore: int = -100) -> DataFrame:
    """(key, pos, label_id): label j at place j * stride; labels without an id are ignored ones."""
    each = examples.select(key, F.posexplode(labels).alias("j", "token"))
    return each.join(L.small(vocab.select("token", "token_id")), "token", "left").select(key, (F.col("j") * stride).alias("pos"), F.coalesce("token_id", F.lit(ignore)).alias("label_id"))


def causal_pairs(edges: DataFrame, key: str = "word") -> DataFrame:
    """(key, src, tgt): a source edge with the edges that end where it starts or before, and itself; an equi-join with a residual."""
    edge = lambda i: [F.col(key), F.struct("s", "e").alias(i)]
    a, b = edges.select(*edge("src")), edges.select(*edge("tgt"))
    return a.join(b, key).where((F.col("tgt.e") <= F.col("src.s")) | (F.col("src") == F.col("tgt")))


def repack(tokens: Column, chunks: Column, max_length: int) -> Column:
    """Tokens of a line, laid into the blocks of its packed chunks: an array of tokens per block."""
    ends = T.prefix_sums(F.transform(T.pack_blocks(chunks, max_length), lambda b: T.block_length(b)))
    placed = T.with_boundaries(tokens)
    return F.transform(ends, lambda e, i: F.transform(F.filter(placed, lambda t: (t["rb"] <= e) & (t["rb"] > F.when(i > 0, F.get(ends, i - 1)).otherwise(0))), lambda t: t["unit"]))


def tokenize_lines(lines: DataFrame, best: DataFrame, key: str, chunks: str = "chunks", bos: str = "[BOS]", eos: str = "[EOS]") -> DataFrame:
    """(key, logp, tokens): each line's words replaced by their best paths, between the marks of begin and end.

    `logp` is the log probability of these paths: the sum of their weights less log Z of each word's lattice; `best` is
    (word, tokens, logw, logz) of distinct words. Words without a path stay as they are and add nothing. Lines without words have no row.
    """
    known = best.select("word", F.col("tokens").alias("_t"), (F.col("logw") - F.col("logz")).alias("_w"))
    each = lines.select(key, F.posexplode(chunks).alias("pos", "word")).join(known, "word", "left")
    rows = each.groupBy(key).agg(
        F.sum(F.coalesce("_w", F.lit(0.0))).alias("logp"),
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_t", F.array("word")).alias("t")))).alias("_x"),
    )
    return rows.select(key, "logp", F.concat(F.array(F.lit(bos)), F.flatten(F.transform("_x", lambda x: x["t"])), F.array(F.lit(eos))).alias("tokens"))


def gold_ids(pieces: DataFrame, vocab: DataFrame, key: str, units: str = "pieces", unk: str = "[UNK]") -> DataFrame:
    """(key, ids): pieces looked up as they are, then with the space mark if first, then as unknown."""
    v = vocab.select("token", "token_id")
    each = pieces.select(key, F.posexplode(units).alias("i", "token"))
    plain = each.join(L.small(v), "token", "left")
    marked = L.small(v.select(F.col("token").alias("_m"), F.col("token_id").alias("_mid")))
    both = plain.join(marked, F.when(F.col("i") == 0, F.concat(F.lit(T.SPACE), F.col("token"))) == F.col("_m"), "left")
    other = v.where(F.col("token") == unk).agg(F.max("token_id")).scalar()
    rows = both.withColumn("_unk", other).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("token_id", "_mid", "_unk").alias("id")))).alias("_x"))
    return rows.select(key, F.transform("_x", lambda x: x["id"]).alias("ids"))


def mean_losses(batches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean loss of batches, and entropy per character; batches without entropy (null or 0) don't count in the latter."""
    h = (F.col("entropy") != 0) & F.col("entropy").isNotNull()
    return (batches.groupBy(*keys) if keys else batches).agg(
        F.avg("loss").alias("loss"), F.try_divide(F.sum(F.when(h, F.col("entropy") * F.col("chars"))), F.sum(F.when(h, F.col("chars")))).alias("entropy")
    )


def loss_per_unit(rows: DataFrame, loss: str = "loss", text: str = "text", tokens: str = "tokens") -> DataFrame:
    """One row: summed loss per character and per token."""
    return rows.agg((F.sum(loss) / F.sum(F.length(text))).alias("per_char"), (F.sum(loss) / F.sum(F.size(tokens))).alias("per_token"))


def dense_transitions(lats: DataFrame, vocab: DataFrame, max_unit: int, key: str = "word", pad: int = 0, reverse: bool = False) -> DataFrame:
    """(key, ids, mask): for each unit length (outer array) and place, the id of the edge of that length that ends there, or `pad`.

    With `reverse` places are counted from the text's end and an edge stands where it begins, for the backward pass. mask is 1 where there is an edge.
    """
    each = lats.select(key, "len", F.explode("edges").alias("x")).select(key, "len", "x.*")
    known = each.join(L.small(vocab.select("token", "token_id")), "token")
    at = F.col("len") - F.col("s") - 1 if reverse else F.col("e") - 1
    packed = known.groupBy(key, "len").agg(F.map_from_entries(F.collect_list(F.struct(((F.col("e") - F.col("s") - 1) * F.col("len") + at).cast("int"), F.col("token_id").cast("int")))).alias("m"))
    cell = lambda m, j: F.element_at("m", (m * F.col("len") + j).cast("int"))
    grid = lambda f: F.transform(F.sequence(F.lit(0), F.lit(max_unit - 1)), lambda m: F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda j: f(cell(m, j))))
    return packed.select(key, grid(lambda v: F.coalesce(v, F.lit(pad))).alias("ids"), grid(lambda v: F.when(v.isNull(), 0).otherwise(1)).alias("mask"))


def serial_inputs(edges: DataFrame, vocab: DataFrame, key: str = "word", node: int | None = None) -> DataFrame:
    """(key, input_ids, starts, ends, node_ids): edges in order of start and end, and with `node` a node token of that id for each place.

    starts and ends are the nodes before and after each edge, by which sums over nodes are looked up; a node token begins and ends at its node.
    """
    known = edges.join(L.small(vocab.select("token", "token_id")), "token")
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "token_id"))).alias("_x"))
    last = F.array_max(F.transform("_x", lambda x: x["e"]))
    nodes = F.array().cast("array<int>") if node is None else F.transform(F.sequence(F.lit(0), last), lambda _: F.lit(node))
    return rows.select(key, F.transform("_x", lambda x: x["token_id"]).alias("input_ids"), F.transform("_x", lambda x: x["s"]).alias("starts"), F.transform("_x", lambda x: x["e"]).alias("ends"), nodes.alias("node_ids"))


def language_dataset(lines: DataFrame, best: DataFrame, vocab: DataFrame, key: str, chunks: str = "chunks", unk: int = 0) -> DataFrame:
    """(key, input_ids, position_ids, input_mask, labels, length, ntokens, text) of segmented lines, one row per line that has words.

    labels are the next ids, -100 for the last; length counts characters, ntokens ids. Units without an id have `unk`.
    """
    tokens = tokenize_lines(lines, best, key, chunks).select(key, "tokens")
    each = tokens.select(key, F.posexplode("tokens").alias("i", "token")).join(L.small(vocab.select("token", "token_id")), "token", "left")
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("token_id", F.lit(unk)).cast("int").alias("id")))).alias("_x"), F.sum(T.chunk_length(F.col("token"))).cast("int").alias("length"))
    ids = F.transform("_x", lambda x: x["id"])
    out = packed.select(key, ids.alias("input_ids"), "length", F.size("_x").alias("ntokens"))
    shifted = F.concat(F.slice("input_ids", 2, F.greatest(F.size("input_ids") - 1, F.lit(0))), F.array(F.lit(-100)))
    out = out.select(key, "input_ids", F.sequence(F.lit(0), F.size("input_ids") - 1).alias("position_ids"), F.transform("input_ids", lambda _: F.lit(1)).alias("input_mask"), shifted.alias("labels"), "length", "ntokens")
    return out.join(lines.select(key, F.array_join(chunks, " ").alias("text")), key)


def _blocks(lines: DataFrame, vocab: DataFrame, key: str, text: str, split: bool, max_blocks: int, max_unit: int, max_length: int, unk: float | None, temperature: float) -> DataFrame:
    """(key, block, edges, len): the lattices of each text's blocks; without `split` the text is one chunk."""
    L.check(max_blocks, max_unit, max_length, split)
    chunks = T.space_chunks(F.col(text)) if split else F.array(text)
    known = lines.where(F.length(text) > 0).select(key, chunks.alias("chunks"))
    edges = L.sentence_edges(known, vocab, key, max_unit=max_unit, max_length=max_length, max_blocks=max_blocks, unk=unk)
    packed = edges.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("s", "e", "token", "logp"))).alias("edges"))
    # a block without any edge is one without a path
    sizes = known.select(key, F.posexplode(T.pack_blocks(F.col("chunks"), max_length)).alias("block", "_c")).select(key, "block", T.block_length(F.col("_c")).alias("len"))
    none = F.array().cast(f"array<{S.EDGE}>")
    whole = sizes.join(packed, [key, "block"], "left").withColumn("edges", F.coalesce("edges", none))
    return L.with_temperature(whole, temperature) if temperature != 1 else whole


def tokenize_lattice(
    lines: DataFrame, vocab: DataFrame, key: str, text: str = "text", split: bool = True, max_blocks: int = 8, max_unit: int = 12, max_length: int = 48, unk: float | None = None, temperature: float = 1.0,
    references: DataFrame | None = None,
) -> DataFrame:
    """(key, input_ids, position_ids, marginals, logz, entropy[, ref_logp]): each text's lattice of all its blocks, one row a text.

    `vocab` is (token, token_id, logp); `temperature` multiplies the log weights. Edges are in order of block, start and end; positions count
    characters, blocks being `max_length` apart; logz and entropy are summed over the blocks. `references`, for texts that aren't
    split, is (key, spans) and adds the log share of their paths. Null and empty texts, and those without a path through some block, have no row;
    a text that doesn't fit its blocks is an error at run time. A group of texts is a key of several columns made one.
    """
    L.check(max_blocks, max_unit, max_length, split, references is not None)
    blocks = _blocks(lines, vocab, key, text, split, max_blocks, max_unit, max_length, unk, temperature)
    x = L.infer(blocks).withColumn("_h", S.entropy(F.col("edges"), F.col("logz")))
    each = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "edges"))).alias("_b"), F.sum("logz").alias("logz"), F.sum("_h").alias("entropy")).where(F.col("logz") > S.NEG_INF)
    flat = each.select(key, "logz", "entropy", F.posexplode(F.flatten(F.transform("_b", lambda b: F.transform(b["edges"], lambda e: F.struct((b["block"] * max_length + e["s"]).alias("at"), e["token"].alias("token"), e["p"].alias("p")))))).alias("_i", "_e"))
    ids = flat.select(key, "logz", "entropy", "_i", "_e.*").join(L.small(vocab.select("token", "token_id")), "token", "left")
    row = F.array_sort(F.collect_list(F.struct("_i", "token_id", "at", "p")))
    out = ids.groupBy(key, "logz", "entropy").agg(row.alias("_x"))
    out = out.select(key, F.transform("_x", lambda r: r["token_id"]).alias("input_ids"), F.transform("_x", lambda r: r["at"]).alias("position_ids"), F.transform("_x", lambda r: r["p"]).alias("marginals"), "logz", "entropy")
    return out if references is None else out.join(L.reference_logprob(blocks, references, key), key, "left")


def tokenize_nbest(
    lines: DataFrame, vocab: DataFrame, key: str, n: int = 1, text: str = "text", split: bool = True, max_blocks: int = 8, max_unit: int = 12, max_length: int = 48, unk: float | None = None, temperature: float = 1.0,
    characters: bool = False, max_tokens: int | None = None,
) -> DataFrame:
    """(key, rank, tokens, input_ids, position_ids, logw, weight): the n best paths of each text over all its blocks.

    Positions count tokens or, with `characters`, the characters before each; `max_tokens` keeps that many of each path's ids. Texts without a path
    have no row.
    """
    best = L.nbest_of_blocks(_blocks(lines, vocab, key, text, split, max_blocks, max_unit, max_length, unk, temperature), n, key)
    ids = path_inputs(best, vocab, [key, "rank"], characters=characters)
    cut = lambda c: F.slice(c, 1, max_tokens).alias(c) if max_tokens else F.col(c)
    return best.join(ids, [key, "rank"]).select(key, "rank", "tokens", cut("input_ids"), cut("position_ids"), "logw", "weight")


#: Tokenizers by mode; further ones can be registered.
MODES: dict[str, Callable[..., DataFrame]] = {"lattice": tokenize_lattice, "nbest": tokenize_nbest, "1best": tokenize_nbest}


def tokenizer(mode: str) -> Callable[..., DataFrame]:
    if mode not in MODES:
        raise ValueError(f"no tokenizer for mode {mode!r}; known are {sorted(MODES)}")
    return MODES[mode]
