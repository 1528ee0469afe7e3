"""Queries over texts, segmentations and skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions import text as T
from latticeflow.operators import dynamics, encode, evaluate, lattice, morphology, packed, runs, skipgram, vocab
from latticeflow.operators.records import first_delivery
from latticeflow.plans import lattice_queries as LQ
from latticeflow.sources import readers
from latticeflow.session import cut, table, wide_scan

#: Characters of a block of packed chunks.
BLOCK = 64
#: Marks of empty slots.
NO_UNIT = ("[SP1]", "[SP2]", "[SP3]")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """(sent_id, text_str, chunks) of the sentences with a text, each in its first delivery."""
    x = first_delivery(table(s, d, "sentences"), "sent_id", "read_at", ["text_str"]).where("text_str is not null")
    return x.withColumn("chunks", F.filter(F.split("text_str", " ", -1), lambda c: c != ""))


def _words_of_lines(s: SparkSession, d: str) -> DataFrame:
    """(sent_id, chunks): lower-cased words of the sentences, long ones cut into blocks."""
    return cut(_lines(s, d).select("sent_id", T.cut_long(F.transform("chunks", lambda c: F.lower(c)), LQ.LENGTH).alias("chunks")).where(F.size("chunks") > 0))


def pretokenize(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("sent_id", F.posexplode(T.pretokens(F.col("text_str"))).alias("pos", "token"))


def space_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks between spaces with the space mark, empty ones kept."""
    return _lines(s, d).select("sent_id", F.posexplode(T.space_chunks(F.col("text_str"))).alias("pos", "chunk"))


def mark_spaces(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("sent_id", T.mark_spaces(F.col("text_str")).alias("marked"))


def length_filter(s: SparkSession, d: str) -> DataFrame:
    return readers.short_texts(_lines(s, d).select("sent_id", F.col("text_str").alias("text")))


def special_prefix(s: SparkSession, d: str) -> DataFrame:
    m = readers.morpheme_examples(table(s, d, "morpheme").select("id", "label", "text", "features", "segmentation").distinct())
    return m.select("id", "text", F.size("features").alias("n_features")).distinct()


def gold_slots(s: SparkSession, d: str) -> DataFrame:
    m = readers.gold_slots(table(s, d, "morpheme").where("segmentation is not null").select("id", "segmentation").distinct())
    return m.select("id", F.concat_ws(" ", "units").alias("units"), F.concat_ws(" ", "categories").alias("categories"))


def length_quantiles(s: SparkSession, d: str) -> DataFrame:
    q = runs.quantiles(table(s, d, "documents"), F.length("text"))
    return q.select("q", F.round("x", 6).alias("x"))


def length_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    return runs.nearest_rank(table(s, d, "documents").select(F.length("text").alias("n")), "n", [0.9, 0.99, 0.999, 1.0])


def block_pack(s: SparkSession, d: str) -> DataFrame:
    """Blocks of each line's chunks: their number, and the lengths of all of them."""
    b = _lines(s, d).select("sent_id", T.pack_blocks(F.col("chunks"), BLOCK).alias("b"))
    return b.select("sent_id", F.size("b").alias("blocks"), F.concat_ws(",", F.transform("b", lambda x: F.length(F.array_join(x, "")).cast("string"))).alias("lengths"))


def token_boundaries(s: SparkSession, d: str) -> DataFrame:
    x = _lines(s, d).select("sent_id", F.posexplode(T.with_boundaries(F.col("chunks"), ())).alias("pos", "x"))
    return x.select("sent_id", "pos", F.col("x.unit").alias("unit"), F.col("x.rb").alias("rb"))


def span_sums(s: SparkSession, d: str) -> DataFrame:
    x = _lines(s, d).select("sent_id", F.explode(T.spans(F.col("chunks"), ())).alias("x"))
    return x.groupBy("sent_id").agg(F.count("*").alias("n"), F.sum("x.s").alias("starts"), F.max("x.e").alias("length"))


def _cuts(word: str, n: int):
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / n).cast("int")), lambda i: F.substr(F.col(word), i * n + 1, F.lit(n)))


def align_subwords(s: SparkSession, d: str) -> DataFrame:
    """Pieces of four characters of each line's letters, counted by the word in which they end."""
    x = _lines(s, d).where(F.size("chunks") > 0).withColumn("all", F.array_join("chunks", "")).select("sent_id", evaluate.align(F.col("chunks"), _cuts("all", 4)).alias("a"))
    return x.select("sent_id", F.posexplode("a").alias("pos", "x")).select("sent_id", "pos", F.col("x.word").alias("word"), F.size("x.tokens").alias("pieces"))


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    """Best paths (weight 1) against the rule that cuts every three characters."""
    best = cut(lattice.viterbi(LQ.lats(s, d)).select("word", F.array("tokens").alias("tokenizations"), F.array(F.lit(1.0)).alias("weights")))
    gold = best.select("word", F.array(_cuts("word", 3)).alias("tokenizations"), F.array(F.lit(1.0)).alias("weights"))
    return evaluate.paired(gold, best, "word")


def tok_eval_micro(s: SparkSession, d: str) -> DataFrame:
    m = evaluate.micro_scores(_evaluated(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def tok_eval_category(s: SparkSession, d: str) -> DataFrame:
    """Scores by place of the gold token: the first is a stem, later ones are suffixes."""
    p = _evaluated(s, d).withColumn("categories", F.transform("gold_toks", lambda t, i: F.when(i == 0, "stem").otherwise("suffix")))
    return evaluate.category_scores(p)


def unique_tokens(s: SparkSession, d: str) -> DataFrame:
    best = lattice.viterbi(LQ.lats(s, d)).select(F.array("tokens").alias("tokenizations"))
    return evaluate.unique_tokens(best)


def reference_per_char(s: SparkSession, d: str) -> DataFrame:
    w, _, x = LQ.base(s, d)
    r = lattice.reference_logprob(x, LQ.rule_gold(w))
    return evaluate.reference_per_char(r).select(F.round("logp_per_char", 6).alias("logp_per_char"))


def dictionary_replace(s: SparkSession, d: str) -> DataFrame:
    """The words' best paths, replaced by the first rule segmentation whose units are all known."""
    best = cut(lattice.viterbi(LQ.lats(s, d)).select("word", "tokens"))
    entries = best.where(F.length("word") >= 4).select("word", _cuts("word", 4).alias("units")).unionByName(best.where(F.length("word") >= 4).select("word", _cuts("word", 3).alias("units")))
    out = evaluate.replace_by_dictionary(best, evaluate.segmentation_dictionary(entries), LQ.vocabulary(s, d))
    return out.select("word", F.concat_ws(" ", "tokens").alias("tokens"), "outcome")


def signature_outcomes(s: SparkSession, d: str) -> DataFrame:
    best = cut(lattice.viterbi(LQ.lats(s, d)).select("word", "tokens"))
    gold = best.where(F.length("word") % 2 == 0).select(F.lower("word").alias("word"), F.array(T.signature(_cuts("word", 3)), T.signature(_cuts("word", 4))).alias("signatures")).dropDuplicates(["word"])
    return evaluate.signature_outcomes(best, gold)


def skipgram_counts(s: SparkSession, d: str) -> DataFrame:
    return skipgram.skipgram_counts(_lines(s, d), "chunks", [1, 2, 4])


def skipgram_flat(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "skipgram_index").select("index_id", "counts").distinct()
    return skipgram.from_index(x, keys=["index_id"]).groupBy("dist", "src", "tgt").agg(F.sum("n").alias("n"))


def skipgram_expand(s: SparkSession, d: str) -> DataFrame:
    """Occurrences of each distance and source, one row each, counted again."""
    return skipgram.occurrences(skipgram_counts(s, d)).groupBy("dist", "src").agg(F.count("*").alias("n"))


def label_shift(s: SparkSession, d: str) -> DataFrame:
    x = skipgram.next_labels(_lines(s, d).where(F.size("chunks") > 0), "chunks")
    return x.select("sent_id", F.posexplode(F.arrays_zip("chunks", "labels")).alias("pos", "x")).select("sent_id", "pos", F.col("x.chunks").alias("token"), F.col("x.labels").alias("label"))


def tokenize_lines(s: SparkSession, d: str) -> DataFrame:
    """Sentences segmented by the documents' vocabulary: pieces and log probability of each."""
    lines = _words_of_lines(s, d)
    units = cut(LQ.vocabulary(s, d))
    words = lines.select(F.explode("chunks").alias("word"))
    best = lattice.segmented(lattice.lattices(lattice.lattice_edges(words, units, LQ.UNIT, LQ.LENGTH)))
    out = encode.tokenize_lines(lines, best, "sent_id")
    return out.select("sent_id", F.round("logp", 6).alias("logp"), F.concat_ws(" ", "tokens").alias("tokens"))


def sentence_lattices(s: SparkSession, d: str) -> DataFrame:
    """Edges of each sentence's packed blocks: their number and summed weight."""
    e = lattice.sentence_edges(_words_of_lines(s, d), cut(LQ.vocabulary(s, d)), "sent_id", max_unit=LQ.UNIT, max_length=LQ.LENGTH, max_blocks=10_000)
    return e.groupBy("sent_id").agg(F.count("*").alias("edges"), F.round(F.sum("logp"), 6).alias("logp"))


def path_positions(s: SparkSession, d: str) -> DataFrame:
    """Best paths as positions in characters."""
    best = lattice.viterbi(LQ.lats(s, d))
    ids = LQ.vocabulary(s, d).select("token", F.length("token").alias("token_id"))
    out = encode.path_inputs(best, ids, ["word"], characters=True)
    return out.select("word", F.concat_ws(",", F.transform("input_ids", lambda x: x.cast("string"))).alias("lengths"), F.concat_ws(",", F.transform("position_ids", lambda x: x.cast("string"))).alias("positions"))


def causal_pairs(s: SparkSession, d: str) -> DataFrame:
    """How many edges each word's edges may look back at, themselves included."""
    return encode.causal_pairs(LQ.lattice_edges(s, d)).groupBy("word").agg(F.count("*").alias("pairs"))


def derive_words(s: SparkSession, d: str) -> DataFrame:
    """Words of the documents, each with its pieces by a few English affixes; stems are the words of three letters or more that occur 20 times or more."""
    w = cut(vocab.word_counts(wide_scan(table(s, d, "documents"))))
    stems = w.where((F.col("n") >= 20) & (F.length("word") >= 3)).select("word")
    return morphology.derive_by_join(w, stems, ["un", "re", "in", "non", "sub", "over"], ["s", "ed", "ing", "er", "ly", "ness", "able", "ation", "ies"])


def word_slots(m: DataFrame) -> DataFrame:
    """(id, pos, word, units): the words of each record's text with their filled slots, three to a word; marks of punctuation have none.

    The units are null in a record that hasn't three slots to a word.
    """
    parsed = packed.parse_packed(m.select("id", "text", F.col("segmentation").alias("slots")), ["slots"])
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]") & ~w.isin(*NO_UNIT))
    each = parsed.select("id", "slots", (F.size("slots") == 3 * F.size(words)).alias("fits"), F.posexplode(words).alias("pos", "word"))
    own = F.filter(F.slice("slots", F.col("pos") * 3 + 1, F.lit(3)), lambda u: ~u.isin(*NO_UNIT))
    return each.select("id", "pos", F.lower("word").alias("word"), F.when(F.col("fits"), F.transform(own, lambda u: F.lower(u))).alias("units"))


def edit_fences(s: SparkSession, d: str) -> DataFrame:
    """Cuts of every word of each morpheme record that align with the word's units; null where the record has no units for the word."""
    m = first_delivery(table(s, d, "morpheme"), "id", "added_at", ["text", "segmentation"]).where("text is not null and segmentation is not null")
    return word_slots(m).select("id", "pos", "word", morphology.fence_column(F.col("word"), F.col("units")).alias("fences"))


def node_views(s: SparkSession, d: str) -> DataFrame:
    """Each word's lattice as JSON. Words of any length: they aren't cut into blocks here."""
    w = cut(vocab.word_counts(wide_scan(table(s, d, "documents"))))
    edges = lattice.lattice_edges(w, cut(vocab.build_vocabulary(w, LQ.UNIT, LQ.COUNT)), LQ.UNIT, None)
    return dynamics.node_view(lattice.edge_marginals(lattice.lattices(edges)), "word")


QUERIES = {
    f.__name__: f
    for f in (
        pretokenize, space_chunks, mark_spaces, length_filter, special_prefix, gold_slots, length_quantiles, length_nearest_rank, block_pack, token_boundaries, span_sums, align_subwords,
        tok_eval_micro, tok_eval_category, unique_tokens, reference_per_char, dictionary_replace, signature_outcomes, skipgram_counts, skipgram_flat, skipgram_expand,
        label_shift, tokenize_lines, sentence_lattices, path_positions, causal_pairs, derive_words, edit_fences, node_views,
    )
}

_L = (
    "fs AS (SELECT sent_id, min(struct_pack(l := read_at IS NULL, at := read_at, t := text_str)) AS r FROM sentences WHERE sent_id IS NOT NULL GROUP BY sent_id),"
    " ls AS (SELECT sent_id, r.t AS text_str, list_filter(string_split(r.t, ' '), lambda c: c <> '') AS chunks FROM fs WHERE r.t IS NOT NULL)"
)
_TRIM = r"regexp_replace(text_str, '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g')"
_WORDCHARS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_SPECIAL = "{c} IN ('[SP1]', '[SP2]', '[SP3]', '[CLS]', '[SEP]', '[BOS]', '[EOS]', '[PAD]', '[UNK]', '[MASK]')"
_TL = "ts AS (SELECT sent_id, text_str, unnest(chunks) AS unit, generate_subscripts(chunks, 1) - 1 AS pos FROM ls), tb AS (SELECT sent_id, unit, pos, sum(length(unit)) OVER (PARTITION BY sent_id, text_str ORDER BY pos) AS rb FROM ts)"
_CUT = "list_transform(range(0, (length(word) - 1) // {n} + 1), lambda i: substr(word, (i * {n} + 1)::BIGINT, {n}))"
_FIN = f"{LQ._BASE}, {LQ._BEST.format(n=1)}, pred AS (SELECT word, paths[1].path AS toks FROM fin)"
_EV = (
    f"{_FIN}, p AS (SELECT word, e - length(t) AS lb, e AS rb, e < length(word) AS inner_end FROM (SELECT word, t, sum(length(t)) OVER (PARTITION BY word ORDER BY i) AS e FROM (SELECT word, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM pred))),"
    " g AS (SELECT word, (i * 3) AS lb, least(i * 3 + 3, length(word)) AS rb, i * 3 + 3 < length(word) AS inner_end, i FROM pred, range(0, 16) r(i) WHERE i * 3 < length(word))"
)

SQL = {
    "pretokenize": f"WITH {_L}, p AS (SELECT sent_id, regexp_extract_all(text_str, '[{_WORDCHARS}]+|[^{_WORDCHARS}\\s\\x0b\\x{{85}}\\p{{Z}}]+') AS t FROM ls) SELECT sent_id, unnest(t) AS token, (generate_subscripts(t, 1) - 1)::INTEGER AS pos FROM p",
    "space_chunks": f"WITH {_L}, c AS (SELECT sent_id, string_split({_TRIM}, ' ') AS c FROM ls), u AS (SELECT sent_id, c[1] AS head, unnest(c) AS chunk, (generate_subscripts(c, 1) - 1)::INTEGER AS pos FROM c) SELECT sent_id, pos, CASE WHEN {_SPECIAL.format(c='chunk')} OR {_SPECIAL.format(c='head')} THEN chunk ELSE '▁' || chunk END AS chunk FROM u",
    "mark_spaces": f"WITH {_L} SELECT sent_id, replace({_TRIM}, ' ', '▁') AS marked FROM ls",
    "length_filter": f"WITH {_L} SELECT sent_id, '[CLS]▁' || text_str AS text FROM ls WHERE length(text_str) <= 46",
    "special_prefix": "SELECT DISTINCT id, '[SP1] [SP2] [SP3]' || coalesce(' ' || text, '') AS text, len(string_split(features, '-'))::INTEGER AS n_features FROM (SELECT DISTINCT id, text, features FROM morpheme)",
    "gold_slots": "WITH m AS (SELECT DISTINCT id, segmentation, string_split(segmentation, '-') AS p FROM morpheme WHERE segmentation IS NOT NULL) SELECT id, array_to_string(list_filter(p, lambda x: x NOT IN ('[SP1]', '[SP2]', '[SP3]')), ' ') AS units, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: p[i] NOT IN ('[SP1]', '[SP2]', '[SP3]')), lambda i: ['prefix', 'stem', 'suffix'][(i - 1) % 3 + 1]), ' ') AS categories FROM m",
    "length_quantiles": "SELECT i / 10.0::DOUBLE AS q, round((SELECT quantile_cont(length(text), i / 10.0::DOUBLE) FROM documents), 6) AS x FROM range(0, 11) r(i)".replace("(SELECT quantile_cont(length(text), i / 10.0::DOUBLE) FROM documents)", "(SELECT quantile_cont(length(text), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM documents)[i + 1]"),
    "length_nearest_rank": "WITH o AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS k, count(*) OVER () AS c FROM documents WHERE text IS NOT NULL) SELECT q, n AS x FROM o, (VALUES (0.9::DOUBLE), (0.99), (0.999), (1.0)) v(q) WHERE k = greatest(1, floor(c * q))",
    "block_pack": f"WITH {_L}, b AS (SELECT sent_id, list_reduce(list_transform(chunks, lambda c: length(c)), lambda a, n: CASE WHEN a[-1] = 0 OR a[-1] + n <= 64 THEN list_concat(a[:-2], [a[-1] + n]) ELSE list_append(a, n) END, [0::BIGINT]) AS b FROM ls) SELECT sent_id, (CASE WHEN b = [0] THEN 0 ELSE len(b) END)::INTEGER AS blocks, CASE WHEN b = [0] THEN '' ELSE array_to_string(b, ',') END AS lengths FROM b",
    "token_boundaries": f"WITH {_L}, {_TL} SELECT sent_id, pos::INTEGER AS pos, unit, rb::INTEGER AS rb FROM tb",
    "span_sums": f"WITH {_L}, {_TL} SELECT sent_id, count(*) AS n, sum(rb - length(unit))::BIGINT AS starts, max(rb)::INTEGER AS length FROM tb GROUP BY sent_id",
    "align_subwords": f"WITH {_L}, {_TL}, n AS (SELECT sent_id, max(rb) AS total FROM tb GROUP BY sent_id) SELECT sent_id, pos::INTEGER AS pos, unit AS word, (rb // 4 - (rb - length(unit)) // 4 + CASE WHEN rb = total AND rb % 4 > 0 THEN 1 ELSE 0 END)::INTEGER AS pieces FROM tb JOIN n USING (sent_id)",
    "tok_eval_micro": f"WITH RECURSIVE {_EV}, c AS (SELECT (SELECT count(*) FROM g SEMI JOIN p USING (word, lb, rb))::DOUBLE AS token_tp, (SELECT count(*) FROM p)::DOUBLE AS token_ap, (SELECT count(*) FROM g)::DOUBLE AS token_at, (SELECT count(*) FROM g SEMI JOIN (SELECT * FROM p WHERE inner_end) q USING (word, rb) WHERE inner_end)::DOUBLE AS boundary_tp, (SELECT count(*) FROM p WHERE inner_end)::DOUBLE AS boundary_ap, (SELECT count(*) FROM g WHERE inner_end)::DOUBLE AS boundary_at) SELECT *, round(token_tp / token_ap, 6) AS token_precision, round(token_tp / token_at, 6) AS token_recall, round(2 * token_tp / (token_ap + token_at), 6) AS token_f1, round(boundary_tp / boundary_ap, 6) AS boundary_precision, round(boundary_tp / boundary_at, 6) AS boundary_recall, round(2 * boundary_tp / (boundary_ap + boundary_at), 6) AS boundary_f1 FROM c",
    "tok_eval_category": f"WITH RECURSIVE {_EV}, c AS (SELECT CASE WHEN i = 0 THEN 'stem' ELSE 'suffix' END AS category, EXISTS (SELECT 1 FROM p WHERE p.word = g.word AND p.lb = g.lb AND p.rb = g.rb) AS tp, (SELECT count(*) FROM p WHERE p.word = g.word AND p.lb >= g.lb AND p.rb <= g.rb) AS ap, (CASE WHEN i > 0 AND EXISTS (SELECT 1 FROM p WHERE p.word = g.word AND p.rb = g.lb AND p.inner_end) THEN 1 ELSE 0 END + CASE WHEN g.inner_end AND EXISTS (SELECT 1 FROM p WHERE p.word = g.word AND p.rb = g.rb AND p.inner_end) THEN 1 ELSE 0 END) AS btp, (CASE WHEN i > 0 THEN 1 ELSE 0 END + CASE WHEN g.inner_end THEN 1 ELSE 0 END) AS bat, (SELECT count(*) FROM p WHERE p.word = g.word AND p.inner_end AND p.rb > g.lb AND p.rb < g.rb) AS over FROM g) SELECT category, sum(tp::INTEGER)::DOUBLE AS token_tp, sum(ap)::DOUBLE AS token_ap, count(*)::DOUBLE AS token_at, sum(btp)::DOUBLE AS boundary_tp, sum(bat)::BIGINT AS boundary_at, sum(over)::DOUBLE AS oversegmented FROM c GROUP BY category",
    "unique_tokens": f"WITH RECURSIVE {_FIN} SELECT count(DISTINCT t) AS tokens FROM (SELECT unnest(toks) AS t FROM pred)",
    "reference_per_char": f"WITH RECURSIVE {LQ._BASE}, {LQ._dp('al', 'edges', 'word', 'length(word)')}, own AS (SELECT word, sum(logp) AS w, count(*) AS k FROM edges WHERE s % 3 = 0 AND e = least(s + 3, length(word)) GROUP BY word) SELECT round(sum(CASE WHEN k = ceil(length(word) / 3) THEN w - al.v[length(word) + 1] END) / sum(length(word)), 6) AS logp_per_char FROM al LEFT JOIN own USING (word)",
    "signature_outcomes": f"WITH RECURSIVE {_FIN}, c AS (SELECT word, len(toks) AS k, list_transform(toks, lambda t: length(t)) AS sig, list_transform({_CUT.format(n=3)}, lambda t: length(t)) AS s3, list_transform({_CUT.format(n=4)}, lambda t: length(t)) AS s4 FROM pred) SELECT CASE WHEN length(word) % 2 = 1 THEN 'unknown' ELSE CASE WHEN k = 1 THEN 'mono' ELSE 'multi' END || CASE WHEN sig = s3 OR sig = s4 THEN ' correct' ELSE ' incorrect' END END AS outcome, count(*) AS words FROM c GROUP BY 1",
    "skipgram_counts": f"WITH {_L} SELECT d::INTEGER AS dist, chunks[i] AS src, chunks[i + d] AS tgt, count(*) AS n FROM ls, (VALUES (1), (2), (4)) v(d), range(1, len(chunks)) r(i) WHERE i + d <= len(chunks) GROUP BY ALL",
    "skipgram_flat": "WITH f AS (SELECT DISTINCT index_id, counts FROM skipgram_index WHERE json_valid(counts)), a AS (SELECT counts::JSON AS c, unnest(json_keys(counts::JSON)) AS dist FROM f), b AS (SELECT dist, c->dist AS m, unnest(json_keys(c->dist)) AS src FROM a), e AS (SELECT dist, src, m->src AS t, unnest(json_keys(m->src)) AS tgt FROM b) SELECT dist::INTEGER AS dist, src, tgt, sum((t->>tgt)::BIGINT)::BIGINT AS n FROM e GROUP BY ALL",
    "skipgram_expand": f"WITH {_L} SELECT d::INTEGER AS dist, chunks[i] AS src, count(*) AS n FROM ls, (VALUES (1), (2), (4)) v(d), range(1, len(chunks)) r(i) WHERE i + d <= len(chunks) GROUP BY ALL",
    "label_shift": f"WITH {_L} SELECT sent_id, (i - 1)::INTEGER AS pos, chunks[i] AS token, chunks[i + 1] AS label FROM ls, range(1, len(chunks) + 1) r(i)",
}
_OPT = "opt AS (SELECT DISTINCT word, seg FROM (SELECT word, {c4} AS seg FROM pred WHERE length(word) >= 4 UNION ALL SELECT word, {c3} FROM pred WHERE length(word) >= 4)), ou AS (SELECT word, seg, unnest(seg) AS token FROM opt), ok AS (SELECT word, seg FROM ou LEFT JOIN vocab USING (token) GROUP BY word, seg HAVING count(*) = count(vocab.logp) QUALIFY row_number() OVER (PARTITION BY word ORDER BY len(seg), seg) = 1)".format(c4=_CUT.format(n=4), c3=_CUT.format(n=3))
_SENT = (
    f"{_L}, lc AS (SELECT sent_id, generate_subscripts(chunks, 1) AS pos, lower(unnest(chunks)) AS w FROM ls), lp AS (SELECT sent_id, pos, list_transform(range(0, (length(w) + 47) // 48), lambda i: substr(w, (i * 48 + 1)::BIGINT, 48)) AS ps FROM lc),"
    " lw AS (SELECT sent_id, pos, generate_subscripts(ps, 1) AS part, unnest(ps) AS w FROM lp)"
)
SQL["tokenize_lines"] = (
    f"WITH RECURSIVE {LQ._WORDS.replace('words AS', 'dwords AS')}, {LQ._SUBS.replace('FROM words', 'FROM dwords')}, {_SENT}, words AS (SELECT DISTINCT w AS word FROM lw), {LQ._EDGES}, {LQ._BEST.format(n=1)}, {LQ._dp('al', 'edges', 'word', 'length(word)')}"
    " SELECT sent_id, round(sum(CASE WHEN len(paths) > 0 THEN -paths[1].cost - al.v[length(w) + 1] ELSE 0 END), 6) AS logp, '[BOS] ' || string_agg(CASE WHEN len(paths) > 0 THEN array_to_string(paths[1].path, ' ') ELSE w END, ' ' ORDER BY pos, part) || ' [EOS]' AS tokens FROM lw LEFT JOIN fin ON fin.word = w LEFT JOIN al ON al.word = w GROUP BY sent_id"
)
SQL["sentence_lattices"] = (
    f"WITH {LQ._WORDS.replace('words AS', 'dwords AS')}, {LQ._SUBS.replace('FROM words', 'FROM dwords')}, {_SENT}, words AS (SELECT DISTINCT w AS word FROM lw), {LQ._EDGES}"
    " SELECT sent_id, count(*) AS edges, round(sum(logp), 6) AS logp FROM lw JOIN edges ON edges.word = w GROUP BY sent_id"
)
SQL["path_positions"] = f"WITH RECURSIVE {_FIN}, x AS (SELECT word, list_transform(toks, lambda t: length(t)) AS ls FROM pred) SELECT word, array_to_string(ls, ',') AS lengths, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: coalesce(list_sum(ls[1:i - 1]), 0)::BIGINT), ',') AS positions FROM x"
SQL["causal_pairs"] = f"WITH {LQ._BASE} SELECT word, count(*) AS pairs FROM edges a JOIN edges b USING (word) WHERE b.e <= a.s OR (a.s = b.s AND a.e = b.e) GROUP BY word"
SQL["dictionary_replace"] = f"WITH RECURSIVE {_FIN}, {_OPT} SELECT word, array_to_string(coalesce(seg, toks), ' ') AS tokens, CASE WHEN seg IS NOT NULL THEN 'replaced' WHEN length(word) >= 4 THEN 'unknown' ELSE 'missing' END AS outcome FROM pred LEFT JOIN ok USING (word)"
