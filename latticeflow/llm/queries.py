"""Queries over the problems of training data, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import leaks, overlap, packing, pairs, residue, terms, tokens, topn
from latticeflow.operators.packed import parse_packed
from latticeflow.operators.records import first_delivery
from latticeflow.session import cut, table, wide_scan


def _p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, n, n_records, records, mark) of the units and the words."""
    units = cut(parse_packed(first_delivery(wide_scan(table(spark, sf_dir, "morpheme")), "id", "added_at", ["segmentation"]), ["segmentation"]).select("segmentation"))
    lines = cut(first_delivery(wide_scan(table(spark, sf_dir, "sentences")), "sent_id", "read_at", ["text_str"]).select("text_str"))
    a = terms.marked(terms.term_counts(units, "segmentation", terms.array_terms), units).withColumn("field", F.lit("segmentation"))
    b = terms.marked(terms.term_counts(lines, "text_str", terms.text_terms), lines).withColumn("field", F.lit("text_str"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1_counts(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of the sentences occurs, and in how many records."""
    lines = cut(first_delivery(wide_scan(table(spark, sf_dir, "sentences")), "sent_id", "read_at", ["text_str"]).select("text_str"))
    return terms.term_counts(lines, "text_str", terms.text_terms)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_evaluations(table(spark, sf_dir, "run_log")).select("run_id", "step")


def p2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best evaluations of each run, with their accuracy and rank."""
    return topn.best_evaluations(table(spark, sf_dir, "run_log"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_lift(spark, sf_dir).select("word_a", "word_b")


def p3_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of words far more often together than by chance, with their counts and lift."""
    records = cut(pairs.index_words(wide_scan(table(spark, sf_dir, "skipgram_index"))))
    return pairs.lifted_pairs(records, "words")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = overlap.overlap_pairs(wide_scan(table(spark, sf_dir, "morpheme")))
    return df.select(F.least("id_e", "id_t").alias("id_a"), F.greatest("id_e", "id_t").alias("id_b"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of equal texts and the number of its links to the other part."""
    return overlap.overlap_links(wide_scan(table(spark, sf_dir, "morpheme")))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records per split and source, with their links and coverage."""
    return overlap.overlap_report(wide_scan(table(spark, sf_dir, "morpheme")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversize(wide_scan(table(spark, sf_dir, "encoded")), table(spark, sf_dir, "caches"))


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed row of every piece of every example."""
    ex = cut(packing.examples(wide_scan(table(spark, sf_dir, "encoded")), table(spark, sf_dir, "caches")))
    return packing.pack_rows(ex, "cache", "ex_id", "n", "max_length")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of every piece of every chunk."""
    ex = packing.examples(wide_scan(table(spark, sf_dir, "encoded")), table(spark, sf_dir, "caches"))
    return packing.pack_blocks(ex, "ex_id", "lengths", "max_block_length")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of each cache, the fewest possible, and the share of space used."""
    return packing.fill_report(p6_rows(spark, sf_dir), "cache")


def p6_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each cache, the fewest rows possible, and whether those taken are at most a fiftieth more (and one)."""
    f = p6_fill(spark, sf_dir)
    return f.select("cache", "capacity", "pieces", "least", (F.col("containers") <= F.col("least") * 1.02 + 1).alias("tight"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(wide_scan(table(spark, sf_dir, "documents")), "doc_id", "text")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode_column(p7_ids(spark, sf_dir), "doc_id")


def p7_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the tree encodes in one leaf, and how many it joins from several."""
    joined = F.coalesce(F.length("text"), F.lit(0)) > tokens.LEAF
    return table(spark, sf_dir, "documents").groupBy(joined.alias("joined")).agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(wide_scan(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(wide_scan(table(spark, sf_dir, "documents"))).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each kind of residue."""
    return residue.find_residue(wide_scan(table(spark, sf_dir, "documents"))).groupBy("kind").agg(F.count("*").alias("documents"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that stay once those with residue are excluded."""
    return residue.without_residue(wide_scan(table(spark, sf_dir, "documents"))).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p2_top": p2_top,
    "p3_found": p3_found,
    "p3_lift": p3_lift,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_report": p4_report,
    "p6_found": p6_found,
    "p6_rows": p6_rows,
    "p6_blocks": p6_blocks,
    "p6_fill": p6_fill,
    "p6_tight": p6_tight,
    "p7_ids": p7_ids,
    "p7_text": p7_text,
    "p7_leaves": p7_leaves,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_kinds": p9_kinds,
    "p9_kept": p9_kept,
}

SQL = {
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_leaves": "SELECT coalesce(length(text), 0) > 512 AS joined, count(*) AS documents FROM documents GROUP BY 1",
    "p6_found": """
        WITH first AS (SELECT DISTINCT ON (ex_id) * FROM encoded WHERE ex_id IS NOT NULL ORDER BY ex_id, cached_at),
        ex AS (SELECT ex_id, input_ids, lengths, max_length, max_block_length, pad_id FROM first JOIN caches USING (cache)),
        ids AS (SELECT ex_id, max_length, coalesce(list_max(list_filter(range(1, len(input_ids) + 1), lambda i: input_ids[i] IS NOT NULL AND input_ids[i] IS DISTINCT FROM pad_id)), 0) AS n FROM ex),
        chunks AS (SELECT ex_id, max_block_length, unnest(lengths) AS n, generate_subscripts(lengths, 1) - 1 AS pos FROM ex)
        SELECT ex_id, 'input_ids' AS field, 0::INTEGER AS pos FROM ids WHERE n > max_length
        UNION ALL SELECT ex_id, 'lengths', pos::INTEGER FROM chunks WHERE n > max_block_length""",
    "p6_tight": """
        WITH first AS (SELECT DISTINCT ON (ex_id) * FROM encoded WHERE ex_id IS NOT NULL ORDER BY ex_id, cached_at),
        ex AS (SELECT cache, input_ids, max_length, pad_id FROM first JOIN caches USING (cache)),
        ids AS (SELECT cache, max_length, coalesce(list_max(list_filter(range(1, len(input_ids) + 1), lambda i: input_ids[i] IS NOT NULL AND input_ids[i] IS DISTINCT FROM pad_id)), 0) AS n FROM ex)
        SELECT cache, max_length::BIGINT AS capacity, sum((n + max_length - 1) // max_length)::BIGINT AS pieces, ceil(sum(n) / max_length)::BIGINT AS least, TRUE AS tight FROM ids WHERE n > 0 GROUP BY cache, max_length""",
    "p1_terms": r"""
        WITH first AS (SELECT sent_id, min(struct_pack(l := read_at IS NULL, at := read_at, t := text_str)) AS r FROM sentences WHERE sent_id IS NOT NULL GROUP BY sent_id),
        each AS (SELECT sent_id, unnest(regexp_extract_all(nfc_normalize(lower(nfc_normalize(r.t))), '[\p{L}\p{N}]+')) AS term FROM first)
        SELECT term, count(*)::BIGINT AS n, count(DISTINCT sent_id)::BIGINT AS n_records FROM each GROUP BY term""",
    "p2_found": """
        WITH last AS (
            SELECT run_id, step, max_by(dev_accuracy, struct_pack(logged_at, dev_accuracy)) AS dev_accuracy FROM run_log
            WHERE run_id IS NOT NULL AND step IS NOT NULL AND dev_accuracy BETWEEN 0 AND 1 GROUP BY run_id, step)
        SELECT run_id, step FROM last QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY dev_accuracy DESC, step) <= 3""",
    "p2_top": """
        WITH last AS (
            SELECT run_id, step, max_by(dev_accuracy, struct_pack(logged_at, dev_accuracy)) AS dev_accuracy FROM run_log
            WHERE run_id IS NOT NULL AND step IS NOT NULL AND dev_accuracy BETWEEN 0 AND 1 GROUP BY run_id, step),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dev_accuracy DESC, step)::INTEGER AS rank FROM last)
        SELECT run_id, step, dev_accuracy, rank FROM ranked WHERE rank <= 3""",
    "p3_found": r"""
        WITH first AS (SELECT DISTINCT ON (index_id) index_id, words, counts FROM skipgram_index WHERE index_id IS NOT NULL ORDER BY index_id, built_at),
        parsed AS (SELECT index_id, words, CASE WHEN words IS NULL AND json_valid(counts) THEN counts::JSON END AS c FROM first),
        dist AS (SELECT index_id, c, unnest(json_keys(c)) AS d FROM parsed WHERE c IS NOT NULL),
        src AS (SELECT index_id, c->d AS m, unnest(json_keys(c->d)) AS s FROM dist),
        raw AS (
            SELECT index_id, unnest(words) AS w FROM parsed
            UNION ALL SELECT index_id, s FROM src
            UNION ALL SELECT index_id, unnest(json_keys(m->s)) FROM src),
        held AS (SELECT DISTINCT index_id, lower(w) AS w FROM raw WHERE w IS NOT NULL AND w <> '' AND NOT regexp_matches(w, '^\[.*\]$')),
        cnt AS (SELECT w, count(*) AS n FROM held GROUP BY w), total AS (SELECT count(*) AS n FROM first),
        pair AS (SELECT a.w AS word_a, b.w AS word_b, count(*) AS n FROM held a JOIN held b ON a.index_id = b.index_id AND a.w < b.w GROUP BY 1, 2 HAVING count(*) >= 5)
        SELECT word_a, word_b FROM pair JOIN cnt x ON x.w = word_a JOIN cnt y ON y.w = word_b, total
        WHERE pair.n * total.n >= 4 * x.n * y.n""",
}

SQL["p3_lift"] = SQL["p3_found"].replace("SELECT word_a, word_b FROM pair JOIN", "SELECT word_a, word_b, pair.n AS n_ab, x.n AS n_a, y.n AS n_b, total.n AS records, pair.n::DOUBLE * total.n / x.n / y.n AS lift FROM pair JOIN")
