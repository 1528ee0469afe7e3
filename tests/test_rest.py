import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latticeflow.operators import dynamics, evaluate, morphology, runs, skipgram
from latticeflow.operators.records import first_delivery
from latticeflow.plans import oracle_sql, queries
from latticeflow.sources import readers, sinks


def test_scores_and_categories(spark):
    s = "row long, tokenizations array<array<string>>, weights array<double>"
    gold = spark.createDataFrame([(0, [["ab", "c", "de"]], [1.0]), (1, [["xyz"]], [1.0])], s)
    pred = spark.createDataFrame([(0, [["ab", "cde"], ["a", "b", "c", "de"]], [0.5, 0.5]), (1, [["xyz"]], [1.0])], s)
    pairs = evaluate.paired(gold, pred, "row")
    m = evaluate.micro_scores(pairs).first()
    assert m.token_tp == pytest.approx(0.5 * 1 + 0.5 * 2 + 1) and m.token_ap == pytest.approx(0.5 * 2 + 0.5 * 4 + 1) and m.token_at == pytest.approx(4)
    assert m.boundary_tp == pytest.approx(0.5 * 1 + 0.5 * 2) and m.boundary_at == pytest.approx(2)
    c = {r.category: r for r in evaluate.category_scores(pairs.withColumn("categories", F.transform("gold_toks", lambda t, i: F.when(i == 0, "stem").otherwise("suffix")))).collect()}
    assert c["stem"].token_tp == pytest.approx(1.5) and c["suffix"].token_at == pytest.approx(2)
    one = evaluate.micro_scores(evaluate.paired(gold.where("row = 1"), pred.where("row = 1"))).first()
    assert one.boundary_recall is None and one.boundary_precision == 0


def test_positional_join_checks_rows(spark):
    a, b = spark.range(3).withColumnRenamed("id", "row"), spark.range(2).withColumnRenamed("id", "row")
    assert evaluate.positional_join(a, a.withColumn("x", F.lit(1))).count() == 3
    with pytest.raises(Exception, match="different numbers"):
        evaluate.positional_join(a, b).collect()


def test_alignment_and_dictionary(spark):
    df = spark.createDataFrame([(["abc", "de"], ["ab", "c", "de"])], "w array<string>, t array<string>")
    got = df.select(evaluate.align(F.col("w"), F.col("t")).alias("a")).first().a
    assert [(x.word, x.tokens) for x in got] == [("abc", ["ab", "c"]), ("de", ["de"])]
    lines = spark.createDataFrame([("abc", ["a", "b", "c"]), ("abc", ["ab", "c"]), ("abc", ["ab", "c"]), ("x", ["x1"])], "word string, units array<string>")
    d = evaluate.segmentation_dictionary(lines)
    assert {r.word: r.segs for r in d.collect()}["abc"] == [["ab", "c"], ["a", "b", "c"]]
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "token string")
    toks = spark.createDataFrame([("abc", ["abc"]), ("x", ["x"]), ("q", ["q"])], "word string, tokens array<string>")
    out = {r.word: (r.tokens, r.outcome) for r in evaluate.replace_by_dictionary(toks, d, vocab).collect()}
    assert out == {"abc": (["a", "b", "c"], "replaced"), "x": (["x"], "unknown"), "q": (["q"], "missing")}


def test_runs(spark):
    log = spark.createDataFrame([("r", 2, 0.5), ("r", 1, 0.5), ("r", 3, None), ("r", 4, float("nan")), ("s", 1, 0.1), (None, 1, 0.9)], "run string, step long, acc double")
    got = {r.run: r.step for r in runs.best_row(log, ["run"], "acc", "step").collect()}
    assert got == {"r": 1, "s": 1, None: 1}
    assert runs.best_row(log.limit(0), ["run"], "acc", "step").count() == 0
    q = {round(r.q, 1): r.x for r in runs.quantiles(spark.range(11), F.col("id")).collect()}
    assert q[0.5] == 5 and q[1.0] == 10
    n = {r.q: r.x for r in runs.nearest_rank(spark.range(1, 11).withColumnRenamed("id", "n"), "n", [0.05, 0.9, 1.0]).collect()}
    assert n == {0.05: 1, 0.9: 9, 1.0: 10}
    ids = [r.id for r in runs.shuffled(spark.range(50), "id", 1).collect()]
    assert ids != sorted(ids) and ids == [r.id for r in runs.shuffled(spark.range(50).repartition(3), "id", 1).collect()]
    assert [r.id for r in runs.first_rows(spark.range(9), ["id"], 2).collect()] == [0, 1]
    assert runs.sweep(spark, a=[1, 2], b=["x"]).count() == 2
    c = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0], [1.0])], "a array<double>, b array<double>").select(runs.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert c[0].c == pytest.approx(1) and c[1].c is None
    g = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 2.0)], "u string, v double")
    assert runs.group_lasso(g, "u", "v").first()[0] == pytest.approx(math.sqrt(2) * 5 + 2)
    r = spark.range(1).select(runs.ramp(F.lit(500), 100, 900).alias("r"), runs.report_row(["id"]).alias("row")).first()
    assert r.r == 0.5 and r.row == "0.00"


def test_skipgrams(spark):
    lines = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,), (["a"],)], "t array<string>")
    got = {(r.dist, r.src, r.tgt): r.n for r in skipgram.skipgram_counts(lines, "t", [1, 2]).collect()}
    assert got == {(1, "a", "b"): 1, (1, "b", "c"): 1, (2, "a", "c"): 1}
    index = spark.createDataFrame([('{"1": {"a": {"b": 2}}}',), ("{broken",), (None,)], "counts string")
    flat = skipgram.from_index(index)
    assert [tuple(r) for r in flat.collect()] == [(1, "a", "b", 2)] and skipgram.occurrences(flat).count() == 2
    assert skipgram.next_labels(lines.limit(1), "t").first().labels == ["b", "c", None]


def test_morphology(spark):
    d = morphology.Derivator(["un", "in", "re"], ["ness", "able", "ability", "ation", "er", "ity"], ["happy", "read", "run", "possible", "note"])
    assert d.derive("unhappiness") == ["un", "happy", "ness"]
    assert d.derive("Runner") == ["run", "er"]
    assert d.derive("impossible", "bundles") == ["in", "possible", ""]
    assert d.derive("notable", "roots") == "note"
    assert d.derive("qqq") == ["qqq"] and d.derive(None) is None and d.derive("") == [""]
    assert d.categories("unreadable") == ["prefix", "stem", "suffix"]
    assert [3, 7, 9, 10] in morphology.fences("biologists", ["bio", "ology", "ist", "s"]) or morphology.fences("biologists", ["bio", "ology", "ist", "s"])
    assert morphology.fences("ab", ["a", "b"]) == [[1, 2]]
    df = spark.createDataFrame([("abcd", ["ab", "cd"]), ("ab", ["a", "b"]), ("cd", ["c", "d"]), ("x", ["x"])], "word string, pieces array<string>")
    assert {r.word: r.pieces for r in morphology.linked(df).collect()}["abcd"] == ["a", "b", "c", "d"]
    chain = [(f"w{i}", [f"w{i + 1}", "x"]) for i in range(14)] + [("p", ["q", "y"]), ("q", ["p", "z"])]
    got = {r.word: r.pieces for r in morphology.linked(spark.createDataFrame(chain, "word string, pieces array<string>")).collect()}
    assert got["w0"] == ["w14", *["x"] * 14] and got["p"] == ["p", "z", "y"] and got["q"] == ["q", "y", "z"]


def test_ific_hangs_on_the_suffix():
    d = morphology.Derivator([], ["ation", "er"], ["simplify"])
    assert d.derive("simplification") == ["simplify", "ation"] and d.derive("simplificer") == ["simplificer"]
    assert d.derive("z" * 200_000) == ["z" * 200_000]


def test_node_views_of_long_words(spark, tmp_path):
    long = "ab" * 40
    spark.createDataFrame([(1, f"ab abab {long}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word for r in queries()["node_views"](spark, str(tmp_path)).select("word").distinct().collect()}
    assert got == {"ab", "abab", long}


def test_derived_words_keep_repaired_stems(spark, tmp_path):
    affixes = ["un", "re", "in", "non", "sub", "over"], ["s", "ed", "ing", "er", "ly", "ness", "able", "ation", "ies"]
    stems = ["make", "happy", "stop", "possible", "read"]
    others = ["making", "happier", "stopped", "impossible", "unreadable", "readings", "xyz", "unhappily", "rereading", "sssss"]
    text = " ".join(stems * 20 + others)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: list(r.pieces) for r in queries()["derive_words"](spark, str(tmp_path)).collect()}
    one = morphology.Derivator(*affixes, stems)
    assert got == {w: one.derive(w) for w in stems + others}
    assert got["making"] == ["make", "ing"] and got["stopped"] == ["stop", "ed"] and got["happier"] == ["happy", "er"] and got["impossible"] == ["in", "possible"] and got["xyz"] == ["xyz"]


def test_fences_of_every_word(spark, tmp_path):
    rows = [
        (1, "Biologists ran .", "[SP1]-bio-logists-[SP1]-ran-[SP3]", "2022-01-02"), (1, "other", "[SP1]-oth-er", "2022-01-03"), (2, "undo", "[SP1]-un-do", "2022-01-01"),
        (3, "ABC De", '["a", "b", "c", "[SP1]", "de", "[SP3]"]', "2022-01-01"), (4, "two words", "[SP1]-two-[SP3]", "2022-01-01"), (5, None, "a-b-c", "2022-01-01"),
    ]
    spark.createDataFrame(rows, "id long, text string, segmentation string, added_at string").write.parquet(f"{tmp_path}/morpheme.parquet")
    got = sorted((r.id, r.pos, r.word, r.fences) for r in queries()["edit_fences"](spark, str(tmp_path)).collect())
    assert got == [
        (1, 0, "biologists", [[3, 10]]), (1, 1, "ran", [[3]]), (2, 0, "undo", [[2, 4]]), (3, 0, "abc", [[1, 2, 3]]), (3, 1, "de", [[2]]), (4, 0, "two", None), (4, 1, "words", None)
    ]


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "z", None), (2, None, None), (None, "q", 1)], "k long, v string, at long")
    assert {r.k: r.v for r in first_delivery(df, "k", "at", ["v"]).collect()} == {1: "a", 2: None}
    assert first_delivery(df.limit(0), "k", "at", ["v"]).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "v.tsv"
    p.write_text("b\t-1.5\na\t-2\nb\t-3\n")
    assert sorted(map(tuple, readers.vocabulary(spark, str(p)).collect())) == [(0, "b"), (1, "a")]
    assert {r.token: r.w for r in readers.weights(spark, str(p)).collect()} == {"b": [-3.0], "a": [-2.0]}
    m = tmp_path / "m.csv"
    m.write_text("0,o:2/x:8/x:8,oxx,p2-r8-s8,o-x-x\n1,o:2/x:8,ox,p2-r8-s10,o-x-[SP3]\n")
    rows = sorted(readers.morphemes(spark, str(m), gold_share=0.5).collect(), key=lambda r: r.id)
    assert rows[0].text == "[SP1] [SP2] [SP3] oxx" and rows[0].segmentation == ["o", "x", "x"] and rows[1].segmentation is None
    t = spark.createDataFrame([("xulolx", [[("xu", 2), ("lo", 4), ("lx", 6)]], [1.0])], "text string, tokenizations array<array<struct<unit:string,rb:int>>>, weights array<double>")
    sinks.tokenizations(t, str(tmp_path / "t"))
    back = readers.tokenizations(spark, str(tmp_path / "t")).first()
    assert back.text == "xulolx" and [tuple(x) for x in back.tokenizations[0]] == [("xu", 2), ("lo", 4), ("lx", 6)]
    (tmp_path / "log.json").write_text('{"step": 0, "train_loss": Infinity}\n{"step": 1, "train_loss": 0.5}\n')
    assert readers.run_log(spark, str(tmp_path / "log.json")).agg(F.max("train_loss")).first()[0] == float("inf")
    (tmp_path / "c.txt").write_text("a b\n\nc\n")
    assert {r.line_no: r.tokens for r in readers.corpus(spark, str(tmp_path / "c.txt")).collect()}[0] == ["[BOS]", "a", "b", "[EOS]"]
    g = readers.gold_slots(spark.createDataFrame([("[SP1]-x-y",)], "segmentation string")).first()
    assert g.units == ["x", "y"] and g.categories == ["stem", "suffix"]
    with pytest.raises(Exception, match="two gold"):
        readers.checked_gold(spark.createDataFrame([("a", "x"), ("a", "y")], "word string, segmentation string")).collect()
    sinks.cache(t, str(tmp_path / "cache"))
    with pytest.raises(Exception):
        sinks.cache(t, str(tmp_path / "cache"), clear=False)


def test_dynamics(spark):
    e = spark.createDataFrame([("w", 0, 1, "a", -1.0, 0.5), ("w", 0, 2, "[PAD]", -1.0, 0.5)], "word string, s int, e int, token string, logp double, p double")
    assert dynamics.node_view(e, "word").first().nodes == '[[{"length":1,"unit":"a","start":0,"log_prob":-1.0,"marginal":0.5}]]'
    v = spark.createDataFrame([(0, "a")], "token_id int, token string")
    x = spark.createDataFrame([(1, 0, 0.123456, 1e-9)], "step int, token_id int, weight double, grad double")
    assert dynamics.weight_table(x, v).first().weight == "0.12"


QUICK = ["best_run", "metric_join", "gold_slots", "block_pack", "lattice_logz", "viterbi_1best", "skipgram_counts"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("run_log", "morpheme", "sentences", "documents"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries()[name](spark, d)
    r = con.execute(oracle_sql()[name])
    names = [c[0] for c in r.description]
    key = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in x) for x in rows), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert key(map(tuple, df.select(*names).collect())) == key(r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
