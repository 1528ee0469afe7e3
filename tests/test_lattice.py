import itertools
import math

import pytest
from pyspark.sql import functions as F

from latticeflow.functions import semiring as S
from latticeflow.functions import text as T
from latticeflow.operators import lattice as L
from latticeflow.operators import vocab as V
from latticeflow.streaming.tokenize import log_windows, stream_tokenize

WEIGHTS = {"h": 1, "a": 1, "t": 1, "e": 1, "at": 2, "hat": 3, "ate": 4, "hate": 5}


def paths(word, weights, most=4):
    if not word:
        return [((), 0.0)]
    return [((word[:n], *p), math.log(weights[word[:n]]) + w) for n in range(1, min(most, len(word)) + 1) if word[:n] in weights for p, w in paths(word[n:], weights, most)]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(t, math.log(w)) for t, w in WEIGHTS.items()], "token string, logp double")


@pytest.fixture(scope="module")
def lats(spark, vocab):
    words = spark.createDataFrame([("hate",), ("hat",), ("ateat",), ("hate",), (None,), ("",), ("x" * 60,), ("hxt",)], "word string")
    return L.lattices(L.lattice_edges(words, vocab)).cache()


def test_partition_and_best_path(lats):
    got = {r.word: r for r in L.logz(lats).collect()}
    for word, z, n in (("hate", 15, 5), ("hat", 6, 3), ("ateat", 21, 6)):
        assert got[word].logz == pytest.approx(math.log(z)) and got[word].paths == n
    assert got["hxt"].logz == float("-inf") and got["hxt"].paths == 0
    best = {r.word: r for r in L.viterbi(lats).collect()}
    assert best["hate"].tokens == ["hate"] and best["ateat"].tokens == ["ate", "at"] and best["ateat"].logw == pytest.approx(math.log(8))
    assert "hxt" not in best


def test_marginals_entropy_and_invariant(lats):
    m = {(r.word, r.s, r.e): r.p for r in L.edge_marginals(lats).collect()}
    expected = {(0, 1): 0.466667, (0, 3): 0.2, (0, 4): 1 / 3, (1, 2): 1 / 15, (1, 3): 2 / 15, (1, 4): 4 / 15, (2, 3): 1 / 15, (3, 4): 0.4}
    for (s, e), p in expected.items():
        assert m["hate", s, e] == pytest.approx(p, abs=1e-6)
    for word in ("hate", "hat", "ateat"):
        for c in range(len(word)):
            assert sum(p for (w, s, e), p in m.items() if w == word and s <= c < e) == pytest.approx(1)
    h = {r.word: r for r in L.entropies(lats).collect()}
    assert h["hate"].entropy == pytest.approx(1.489750, abs=1e-6) and h["ateat"].entropy == pytest.approx(1.592214, abs=1e-6)
    assert h["hxt"].entropy is None


def test_nbest_and_conditionals_against_enumeration(lats):
    rows = L.nbest(lats, 4).collect()
    for word in ("hate", "hat", "ateat"):
        all_paths = sorted(paths(word, WEIGHTS), key=lambda p: (-round(p[1], 9), len(p[0]), p[0]))[:4]
        got = sorted([r for r in rows if r.word == word], key=lambda r: r["rank"])
        assert [tuple(r.tokens) for r in got] == [p for p, _ in all_paths]
        assert sum(r.weight for r in got) == pytest.approx(1)
    cond = {(r.word, r.node, r.side, r.s, r.e): r.log_p for r in L.conditional_marginals(lats).collect()}
    for word in ("hate", "ateat"):
        for node in range(len(word) + 1):
            ps = [(p, math.exp(w)) for p, w in paths(word, WEIGHTS) if node in {0, *itertools.accumulate(map(len, p))}]
            total = sum(w for _, w in ps)
            for s, e in itertools.combinations(range(len(word) + 1), 2):
                mass = sum(w for p, w in ps if (s, e) in set(zip([0, *itertools.accumulate(map(len, p))], itertools.accumulate(map(len, p)))))
                side = "before" if e <= node else "after"
                if mass:
                    assert cond[word, node, side, s, e] == pytest.approx(math.log(mass / total))
                else:
                    assert (word, node, side, s, e) not in cond


def test_attention_causal_reference_and_normalised(spark, lats):
    a = L.attention_bias(lats).where("word = 'hat'").collect()
    v = {(tuple(r.src), tuple(r.tgt)): r.log_p for r in a}
    assert v[(0, 1), (0, 1)] == 0 and ((0, 3), (0, 1)) not in v
    assert v[(0, 1), (1, 3)] == pytest.approx(math.log(2 / 3))
    causal = {(tuple(r.src), tuple(r.tgt)) for r in L.attention_bias(lats, causal=True).where("word = 'hat'").collect()}
    assert ((0, 1), (1, 3)) not in causal and ((1, 3), (0, 1)) in causal
    refs = spark.createDataFrame([("hate", [(0, 3), (3, 4)]), ("hat", [(0, 2), (2, 3)])], "word string, spans array<struct<s:int,e:int>>")
    got = {r.word: r.ref_logp for r in L.reference_logprob(lats, refs).collect()}
    assert got["hate"] == pytest.approx(math.log(3 / 15)) and got["hat"] == float("-inf")
    gold = {r.word: r for r in L.gold_marginals(lats, refs).collect()}
    assert gold["hate"].path_p == pytest.approx(0.2) and gold["hate"].edge_p == pytest.approx(0.6) and gold["hat"].path_p == 0
    out = L.forward_normalised(lats).groupBy("word", "s").agg(F.sum(F.exp("log_p")).alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in out)


def test_blocks_see_other_blocks_by_marginal(spark, vocab):
    edges = L.lattice_edges(spark.createDataFrame([("hat",), ("at",)], "word string"), vocab)
    both = L.lattices(edges).withColumn("doc", F.lit(1)).withColumn("block", F.when(F.col("word") == "hat", 0).otherwise(1))
    rows = L.attention_bias(both, key="doc", block="block").where("block = 1 and tgt_block = 0 and tgt.s = 0 and tgt.e = 3").collect()
    assert rows and all(r.log_p == pytest.approx(math.log(0.5)) for r in rows)


def test_mixture(spark, vocab):
    words = spark.createDataFrame([("hat",), ("at",), ("zz",)], "word string")
    second = vocab.withColumn("logp", F.lit(0.0)).where("token <> 'hat'")
    edges = L.lattice_edges(words, vocab).withColumn("k", F.lit("a")).unionByName(L.lattice_edges(words, second).withColumn("k", F.lit("b")))
    m = {(r.word, r.s, r.e): (r.p, r.log_c) for r in L.mixture(edges, 2).collect()}
    # hat: h+a+t 1, h+at 2, hat 3 of 6 by the first; h+a+t and h+at by the second
    assert m["hat", 0, 3][0] == pytest.approx((3 / 6 + 0) / 2) and m["hat", 1, 3][0] == pytest.approx((2 / 6 + 1 / 2) / 2) and m["hat", 0, 1][0] == pytest.approx((3 / 6 + 1) / 2)
    assert m["hat", 1, 3][1] == pytest.approx(math.log(m["hat", 1, 3][0] / (m["hat", 1, 2][0] + m["hat", 1, 3][0])))
    h = {r.word: r.entropy for r in L.mixture_entropy(L.mixture(edges, 2)).collect()}
    assert h["hat"] == pytest.approx(-sum(p * c for (w, *_), (p, c) in m.items() if w == "hat" and p)) and "zz" not in h
    assert L.mixture(edges.limit(0), 2).count() == 0


def test_segmented_and_blocks(spark, lats):
    got = {r.word: (r.tokens, round(r.logw, 6), round(r.logz, 6)) for r in L.segmented(lats).collect()}
    for word in ("hate", "ateat"):
        best = max(paths(word, WEIGHTS), key=lambda p: (round(p[1], 9), -len(p[0])))
        assert got[word][1] == pytest.approx(best[1], abs=1e-6) and got[word][2] == pytest.approx(math.log(sum(math.exp(w) for _, w in paths(word, WEIGHTS))), abs=1e-6)
    assert "hxt" not in got
    two = lats.where("word in ('hat', 'ateat')").withColumn("doc", F.lit(7)).withColumn("block", F.when(F.col("word") == "hat", 0).otherwise(1))
    rows = sorted(L.nbest_of_blocks(two, 3, "doc").collect(), key=lambda r: r["rank"])
    both = sorted((-(a[1] + b[1]), len(a[0]) + len(b[0]), [*a[0], *b[0]]) for a in paths("hat", WEIGHTS) for b in paths("ateat", WEIGHTS))
    assert [round(r.logw, 6) for r in rows] == [round(-c, 6) for c, *_ in both[:3]] and rows[0].tokens == both[0][2] and sum(r.weight for r in rows) == pytest.approx(1)


def test_unknown_and_marked_units(spark):
    v = spark.createDataFrame([("▁ha", -1.0), ("t", -2.0), ("a", -1.5)], "token string, logp double")
    e = {(r.s, r.e): (r.token, r.logp) for r in L.lattice_edges(spark.createDataFrame([("hat",)], "word string"), v, unk=-9.0, fallback=True).collect()}
    assert e == {(0, 1): ("[UNK]", -9.0), (0, 2): ("▁ha", -1.0), (1, 2): ("a", -1.5), (2, 3): ("t", -2.0)}


def test_arguments_are_checked():
    for args in ((0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 1, 1)):
        with pytest.raises(ValueError):
            L.check(*args)


def test_merge_of_blocks(spark):
    b = "array<array<struct<cost:double,size:int,path:array<string>>>>"
    df = spark.createDataFrame([([[(1.0, 1, ["a"]), (2.0, 1, ["b"])], [(0.5, 1, ["c"]), (3.0, 1, ["d"])]],)], f"b {b}")
    got = df.select(S.merge_nbest(F.col("b"), 3).alias("x")).first().x
    assert [r.path for r in got] == [["a", "c"], ["b", "c"], ["a", "d"]]


def test_empty_tables(spark, vocab):
    none = spark.createDataFrame([], "word string")
    lat = L.lattices(L.lattice_edges(none, vocab))
    assert L.logz(lat).count() == 0 and L.edge_marginals(lat).count() == 0 and L.nbest(lat, 2).count() == 0
    assert V.build_vocabulary(spark.createDataFrame([], "word string, n long")).count() == 0


def test_vocabulary(spark):
    t = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "c")], "line_no long, token string")
    assert sorted(map(tuple, V.dense_ids(t).collect())) == [(0, "b"), (1, "a"), (2, "c")]
    w = spark.createDataFrame([("aab", 2), ("ab", 1)], "word string, n long")
    assert {r.token: r.n for r in V.substrings(w, 2).collect()} == {"a": 5, "b": 3, "aa": 2, "ab": 3}
    n = V.normalise(V.build_vocabulary(w, 2, 3)).agg(F.sum(F.exp("normalised"))).first()[0]
    assert n == pytest.approx(1)
    v = spark.createDataFrame([("a", -1.0), ("b", -2.0), ("c", -30.0), ("[PAD]", -5.0)], "token string, logp double")
    assert {r.token for r in V.subsample(v, 2, 1, ["[PAD]"]).collect()} >= {"[PAD]"} and V.subsample(v, 2, 1, ["[PAD]"]).count() == 3
    c = {r.token: r.logp for r in V.clamped(v, specials=["[PAD]"]).collect()}
    assert c["[PAD]"] == 0 and c["c"] == pytest.approx(math.log(1e-6))
    x = V.length_bias(v)
    assert sum(math.exp(len(t) * x) for t in ("a", "b", "c", "[PAD]")) == pytest.approx(math.e, rel=1e-6)


def test_em_raises_likelihood(spark, vocab):
    words = spark.createDataFrame([("hate", 3), ("hat", 2), ("ateat", 1)], "word string, n long")
    v = V.normalise(vocab).select("token", F.col("normalised").alias("logp"))
    before = L.logz(L.lattices(L.lattice_edges(words, v))).join(words, "word").agg(F.sum(F.col("logz") * F.col("n"))).first()[0]
    v2 = L.em_step(L.lattices(L.lattice_edges(words, v)), words)
    after = L.logz(L.lattices(L.lattice_edges(words, v2))).join(words, "word").agg(F.sum(F.col("logz") * F.col("n"))).first()[0]
    assert after > before


def test_text_functions(spark):
    df = spark.createDataFrame([(["_hello", "_I", "_am", "_some", "_code"],)], "c array<string>")
    assert df.select(T.pack_blocks(F.col("c"), 6).alias("b")).first().b == [["_hello"], ["_I", "_am"], ["_some"], ["_code"]]
    assert df.select(T.truncate_blocks(F.col("c"), 6, 2).alias("b")).first().b == [["_hello"], ["_I", "_am"]]
    row = spark.createDataFrame([(" ab [SP1] c ", ["[SP1]", "xu"], [], "abcde", [2, 3])], "t string, u array<string>, n array<string>, s string, l array<int>").select(
        T.space_chunks(F.col("t")).alias("chunks"), T.with_boundaries(F.col("u")).alias("b"), T.spans(F.col("n")).alias("none"), T.cut_by_signature(F.col("s"), F.col("l")).alias("cut"), T.two_digits(F.lit(0.01234)).alias("d"), T.edge_count(F.lit(5), 3).alias("e")
    ).first()
    assert row.chunks == ["▁ab", "[SP1]", "▁c"] and [tuple(x) for x in row.b] == [("[SP1]", 1), ("xu", 3)] and row.none == [] and row.cut == ["ab", "cde"] and row.d == "0.012" and row.e == 12


def test_long_chunks_and_digits(spark):
    r = spark.createDataFrame([(["abcdefg", "", "abc", "x"],), ([],), (None,)], "c array<string>").select(T.cut_long(F.col("c"), 3).alias("c")).collect()
    assert [x.c for x in r] == [["abc", "def", "g", "abc", "x"], [], None]
    values = [0.5, 12.0, 1e-05, 1.0, 0.0, 100.0, -3.25, 9.99, float("inf"), 0.125, 0.285, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.two_digits(F.col("v")).alias("d"))
    assert [(r.v, r.d) for r in df.collect()] == [(v, None if v is None else format(v, ".2")) for v in values]


def test_stream(spark, vocab, tmp_path):
    spark.createDataFrame([("hate", 1), (None, 2), ("", 3)], "word string, id int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string, id int").parquet(str(tmp_path / "in"))
    q = stream_tokenize(stream, vocab).writeStream.format("memory").queryName("best").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.best for r in spark.table("best").collect()}
    assert got[1][0].path == ["hate"] and got[2] is None and got[3] is None
    e = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 1.0D value, 7L user_id")
    assert log_windows(e).first().n == 1


def test_encoding_fixture(spark):
    names = ["[UNK]", "▁", "▁h", "▁hat", "▁hate", "▁a", "▁ate", "▁at", "t", "a", "e", "h", "at", "ate", "hat"]
    v = spark.createDataFrame([(t, float(i)) for i, t in enumerate(names)], "token string, logp double")
    e = L.lattice_edges(spark.createDataFrame([("▁hate",), ("▁ate",), ("▁hote",)], "word string"), v, max_unit=3, max_length=5, unk=0.0).collect()
    got = {w: {(r.s, r.e): int(r.logp) for r in e if r.word == w} for w in ("▁hate", "▁ate", "▁hote")}
    assert got["▁hate"] == {(0, 1): 1, (1, 2): 11, (2, 3): 9, (3, 4): 8, (4, 5): 10, (0, 2): 2, (2, 4): 12, (1, 4): 14, (2, 5): 13}
    assert got["▁ate"] == {(0, 1): 1, (1, 2): 9, (2, 3): 8, (3, 4): 10, (0, 2): 5, (1, 3): 12, (0, 3): 7, (1, 4): 13}
    assert got["▁hote"] == {(0, 1): 1, (1, 2): 11, (2, 3): 0, (3, 4): 8, (4, 5): 10, (0, 2): 2}


def test_blocks_of_sentences(spark):
    v = spark.createDataFrame([(t, -1.0) for t in ("_", "I", "_I", "a", "m", "_a", "am", "_am", "I_", "I_a")], "token string, logp double")
    lines = spark.createDataFrame([(1, ["[SP1]", "_I", "_am"]), (2, None), (3, [])], "id int, chunks array<string>")
    e = {(r.block, r.s, r.e): r.token for r in L.sentence_edges(lines, v, "id", max_unit=3, max_length=6, max_blocks=2).collect()}
    assert e[0, 0, 1] == "[SP1]" and e[0, 1, 3] == "_I" and e[0, 3, 6] == "_am"
    assert not [k for k in e if k[1] < 3 < k[2]]
    with pytest.raises(Exception, match="fit"):
        L.sentence_edges(lines, v, "id", max_unit=3, max_length=3, max_blocks=1).collect()
