import math

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import encode


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("a", 0, -1.0), ("b", 1, -1.0), ("ab", 2, -1.5), ("[UNK]", 3, 0.0), ("▁x", 4, -1.0)], "token string, token_id int, logp double")


def test_inputs(spark, vocab):
    edges = spark.createDataFrame([("ab", 0, 1, "a"), ("ab", 1, 2, "b"), ("ab", 0, 2, "ab"), ("ab", 0, 1, "zz")], "word string, s int, e int, token string")
    r = encode.lattice_inputs(edges, vocab, ["word"]).first()
    assert r.input_ids == [0, 2, 1] and r.position_ids == [0, 0, 1]
    two = edges.limit(2).withColumn("blk", F.col("s"))
    assert encode.lattice_inputs(two, vocab, ["word"], block="blk", length=10).first().position_ids == [0, 11]
    p = spark.createDataFrame([("x", ["ab", "a"]), ("none", [])], "word string, tokens array<string>")
    assert {tuple(r.input_ids): r.position_ids for r in encode.path_inputs(p, vocab, ["word"], characters=True).collect()} == {(2, 0): [0, 2]}
    assert {(r.src.s, r.src.e, r.tgt.s, r.tgt.e) for r in encode.causal_pairs(edges.where("token <> 'zz'")).collect()} == {(0, 1, 0, 1), (1, 2, 1, 2), (0, 2, 0, 2), (1, 2, 0, 1)}
    x = spark.createDataFrame([([1, 2],)], "i array<int>").select(encode.padded(F.col("i"), 3, 9).alias("p")).select("p", encode.attention_mask(F.col("p"), 9).alias("m")).first()
    assert x.p == [1, 2, 9] and x.m == [1, 1, 0]


def test_labels_lines_and_gold(spark, vocab):
    ex = spark.createDataFrame([(1, ["a", "q", None])], "id int, labels array<string>")
    assert sorted((r.pos, r.label_id) for r in encode.label_rows(ex, "id", "labels", vocab, stride=4).collect()) == [(0, 0), (4, -100), (8, -100)]
    lines = spark.createDataFrame([(1, ["ab", "qq", "ab"]), (2, [])], "id int, chunks array<string>")
    best = spark.createDataFrame([("ab", ["a", "b"], -2.0, -1.5)], "word string, tokens array<string>, logw double, logz double")
    got = encode.tokenize_lines(lines, best, "id").collect()
    assert [(r.id, r.logp, r.tokens) for r in got] == [(1, -1.0, ["[BOS]", "a", "b", "qq", "a", "b", "[EOS]"])]
    g = spark.createDataFrame([(1, ["x", "b", "x"])], "id int, pieces array<string>")
    assert encode.gold_ids(g, vocab, "id").first().ids == [4, 1, 3]
    r = lines.limit(1).select(encode.repack(F.array(F.lit("a"), F.lit("b"), F.lit("qq"), F.lit("ab")), F.col("chunks"), 4).alias("b")).first().b
    assert r == [["a", "b", "qq"], ["ab"]]
    info = {r.token: (r.is_special, r.is_singleton, r.len) for r in encode.unit_info(vocab).collect()}
    assert info["[UNK]"] == (True, False, 1) and info["a"] == (False, True, 1)


def test_losses_and_modes(spark):
    b = spark.createDataFrame([(1.0, 2.0, 10), (3.0, 0.0, 30), (2.0, None, 5)], "loss double, entropy double, chars int")
    r = encode.mean_losses(b).first()
    assert r.loss == 2.0 and r.entropy == 2.0
    assert encode.mean_losses(b.limit(0)).first().entropy is None
    t = spark.createDataFrame([(4.0, "abcd", ["ab", "cd"])], "loss double, text string, tokens array<string>")
    assert tuple(encode.loss_per_unit(t).first()) == (1.0, 2.0)
    assert encode.tokenizer("nbest") is encode.MODES["nbest"]
    with pytest.raises(ValueError):
        encode.tokenizer("sample")


def test_tokenizers_in_one_call(spark):
    units = {"▁": -3.0, "a": -1.0, "b": -1.5, "ab": -2.0, "▁a": -1.2, "▁ab": -2.5}
    v = spark.createDataFrame([(t, i, w) for i, (t, w) in enumerate(units.items())], "token string, token_id int, logp double")
    lines = spark.createDataFrame([(1, "ab a"), (2, None), (3, ""), (4, "zz"), (5, "ab")], "id int, text string")

    def paths(word):
        return [((), 0.0)] if not word else [((t, *p), w + x) for t, w in units.items() if word.startswith(t) for p, x in paths(word[len(t) :])]

    got = {r.id: r for r in encode.tokenize_lattice(lines, v, "id", max_blocks=2, max_unit=3, max_length=3).collect()}
    z = [math.log(sum(math.exp(w) for _, w in paths(c))) for c in ("▁ab", "▁a")]
    assert set(got) == {1, 5} and got[1].logz == pytest.approx(sum(z)) and got[5].logz == pytest.approx(z[0])
    assert got[1].position_ids == [0, 0, 0, 1, 1, 2, 3, 3, 4] and got[1].input_ids == [0, 4, 5, 1, 3, 2, 0, 4, 1]
    assert sum(got[5].marginals[:3]) == pytest.approx(1)
    h = -sum(math.exp(w - z[0]) * (w - z[0]) for _, w in paths("▁ab"))
    assert got[5].entropy == pytest.approx(h)
    cool = encode.tokenize_lattice(lines, v, "id", max_blocks=2, max_unit=3, max_length=3, temperature=0.5).where("id = 5").first()
    assert cool.logz == pytest.approx(math.log(sum(math.exp(w / 2) for _, w in paths("▁ab"))))
    refs = spark.createDataFrame([(5, [(0, 2)])], "id int, spans array<struct<s:int,e:int>>")
    whole = encode.tokenize_lattice(lines.where("id = 5"), v, "id", split=False, max_blocks=1, max_unit=3, references=refs).first()
    assert whole.ref_logp == pytest.approx(-2.0 - math.log(math.exp(-2.0) + math.exp(-2.5)))
    with pytest.raises(ValueError):
        encode.tokenize_lattice(lines, v, "id", references=refs)
    best = sorted((r for r in encode.tokenizer("nbest")(lines, v, "id", 2, max_blocks=2, max_unit=3, max_length=3).collect() if r.id == 1), key=lambda r: r["rank"])
    both = sorted((-(a[1] + b[1]), [*a[0], *b[0]]) for a in paths("▁ab") for b in paths("▁a"))
    assert [round(r.logw, 9) for r in best] == [round(-c, 9) for c, _ in both[:2]] and best[0].tokens == both[0][1]
    names = list(units)
    assert best[0].input_ids == [names.index(t) for t in best[0].tokens] and best[0].position_ids == list(range(len(best[0].tokens)))
    assert all(len(r.input_ids) == 1 for r in encode.tokenize_nbest(lines, v, "id", max_blocks=2, max_unit=3, max_length=3, max_tokens=1).collect())
