import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import encode, lattice, reports, vocab

S = "row long, text string, tokenizations array<array<string>>, weights array<double>"


def cuts(rng, text):
    at = sorted(rng.sample(range(1, len(text)), rng.randint(0, len(text) - 1)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def spans(tokens):
    ends = list(itertools.accumulate(map(len, tokens)))
    return list(zip([0, *ends], ends))


def test_tokenization_report_against_brute_force(spark):
    rng = random.Random(1)
    gold, pred, cats = [], [], []
    for row in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        g, p = [[cuts(rng, text) for _ in range(rng.randint(1, 3))] for _ in range(2)]
        gw, pw = [[rng.random() for _ in x] for x in (g, p)]
        gold.append((row, text, g, gw, [[rng.choice("xy") for _ in t] for t in g]))
        pred.append((row, text, p, pw, float("-inf") if row % 7 == 0 else -rng.random()))
    got = {r.scope: r for r in reports.tokenization_report(
        spark.createDataFrame(gold, S + ", cats array<array<string>>"), spark.createDataFrame(pred, S + ", ref double"), categories="cats", reference="ref", skip_inf=True
    ).collect()}
    sums = {k: [0.0] * 6 for k in ("all", "x", "y")}
    unique = {k: set() for k in ("all", "x", "y", "pred")}
    for (_, _, g, gw, cs), (_, _, p, pw, ref) in zip(gold, pred):
        if ref == -math.inf:
            continue
        for (a, wa, ca), (b, wb) in itertools.product(zip(g, gw, cs), zip(p, pw)):
            w, sa, sb = wa * wb, spans(a), set(spans(b))
            ba, bb = {e for _, e in sa[:-1]}, {e for _, e in spans(b)[:-1]}
            for i, v in enumerate((len(set(sa) & sb), len(sb), len(sa), len(ba & bb), len(bb), len(ba))):
                sums["all"][i] += w * v
            unique["all"] |= set(a)
            unique["pred"] |= set(b)
            for i, ((lb, rb), c) in enumerate(zip(sa, ca)):
                inner = [x for x in bb if lb < x < rb]
                ends = (i < len(sa) - 1 and rb in bb) + (i > 0 and lb in bb)
                both = (w * ((lb, rb) in sb), w * (len(inner) + 1), w, w * ends, w * len([x for x in bb if lb <= x <= rb]), 1 if i in (0, len(sa) - 1) else 2)
                for k, v in enumerate(both):
                    sums[c][k] += v
                unique[c].add(a[i])
    for scope, (tp, ap, at, btp, bap, bat) in sums.items():
        r = got[scope]
        assert (r.token_precision, r.token_recall, r.boundary_precision, r.boundary_recall) == pytest.approx((tp / ap, tp / at, btp / bap, btp / bat))
        assert r.unique_gold_tokens == len(unique[scope])
    assert got["all"].unique_predicted_tokens == len(unique["pred"])
    refs = [r[-1] for r in pred if r[-1] > -math.inf]
    assert got["all"].reference_log_prob == pytest.approx(sum(refs) / sum(len(r[1]) for r in gold))
    empty = reports.tokenization_report(spark.createDataFrame([], S), spark.createDataFrame([], S)).first()
    assert empty.scope == "all" and empty.token_recall is None


def test_matches(spark):
    t = spark.createDataFrame([("Abcd", ["ab", "cd"], 3), ("abcd", ["abcd"], 2), ("xyz", ["xyz"], 5), ("uv", ["u", "v"], 7)], "word string, tokens array<string>, n long")
    g = spark.createDataFrame([("abcd", [[2, 2]])], "word string, signatures array<array<int>>")
    c = reports.match_counters(t, g)
    assert {(r.outcome, r.word): r.n for r in c.collect()} == {("multi-correct", "abcd"): 3, ("multi-incorrect", "abcd"): 2, ("mono-correct", "xyz"): 5, ("mono-incorrect", "uv"): 7}
    r = reports.match_report(c).first()
    assert (r.multi_share, r.mono_share, r.share) == pytest.approx((3 / 5, 5 / 12, 8 / 17))
    assert {(r.piece): (r.types, r.n) for r in reports.piece_usage(c).collect()}["ab"] == (1, 3)


def test_log_tools(spark):
    log = spark.createDataFrame([("b", 1, 5), ("a", 0, 7), ("b", 0, None), (None, 9, 9), ("a", 3, 1)], "key string, at long, v long")
    got = {r.key: (r.place, [x["v"] for x in r.rows]) for r in reports.checkpoints(log, "key", "at").collect()}
    assert got == {"a": (0, [7, 1]), "b": (1, [None, 5])}
    assert [r.at for r in reports.rows_where(log, {"key": "b"}, {"key": "^b"}).collect()].__len__() == 2
    assert reports.without_first(log.withColumnRenamed("at", "line_no"), 1).count() == 3
    words, n = reports.word_list(spark.createDataFrame([("b", 2), ("a", 1), ("b", 3)], "word string, n long"))
    assert [r.word for r in words.collect()] == ["a", "b"] and n == 6
    assert reports.violin(log, ["key"], "v").where("key = 'a'").first().median == 4


def test_dense_and_serial(spark):
    v = spark.createDataFrame([("a", 3, -1.0), ("b", 4, -1.0), ("ab", 9, -1.0)], "token string, token_id int, logp double")
    lats = lattice.lattices(lattice.lattice_edges(spark.createDataFrame([("ab",)], "word string"), v))
    d = encode.dense_transitions(lats, v, 2).first()
    assert d.ids == [[3, 4], [0, 9]] and d.mask == [[1, 1], [0, 1]]
    assert encode.dense_transitions(lats, v, 2, reverse=True).first().ids == [[4, 3], [0, 9]]
    x = encode.serial_inputs(lattice.lattice_edges(spark.createDataFrame([("ab",)], "word string"), v), v, node=1).first()
    assert (x.input_ids, x.starts, x.ends, x.node_ids) == ([3, 9, 4], [0, 0, 1], [1, 2, 2], [1, 1, 1])


def test_training_prunes_and_fits(spark):
    words = spark.createDataFrame([("abab", 50), ("abc", 20), ("cab", 5), ("x", 1)], "word string, n long")
    first = vocab.build_vocabulary(words, 3, 1)
    out = vocab.train(words, first, 6, max_unit=3, rounds=8)
    got = {r.token: r.logp for r in out.collect()}
    assert len(got) == 6 and {"a", "b", "c", "x", "ab"} <= set(got) and sum(map(math.exp, got.values())) == pytest.approx(1)
    z = lambda v: lattice.logz(lattice.lattices(lattice.lattice_edges(words, v))).join(words, "word").agg(F.sum(F.col("logz") * F.col("n"))).first()[0]
    assert z(out) > z(vocab.with_log_share(first.where("length(token) = 1").select("token", "n")))


def test_initial_weights(spark):
    t = spark.createDataFrame([(f"t{i}",) for i in range(4000)], "token string")
    r = vocab.initialised(t, sigma=2.0, mu=1.0, seed=3).agg(F.avg("logp").alias("m"), F.stddev("logp").alias("s")).first()
    assert r.m == pytest.approx(1, abs=0.15) and r.s == pytest.approx(2, abs=0.15)
    assert {r.logp for r in vocab.initialised(t, mu=-1.5).collect()} == {-1.5}
