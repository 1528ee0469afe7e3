"""Sums over pairs of nodes and edges, made in batches of lattices."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import dynamics
from latticeflow.operators import lattice as L

WORDS = ["hate", "hat", "ateat", "t", "hxt", "hatehat" * 7]


@pytest.fixture(scope="module")
def lats(spark):
    units = [("h", -1.0), ("a", -2.0), ("t", -1.5), ("e", -2.5), ("ha", -2.2), ("at", -2.0), ("ate", -3.0), ("hate", -4.5), ("hat", -3.1)]
    vocab = spark.createDataFrame(units, "token string, logp double")
    edges = L.lattice_edges(spark.createDataFrame([(w,) for w in WORDS], "word string"), vocab, 4, 60)
    twice = edges.where("word = 'hat' and token = 'at'").withColumn("token", F.lit("[AT]")).withColumn("logp", F.lit(-2.7))  # two edges with the same ends
    return L.lattices(edges.unionByName(twice)).localCheckpoint()


def test_masses_are_sums_of_marginals(lats):
    want = defaultdict(lambda: [0, 0.0, 0.0])
    for r in L.conditional_marginals(lats).collect():
        w = want[r.word, r.node]
        w[0] += 1
        w[1 + (r.side == "after")] += math.exp(r.log_p)
    got = {(r.word, r.node): [r.edges, r.before, r.after] for r in L.conditional_mass(lats).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # nothing follows the last node, and no path of `hxt` visits a node and ends
    assert ("hxt", 0) not in got and got["hatehat" * 7, 49][2] == 0 and got["hat", 2][1] > 1


def test_attention_masses_are_sums_of_pairs(lats):
    want, pairs = defaultdict(lambda: [0, 0.0]), L.attention_bias(lats).collect()
    for r in pairs:
        want[r.word, r.src.s, r.src.e][0] += 1
        want[r.word, r.src.s, r.src.e][1] += math.exp(r.log_p)
    got = defaultdict(lambda: [0, 0.0])
    for r in L.attention_mass(lats).collect():
        got[r.word, r.s, r.e][0] += r.targets
        got[r.word, r.s, r.e][1] += r.mass
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    both = [r for r in pairs if r.word == "hat" and r.src == r.tgt and (r.src.s, r.src.e) == (1, 3)]
    assert len(both) == 4 and all(r.log_p == 0 for r in both)


def test_even_attention_is_the_statistics_of_its_pairs(lats):
    one = lats.where("word <> 'hat'")
    a = L.attention_bias(one).select(F.col("word").alias("ex_id"), "src", F.round(F.exp("log_p"), 9).alias("cond"), F.lit(False).alias("overlap"))
    n = a.groupBy("ex_id", "src").agg((1 / F.count("*")).alias("attention"))
    want = dynamics.attention_statistics(a.join(n, ["ex_id", "src"])).first()
    each = L.even_attention(one).select("over_count", "over_mass", F.lit(0.0).alias("leakage"), F.ln("targets").alias("h"))
    got = dynamics.summed_sources(each).first()
    assert got.asDict() == pytest.approx(want.asDict()) and got.over_count > 0
    empty = dynamics.summed_sources(each.limit(0)).first()
    assert empty.over_count == 0 and empty.over_mean is None


def test_lattices_stay_spread_over_tasks(spark):
    """Lattices of few bytes, but much work, were all put in one task."""
    words = spark.range(200).select(F.concat(F.lit("w"), "id").alias("word"))
    chars = spark.createDataFrame([(c, -2.0) for c in "w0123456789"], "token string, logp double")
    assert L.lattices(L.lattice_edges(words, chars)).rdd.getNumPartitions() >= 4
