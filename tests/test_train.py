"""Vocabulary training by numbered units against rounds that make their lattices anew."""

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import lattice as L
from latticeflow.operators import vocab as V


def test_both_ways_of_training_agree(spark, monkeypatch):
    made = []
    words = spark.createDataFrame([("hatehate", 5), ("hat", 9), ("ateat", 2), ("tea", 4), ("eat", 4), ("x" * 60, 1), ("hate", 0)], "word string, n long")
    first = V.build_vocabulary(words, 4, 2).select("token", "logp")
    edges = L.lattice_edges
    monkeypatch.setattr(L, "lattice_edges", lambda *a, **k: made.append(1) or edges(*a, **k))
    for size, rounds in ((9, 6), (14, 16), (1000, 3)):
        made.clear()
        quick = {r.token: r.logp for r in V.train(words, first, size, rounds=rounds).collect()}
        assert len(made) == 1  # lattices were made anew every round
        with monkeypatch.context() as m:
            m.setattr(L, "SMALL_VOCABULARY", 0)
            slow = {r.token: r.logp for r in V.train(words, first, size, rounds=rounds).collect()}
        assert quick == pytest.approx(slow) and len(quick) <= max(size, 5)


def test_training_without_words_or_units(spark):
    words = spark.createDataFrame([("ab", 3), (None, 1)], "word string, n long")
    units = spark.createDataFrame([("a", -1.0), ("ab", -2.0)], "token string, logp double")
    assert V.train(words.limit(0), units, 5, rounds=2).where("token = 'a'").count() == 1
    assert V.train(words, units.limit(0), 5, rounds=2).count() == 0
    assert {r.token for r in V.train(words, units, 5, rounds=2).select(F.col("token")).collect()} == {"a", "ab"}
