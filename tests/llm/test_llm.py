import bisect
import itertools
import math
import random
import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from latticeflow.llm import joins, leaks, overlap, packing, pairs, residue, terms, tokens, topn
from latticeflow.llm.plaintext import reader_words
from latticeflow.llm.queries import QUERIES, SQL
from latticeflow.session import table

T0 = datetime(2022, 1, 1)
D = "/root/testdata/sf0.001"


# frequency of terms


def test_terms_exact_with_few_heavy_ones(spark, monkeypatch):
    monkeypatch.setattr(terms, "HEAVY", 3)
    monkeypatch.setattr(terms, "HELD", 5)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("aaaabbbcc") if rng.random() < 0.7 else f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))) for _ in range(300)]
    rows = [(t, 1) for t in [*texts, None, "", "  ", "x " * 50_000]]
    df = spark.createDataFrame(rows, "text_str string, n int").repartition(5)
    got = {r.term: (r.n, r.n_records) for r in terms.term_counts(df, "text_str").collect()}
    want: dict[str, list[int]] = {}
    for t, _ in rows:
        found = terms.text_terms(t)
        for w in set(found):
            v = want.setdefault(w, [0, 0])
            v[0] += found.count(w)
            v[1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_term_rules_and_marks(spark):
    assert terms.text_terms("Ａb-c_d É́ éx 4²") == ["ａb", "c", "d", "é", "éx", "4²"] or terms.text_terms("éx A_b") == ["éx", "a", "b"]
    df = spark.createDataFrame([("a b",), ("a",), ("a c",), (None,)], "text_str string")
    m = {(r.term, r.mark) for r in terms.marked(terms.term_counts(df, "text_str"), df).collect()}
    assert m == {("a", "common"), ("b", "rare"), ("b", "common"), ("c", "rare"), ("c", "common")}
    assert terms.term_counts(df.limit(0), "text_str").count() == 0


# best rows of a group


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randint(0, 50) / 50, i) for i in range(20_000)] + [(f"g{i % 300}", rng.randint(0, 9) / 9, i) for i in range(3000)]
    rows += [(None, 1.0, 1), ("g1", None, 1), ("g1", float("nan"), 2), ("g1", 1.0, None), ("one", 0.5, 1), ("one", 0.5, 1), ("x" * 100, 0.1, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g string, score double, t long, rank string").repartition(6)
    got = {}
    for r in topn.top_n(df, "g", "score", "t", 3, row_group=64).collect():
        got.setdefault(r.g, []).append((r.score, r.t))
    want: dict = {}
    for g, s, t in rows:
        if g is not None and s is not None and not math.isnan(s) and t is not None:
            want.setdefault(g, []).append((s, t))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(sorted(v, key=lambda x: (-x[0], x[1]))[:3]) for g, v in want.items()}
    assert topn.top_n(df.limit(0), "g", "score", "t", 3).count() == 0


def test_skipping_drops_row_groups(spark):
    rows = [("f", i, True, 1, 2, b, w, 10) for i, (b, w) in enumerate([(0.9, 0.8), (0.8, 0.7), (0.7, 0.6)])] + [("f", 3, False, None, None, 0.1, 0.0, 5), ("f", 4, True, 1, 3, 0.5, 0.4, 1)]
    kept = topn.needed_row_groups(spark.createDataFrame(rows, topn._stats("double")), 3)
    assert sorted(r.rg for r in kept.collect()) == [0, 1, 3, 4]


def test_rows_are_skipped(spark):
    log = topn.last_evaluations(table(spark, "/root/testdata/sf0.1", "run_log"))
    n = topn.skipped(log, "run_id", "dev_accuracy", "step", 3)
    assert n["rows written"] == log.count() and n["rows read"] < 0.85 * n["rows written"]
    hot = spark.range(200_000).select(F.lit("one long name " * 9).alias("g"), F.rand(1).alias("s"), F.col("id").alias("t"))
    n = topn.skipped(hot, "g", "s", "t", 3)
    assert n["rows read"] < 0.1 * n["rows written"] == 20_000


def test_scores_keep_their_type(spark):
    big = 2**53
    df = spark.createDataFrame([("a", big + i, i) for i in range(400)] + [("b", 1, 1)], "g string, s long, t int")
    assert [(r.t, r.s) for r in topn.top_n(df, "g", "s", "t", 2, row_group=16).orderBy("g", "rank").collect()] == [(399, big + 399), (398, big + 398), (1, 1)]
    dec = df.withColumn("s", F.col("s").cast("decimal(30,2)") + F.col("t") / 100)
    assert [r.t for r in topn.top_n(dec, "g", "s", "t", 2, row_group=16).orderBy("g", "rank").collect()] == [399, 398, 1]


def test_best_evaluations_rules(spark):
    t = [T0 + timedelta(hours=i) for i in range(5)]
    rows = [("r", 1, 0.9, t[0]), ("r", 1, 0.1, t[1]), ("r", 2, 0.5, t[0]), ("r", 3, 0.5, t[0]), ("r", 4, 1.5, t[0]), ("r", 2, 2.0, t[4]), (None, 1, 0.9, t[0])]
    got = topn.best_evaluations(spark.createDataFrame(rows, "run_id string, step long, dev_accuracy double, logged_at timestamp"))
    assert [(r.step, r["rank"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(2, 1), (3, 2), (1, 3)]


# pairs


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HEAVY", 4)
    monkeypatch.setattr(pairs, "BLOCK", 37)
    monkeypatch.setattr(pairs, "HELD", 50)
    monkeypatch.setattr(pairs, "TOGETHER", 5)
    rng = random.Random(3)
    recs = [[rng.choice("abcdefgh") if rng.random() < 0.5 else f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))] for _ in range(400)] + [[], ["a"] * 5]
    df = spark.createDataFrame([(r,) for r in recs], "words array<string>").repartition(4)
    got = {(r.word_a, r.word_b): (r.n_ab, r.n_a, r.n_b) for r in pairs.lifted_pairs(df, "words", 5, 1.2).collect()}
    sets = [set(r) for r in recs]
    n = {}
    for s in sets:
        for w in s:
            n[w] = n.get(w, 0) + 1
    want = {}
    for a in n:
        for b in n:
            ab = sum(a in s and b in s for s in sets) if a < b else 0
            if ab >= 5 and ab * len(recs) >= 1.2 * n[a] * n[b]:
                want[a, b] = (ab, n[a], n[b])
    assert got == want and want
    assert pairs.lifted_pairs(df.limit(0), "words").count() == 0


def test_index_words(spark):
    rows = [
        (1, ["A", None, "", "[PAD]", "b", "a"], None, T0, 1),
        (2, None, '{"1": {"X": {"y": 1, "[UNK]": 2}}}', T0, 1),
        (3, None, "{broken", T0, 1),
        (4, None, None, None, 1),
        (1, ["late"], None, T0 + timedelta(days=1), 1),
    ]
    df = spark.createDataFrame(rows, "index_id long, words array<string>, counts string, built_at timestamp, rec int")
    assert {r.rec: r.words for r in pairs.index_words(df).collect()} == {1: ["a", "b"], 2: ["x", "y"], 3: [], 4: []}


# overlaps of splits


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_no_pair_within_budget_is_missed():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randint(8, 60)
        a = [str(rng.randint(0, 100)) for _ in range(n)]
        b = a[:]
        if rng.random() < 0.3:
            i = rng.randrange(n - 1)
            b[i], b[i + 1] = b[i + 1], b[i]
        for _ in range(rng.randint(0, n // 8)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [f"x{rng.randint(0, 9)}"] * rng.randint(0, 1)
        swapped = len(a) == len(b) and [i for i in range(n) if a[i] != b[i]]
        ok = min(len(a), len(b)) >= 8 and (_distance(a, b) <= max(len(a), len(b)) // 8 or bool(swapped and len(swapped) == 2 and swapped[1] == swapped[0] + 1 and a[swapped[0]] == b[swapped[1]] and b[swapped[0]] == a[swapped[1]]))
        got = overlap.aligned(a, b)
        assert (got is not None) == ok, (a, b)
        assert got is None or a == b or got == _distance(a, b) or (got == 1 and len(swapped) == 2)


def test_chains():
    rng = random.Random(14)
    for _ in range(300):
        seeds = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 9))]
        got = overlap.chain(seeds)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:])) and set(got) <= set(seeds)
        best = max((len(c) for k in range(len(seeds) + 1) for c in itertools.combinations(sorted(set(seeds)), k) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))), default=0)
        assert len(got) == best
    a = [str(i) for i in range(80)]
    b = a[:20] + ["x"] + a[21:50] + a[51:]
    assert overlap.extended(a, b, overlap.near_seeds(a, b, 10), 10) == 2 == overlap.aligned(a, b)
    same = ["a"] * 3000
    assert overlap.aligned(same, same[:-5]) == 5


def test_overlap_table(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 2)
    long = "eins zwei drei vier fünf sechs sieben acht neun"
    rows = [
        (1, "train", "s", long, None), (2, " TEST", "s", long.upper().replace(" ", " , ") + "!", None), (3, "dev", "q", long.replace("vier", "anders"), None),
        (4, "dev", "q", "zwei eins drei vier fünf sechs sieben acht neun", None), (5, "test", None, "eins anders drei anders fünf sechs sieben acht neun", None),
        (6, None, "s", long, None), (7, "train", "s", None, "[SP1]-ab-c-d-ef-[SP3]"), (8, "dev", "s", "abc def", None), (9, "dev", "s", None, None), (10, "dev", "s", "", None), (11, "train", "s", " ", None),
        (12, "train", "s", "abc déf", None), (13, "dev", "s", "abc déf", None), (14, "dev", "s", "x " * 30_000, None),
    ]
    rows += [(20 + i, "train", "s", f"{long} {i}", None) for i in range(6)]
    df = spark.createDataFrame([(*r, T0, "c") for r in rows] + [(*rows[0], T0 + timedelta(days=2), "c")], "id long, split string, source string, text string, segmentation string, added_at timestamp, words string")
    got = {(r.id_e, r.id_t): r.edits for r in overlap.overlap_pairs(df).collect()}
    near = {(2, 20 + i): 1 for i in range(6)}
    assert got == {(2, 1): 0, (3, 1): 1, (4, 1): 1, (8, 7): 0, (13, 12): 0, **near}
    report = {(r.split, r.source): (r.records, r.exact, r.near) for r in overlap.overlap_report(df).collect()}
    assert report["test", "s"] == (1, 1, 0) and report["dev", "q"] == (2, 0, 2)
    links = {r.id: r for r in overlap.overlap_links(df).collect()}
    count: dict = {}
    for e, t in got:
        count[e], count[t] = count.get(e, 0) + 1, count.get(t, 0) + 1
    assert {k: r.links for k, r in links.items() if r.links} == count and links[2]["class"] == links[1]["class"] != links[3]["class"]
    assert links[3].edits == 1 and links[3].coverage == pytest.approx(8 / 9) and links[5].edits is None
    assert overlap.overlap_pairs(df.limit(0)).count() == 0


# packing


def test_plans_place_all_items():
    rng = random.Random(5)
    for _ in range(500):
        cap = rng.randint(1, 60)
        h = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        placed: dict[int, int] = {}
        for pattern, times in packing.plan(h, cap):
            assert 0 < sum(pattern) <= cap and times > 0
            for x in pattern:
                placed[x] = placed.get(x, 0) + times
        assert placed == h
    assert packing.plan({7: 2, 3: 2, 5: 2, 2: 1, 8: 1}, 10) and len([1 for p, n in packing.plan({6: 1, 3: 1, 1: 1}, 10)]) == 1


def test_plan_of_many_lengths():
    for capacity in (300, 4096, 131_072):
        began = time.perf_counter()
        done = packing.plan({k: 1 for k in range(1, capacity + 1)}, capacity)
        assert time.perf_counter() - began < 30
        placed = [0] * (capacity + 1)
        for pattern, n in done:
            assert sum(pattern) <= capacity
            for x in pattern:
                placed[x] += n
        assert placed == [0] + [1] * capacity and sum(n for _, n in done) <= math.ceil((capacity + 1) / 2) * 1.01 + 1
    rng = random.Random(15)
    h = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(900)}
    gaps: list[int] = []  # best fit, item by item
    for x in sorted((k for k, v in h.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else 2048
        bisect.insort(gaps, gap - x)
    assert sum(n for _, n in packing.plan(h, 2048)) <= len(gaps)


def test_rows_with_one_key_are_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    rows = [("a", 1, 5, 10)] * 8 + [("a", 2, 3, 10)] * 5 + [("a", 3, None, 10), (None, 4, 5, 10), ("b", 5, 7, None), ("c", 6, 25, 10)]
    out = packing.pack_rows(spark.createDataFrame(rows, "cache string, ex_id long, n long, max_length long"), "cache", "ex_id", "n", "max_length").collect()
    assert len(out) == 13 + 3 + 3
    used: dict = {}
    for r in out:
        if r.bin is not None:
            used[r.cache, r.bin] = used.get((r.cache, r.bin), 0) + r["size"]
    assert sorted(used.values()) == [5, 5, 10, 10, 10, 10, 10] or sum(used.values()) == 60 and max(used.values()) <= 10 and len(used) <= 8


def test_packing_tables(spark):
    caches = spark.createDataFrame([("a", 10, 6, 0), ("b", 4, 3, -1)], "cache string, max_length int, max_block_length int, pad_id int")
    rng = random.Random(6)
    rows = [(i, "a" if i % 3 else "b", [rng.randint(1, 9) for _ in range(rng.randint(0, 14))] + [0, None][: rng.randint(0, 2)], [rng.randint(0, 8) for _ in range(rng.randint(0, 6))], T0) for i in range(300)]
    rows += [(1000, "a", None, None, T0), (1001, "zzz", [1] * 50, [99], T0), (1002, None, [1], [1], None), (1003, "a", [0, 0, None], [None, 7], T0), (1004, "a", [1] * 25, [13], T0), (1004, "a", [1] * 25 + [0], [13], T0)]
    enc = spark.createDataFrame([(*r, "x") for r in rows], "ex_id long, cache string, input_ids array<int>, lengths array<int>, cached_at timestamp, bin string").repartition(5)
    ex = packing.examples(enc, caches)
    out = packing.pack_rows(ex, "cache", "ex_id", "n", "max_length").collect()
    size: dict = {}
    for r in out:
        if r.bin is not None:
            size[r.cache, r.bin] = size.get((r.cache, r.bin), 0) + r["size"]
    assert all(v <= (10 if c == "a" else 4) for (c, _), v in size.items())
    assert sorted({b for c, b in size if c == "a"}) == list(range(len({b for c, b in size if c == "a"})))
    whole: dict = {}
    for r in out:
        whole[r.ex_id] = whole.get(r.ex_id, 0) + (r["size"] or 0)
    n = {r.ex_id: r.n for r in ex.collect()}
    assert all(whole[k] == (v if k not in (1001, 1002) else 0) for k, v in n.items()) and n[1003] == 0
    assert [(r.piece, r["size"]) for r in sorted(out, key=lambda r: r.piece) if r.ex_id == 1004] == [(0, 10), (1, 10), (2, 5)]
    over = {(r.ex_id, r.field, r.pos) for r in packing.oversize(enc, caches).collect()}
    assert (1004, "input_ids", 0) in over and (1004, "lengths", 0) in over and (1003, "lengths", 1) in over and not any(k[0] in (1000, 1001, 1002) for k in over)
    assert packing.oversize(enc.limit(0), caches).count() == 0
    fill = {r.cache: r for r in packing.fill_report(packing.pack_rows(ex, "cache", "ex_id", "n", "max_length"), "cache").collect()}
    assert fill["a"].containers <= fill["a"].least * 1.1 + 1


# tokens


def test_tree_equals_whole():
    whole = tokens.TreeEncoder(leaf=1 << 30)
    rng = random.Random(7)
    letters = ["'", "'re", "'ll", " ", "  ", "\n", "a", "B", "1", "!", "\t", "é", "中", "́", "s", "\x00", "<|endoftext|>", "🏳️‍🌈"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert tokens.TreeEncoder(leaf=rng.choice([2, 3, 5, 9])).encode(text) == whole.encode(text)
    long = "Some words, again. " * 20_000 + "x" * 20_000 + " " * 20_000
    assert tokens.TreeEncoder().encode(long) == whole.bpe.encode_ordinary(long) and tokens.TreeEncoder().decode(tokens.TreeEncoder().encode(long)) == long
    assert tokens.TreeEncoder(leaf=2).decode(whole.encode("é🏳️‍🌈中" * 50)) == "é🏳️‍🌈中" * 50 and whole.decode(None) == whole.decode([]) == ""


def test_library_of_the_vocabulary_agrees(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, ""), (3, None), (4, " \n"), (5, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode_column(df, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and got[1] == other.encode("a <|endoftext|> b", add_special_tokens=False).ids
    docs = table(spark, D, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.encode_column(docs, "doc_id", "text").collect():
        assert r.ids == (other.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


# leaks


def _item(rng, n):
    return [f"{rng.choice('bdfgkl')}{rng.choice('aeiou')}{rng.randint(10, 9999)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(8)
    item, other = _item(rng, 60), _item(rng, 60)
    filler = lambda n: _item(rng, n)
    changed = item[10:40]
    changed[7], changed[20] = "anders", "noch"
    spoilt = item[:]
    for i in range(0, 60, 5):
        spoilt[i] = "weg"
    docs = [
        (1, " ".join(filler(40) + item[5:30] + filler(40))), (2, " ".join(filler(10) + item[5:29] + filler(9))), (3, " ".join(changed)), (4, " ".join(spoilt)),
        (5, "<p>" + "&nbsp;".join(w.upper() for w in item[20:50]) + "</p>"), (6, "\n> ".join(f"*{w}*," for w in item[30:])), (7, None), (8, ""), (9, " ".join(filler(3000) + other + filler(3000))),
        (10, " ".join(w[:2] + "​" + w[2:3] + "-\n" + w[3:] for w in item[:30])), (None, " ".join(item)),
    ]
    items = [(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(other)), (4, None), (5, ""), (6, "too short"), (None, "x")]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in leaks.find_leaks(d, i).collect())
    assert got == sorted([(k, doc) for doc in (1, 3, 5, 6, 10) for k in (1, 2)] + [(3, 9)])
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def _passage(item, doc):
    """Brute force: the least edits of every window of item words against any part of the document, without bands."""
    at: dict = {}
    a, b = (np.array([at.setdefault(w, len(at)) for w in ws], np.int64) for ws in (item, doc))
    n, m = len(a), len(b)
    shared = np.concatenate([[0], np.cumsum(np.isin(b, a))])
    most = (shared[leaks.PART :] - shared[: -leaks.PART]).max() if m > leaks.PART else shared[-1]
    if n < leaks.PASSAGE or most < leaks.PASSAGE - leaks.EDITS:
        return False
    never, ramp = np.int32(n + m), np.arange(m + 1, dtype=np.int32)
    cost = np.full((n - leaks.PASSAGE + 1, m + 1), never)
    cost[:, 1:][b[None, :] == a[: len(cost), None]] = 0
    cost = np.minimum.accumulate(cost - ramp, axis=1) + ramp
    for k in range(2, min(n, leaks.LONGEST) + 1):
        cost = cost[: n - k + 1]
        same = b[None, :] == a[k - 1 : k - 1 + len(cost), None]
        if k >= leaks.PASSAGE and leaks.PER_EDIT * int(np.where(same, cost[:, :-1], never).min()) <= k:
            return True
        row = cost + 1
        row[:, 1:] = np.minimum(row[:, 1:], cost[:, :-1] + ~same)
        cost = np.minimum.accumulate(row - ramp, axis=1) + ramp
    return False


def _found(spark, items, docs):
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    return {(r.item_id, r.doc_id) for r in leaks.find_leaks(d, i).collect()}


def test_leaks_against_alignment_of_all(spark):
    docs = {k: reader_words(t) for k, t in duckdb.sql(f"select doc_id, text from '{D}/documents.parquet' where length(text) > 0").fetchall()}
    items = {k: reader_words(t) for k, t in duckdb.sql(f"select item_id, text from '{D}/benchmark.parquet' where length(text) > 0").fetchall()}
    got = {(r.item_id, r.doc_id) for r in leaks.find_leaks(table(spark, D, "documents"), table(spark, D, "benchmark")).collect()}
    assert got == {(k, d) for d, words in docs.items() for k, item in items.items() if _passage(item, words)} and got


def test_leak_edited_near_an_end(spark):
    rng = random.Random(9)
    item, filler = _item(rng, 60), _item(rng, 40)
    docs = []
    for length, at in [(25, 1), (25, 23), (26, 1), (26, 24), (30, 28), (59, 1)]:
        copied = item[:length] if length > 48 else item[11 : 11 + length]
        copied[at] = "anders"
        docs.append(filler[:20] + copied + filler[20:])
    docs.append(filler[:20] + item[11:35] + filler[20:])
    docs.append(filler[:20] + [w if i % 7 else "weg" for i, w in enumerate(item)] + filler[20:])
    assert _found(spark, [item], docs) == {(0, d) for d in range(6)}


def test_leaks_with_added_words_of_any_length_and_script(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 50)
    rng = random.Random(10)
    stock = _item(rng, 20)  # an instruction that many items begin with
    added = lambda: rng.choice(["y", "щ", "é", "ñ", "9"]) * rng.randint(1, 200)
    items, docs = [], []
    for k in range(200):
        item = (stock if k % 3 == 0 else []) + _item(rng, rng.choice((30, 60, 130, 400)))
        x = rng.randrange(max(1, len(item) - 60))
        copied = item[x : x + rng.randrange(23, 70)]
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(copied))
            copied[at : at + rng.randrange(2)] = [added()] * rng.randrange(2)
        items.append(item)
        docs.append(_item(rng, rng.randrange(130)) + copied + _item(rng, rng.randrange(130)) + stock)
    got = _found(spark, items, docs)
    assert got == {(k, d) for d in range(200) for k in range(200) if (k == d or len(set(items[k]) & set(docs[d])) > 20) and _passage(items[k], docs[d])}
    assert 60 < len(got) < 195


def test_leaks_of_long_and_repeated_texts(spark):
    rng = random.Random(12)
    book = _item(rng, 20_000)
    same = ["ab"] * 20_000
    docs = [_item(rng, 50) + book[15_000:15_030] + _item(rng, 50), ["ab"] * 30_000, ["ab"] * 20, book, *[book[100:140] + ["end"]] * 30]
    assert _found(spark, [book, same, book], docs) == {(k, d) for k in (0, 2) for d in (0, 3, *range(4, 34))} | {(1, 1)}


# residue


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ name }}, hello", "By %(title)s", "# [[author]]", "Posted by <%= name %> on <<DATE>>", "a ${run_id} b", "Hello [First Name],", "x [INSERT DATE] y", "see &body; below", "By XXXXX",
        "Author: \nAbstract: ____\nDate: ?", "404 Not Found", "<html><h1>Access denied - Please try again later.</h1></html>", "Text.\n\nPage not found\nRequest id: 3ab347a90089\n\nMore text.",
        "Please enable JavaScript to view this page.", "请启用 JavaScript 后再浏览本页。", "Real text.\n\nText to follow. Text to follow.", "Lorem ipsum dolor sit amet, vindo ultra morum tibur.", "TODO add description", "HTTP 410\nIncident 17305895",
    ],
)
def test_residue_found(text):
    page = residue.unquoted(residue.shown(text))
    assert residue.has_slot(page) or any(residue.classify(m) for m in residue.messages(page))


@pytest.mark.parametrize(
    "text",
    [
        "The template engine replaces `{{ date }}` before the text is split.", 'We dropped lines that only said "404 Not Found", since they repeat.', "Der Platzhalter „{name}“ gilt als ein Zeichen.", "```\nprint(f\"{score} -> {units}\")\n```",
        "In run 12 the server of the group gave error 500 twice.", 'Layout samples made of "lorem ipsum" inflate the count.', "Pages that need scripts to be turned on give a crawler almost nothing.", "Let $Z_{4} = \\sum_{e} \\exp(w_{e})$, where ${\\bf w}$ holds them.",
        "The tokens [UNK], [PAD], [SP2] and [MASK] are never split.", "The set {ab, cd} has 6 paths [see note 3] and 404 edges.", "'{0}' stands for a missing prefix.", "Page 404 of the grammar lists 9 stems, and page 500 was not found until spring.",
        "Thanks, reloading the paradigm helped. 404.", "---------------", "Note: it works.\n\n- a: b", "Tom &amp; Jerry &nbsp; <b>x</b>",
    ],
)
def test_no_residue(text):
    page = residue.unquoted(residue.shown(text))
    assert not residue.has_slot(page) and not any(residue.classify(m, 100, 100) for m in residue.messages(page))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("JavaScript must be enabled to view this content", "notice"), ("Please switch on JavaScript", "notice"), ("Scripts have been disabled", "notice"), ("Connection refused by origin", "error"),
        ("Vivamus sagittis lacus vel augue laoreet", "filler"), ("Site under construction", "filler"), ("HTTP 503", "error"), ("Sorry, this page could not be loaded: connection timed out", "error"),
        ("asdf jkl asdf jkl", "filler"), ("Zugriff auf den Server verweigert", "error"), ("Le serveur est momentanément indisponible", "error"), ("网站维护中，请稍后再试", "error"), ("[placeholder]", "filler"), ("Description to be added", "filler"),
    ],
)
def test_residue_in_words_of_no_list(text, kind):
    assert kind in {residue.classify(m) for m in residue.messages(residue.unquoted(residue.shown(text)))}


def test_templates_are_mined(spark):
    rows = [(i, f"s{i % 3}", f"sorry {n} we keep your session here") for i, n in enumerate(["anna", "ben", "carl", "dora"])]
    rows += [(i, f"s{i % 3}", f"your session on host {n} was closed by us") for i, n in enumerate(["anna", "ben", "carl", "dora", "emil"], 10)]
    rows += [(20, "s1", "your session on host anna was closed by me"), (21, "s1", "one two three four"), (21, "s2", "one two three four five")]
    got = {r.template: (r.general, r.documents, r.sources) for r in residue.mined(spark.createDataFrame(rows, "doc int, source string, template string")).collect()}
    assert got["your session on host ben was closed by us"] == ("your session on host <*> was closed by us", 5, 3)
    assert got["your session on host anna was closed by me"][0].endswith("by me") and got["one two three four"] == ("one two three four", 1, 1)
    assert got["sorry ben we keep your session here"] == ("sorry ben we keep your session here", 1, 1)  # the names stand in the tree's path


def test_support_settles_what_words_leave_open(spark):
    message = "Our team has been told about this."
    docs = lambda n: spark.createDataFrame([(i, f"s{i % 2}", f"Real text {i}.\n{message}") for i in range(n)], "doc_id int, source string, text string")
    assert residue.find_residue(docs(residue.SUPPORT - 1)).count() == 0 and residue.find_residue(docs(residue.SUPPORT)).count() == residue.SUPPORT
    assert residue.find_residue(docs(residue.SUPPORT).withColumn("source", F.lit("s1"))).count() == 0
    assert residue.find_residue(docs(residue.SUPPORT).drop("source")).count() == residue.SUPPORT


def test_filler_of_the_whole_passage():
    for text in ("Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco.", "Excepteur sint occaecat cupidatat non proident."):
        assert "filler" in {residue.classify(m) for m in residue.messages(text)}
    assert residue.classify("in id est et non sed") is None and residue.classify("quis custodiet ipsos custodes") is None


def test_residue_table(spark):
    rows = [(1, "Hello {{ name }}"), (2, None), (3, ""), (4, " \n"), (5, "fine"), (6, "Page not found"), (6, "Page not found"), (7, "word " * 200_000 + "\nPage not found"), (None, "Page not found")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kind string")
    assert sorted(map(tuple, residue.find_residue(df).collect())) == [(1, "slot"), (6, "error"), (7, "error")]
    assert sorted((r.doc_id or 0) for r in residue.without_residue(df).collect()) == [0, 2, 3, 4, 5]
    assert residue.find_residue(df.limit(0)).count() == 0


# queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in set(regex.findall(r"\b(run_log|sentences|skipgram_index|encoded|caches|documents)\b", SQL[name])):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    r = con.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(map(tuple, QUERIES[name](spark, D).select(*names).collect())) == sorted(r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, D)
    assert df.columns and df.count() == df.distinct().count()
