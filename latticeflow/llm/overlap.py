"""Records of evaluation splits that are, exactly or almost, in the training split: winnowing fingerprints.

Exact copies are met by a key of all their letters. For the rest, the rolling hashes of every three words are winnowed: the
least hash of each window is a fingerprint. Two texts within the edit budget share a run of words whose length is known from
their own length; the window is chosen so that such a run holds a common fingerprint, hence no pair is missed.
Fingerprints are joined across splits. For each pair of texts that share one, the seeds are chained and extended over the gaps between
them, which bounds the edits from above; only where this bound leaves it open is the pair aligned, in a band of the bound's width.
All this runs on distinct texts; the records that hold them come back at the end.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.joins import grid_join
from latticeflow.operators.packed import parse_packed
from latticeflow.operators.records import first_delivery
from latticeflow.session import cut

#: Words of a fingerprint; least words of a text that may match almost; words of the longer text to one edit.
GRAM, LEAST, PER_EDIT = 3, 8, 8
_SLOT = regex.compile(r"\[SP[123]\]")
_SPLITS = {"train": "train", "dev": "eval", "test": "eval"}


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).casefold())


def plain_words(text: str) -> list[str]:
    """Words without case, punctuation and slot marks; a word is what stands between blanks."""
    folded = (regex.sub(r"[^\p{L}\p{N}\p{M}]", "", w) for w in fold(regex.sub(_SLOT, " ", text)).split())
    return [w for w in folded if w]


def spelt_words(values: list[str]) -> list[str]:
    """The words that the values of a segmentation spell: three slots a word, missing slots left out."""
    words = ("".join(regex.sub(r"[^\p{L}\p{N}\p{M}]", "", fold(v)) for v in values[i : i + 3] if not _SLOT.fullmatch(v)) for i in range(0, len(values), 3))
    return [w for w in words if w]


def budget(n: int) -> int:
    """Edits allowed if the longer text has n words."""
    return n // PER_EDIT


def shared_run(n: int) -> int:
    """Words of the longest run that a text of n words surely shares with any text within the budget.

    e edits leave at least n - e words of it in at most e + 1 runs; two words that change places leave n - 2 in two runs.
    The other text may be longer and allow one edit more than n // PER_EDIT.
    """
    edits = [e for e in range(1, budget(n) + 2) if n + e >= PER_EDIT * e]
    return max(GRAM, min([-((n - 2) // -2), *(-((n - e) // -(e + 1)) for e in edits)]))


def fingerprints(words: list[str]) -> list[tuple[int, int]]:
    """(hash, position) of the winnowed word triples; ties take the last position."""
    n = len(words)
    if n < GRAM:
        return []
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n - GRAM + 1, np.uint64)
        for i in range(GRAM):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
        g ^= g >> np.uint64(29)
    w = min(shared_run(n) - GRAM + 1, len(g))
    views = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    at = np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))
    return [(int(x), int(i)) for x, i in zip(g[at].astype(np.int64), at)]


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain of seeds (i, j), both rising; for m seeds in m log m steps."""
    ends: list[int] = []  # the least j that ends a chain of each length
    last: list[int] = []  # the seed that does
    before: list[int] = []
    # of equal i the greater j comes first, so that no chain takes two of them
    ordered = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    for k, (_, j) in enumerate(ordered):
        n = bisect_left(ends, j)
        before.append(last[n - 1] if n else -1)
        ends[n : n + 1], last[n : n + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(ordered[k])
        k = before[k]
    return out[::-1]


def near_seeds(a: list[str], b: list[str], most: int) -> list[tuple[int, int]]:
    """Places of common fingerprints that lie no more than `most` words apart."""
    at: dict[int, list[int]] = {}
    for h, j in fingerprints(b):
        at.setdefault(h, []).append(j)
    return [(i, js[k]) for h, i in fingerprints(a) if (js := sorted(at.get(h, ()))) for k in range(bisect_left(js, i - most), bisect_left(js, i + most + 1))]


def extended(a: list[str], b: list[str], seeds: list[tuple[int, int]], most: int) -> int | None:
    """Edits of the alignment that holds to the chain of seeds, if they are at most `most`: an upper bound."""
    i = j = edits = 0
    for x, y in [*chain(seeds), (len(a), len(b))]:
        if x < i or y < j:  # it overlaps the seed before
            if x - i != y - j:
                continue
        else:
            d = banded(a[i:x], b[j:y], most - edits)
            if d is None:
                return None
            edits += d
        i, j = min(x + GRAM, len(a)), min(y + GRAM, len(b))
    return edits if i == len(a) and j == len(b) else None


def banded(a: list[str], b: list[str], most: int) -> int | None:
    """Edits of words between a and b, if they are at most `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    big = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[j] = i
                continue
            d = row.get(j - 1, big) + (a[i - 1] != b[j - 1])
            new[j] = min(d, row.get(j, big) + 1, new.get(j - 1, big) + 1)
        row = new
        if min(row.values()) > most:
            return None
    d = row.get(len(b), big)
    return d if d <= most else None


def aligned(a: list[str], b: list[str]) -> int | None:
    """Edits between two different texts within the budget (a change of places of two neighbours counts 1), or None.

    The seeds' chain, extended over its gaps, gives an upper bound. If that is the least there can be it is the answer; else the texts
    without their common ends are aligned in a band of the bound's width.
    """
    if min(len(a), len(b)) < LEAST:
        return None
    most = budget(max(len(a), len(b)))
    if abs(len(a) - len(b)) > most or not (seeds := near_seeds(a, b, most)):
        return None
    bound = extended(a, b, seeds, most)
    if bound is not None and bound <= max(1, abs(len(a) - len(b))):
        return bound
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    k = 0
    while k < min(len(a), len(b)) - i and a[-1 - k] == b[-1 - k]:
        k += 1
    x, y = a[i : len(a) - k], b[i : len(b) - k]
    if len(x) == len(y) == 2 and x[0] == y[1] and x[1] == y[0]:
        return 1
    return banded(x, y, most if bound is None else bound)


def words_of(records: DataFrame) -> DataFrame:
    """(id, part, split, source, words, key) of all records: part is train, eval or null, words those of text, or of segmentation if text is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [plain_words(t) if t is not None else spelt_words(list(s)) for t, s in zip(b["text"], b["segmentation"])]
            split = [s.strip().lower() if s is not None else None for s in b["split"]]
            yield pd.DataFrame({"id": b["id"], "part": [_SPLITS.get(s) for s in split], "split": split, "source": b["source"], "words": words}).astype({"part": object, "split": object, "source": object})

    out = parse_packed(records.select("id", "split", "source", "text", "segmentation"), ["segmentation"]).drop("segmentation_dialect").mapInPandas(run, "id long, part string, split string, source string, words array<string>")
    return out.withColumn("key", F.md5(F.concat_ws("", "words")))


def _seeds(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(fp, k, p, pos, len(w)) for k, p, w in zip(b["key"], b["part"], b["words"]) for fp, pos in fingerprints(list(w))]
            yield pd.DataFrame(rows, columns=["fp", "key", "part", "pos", "n"]).astype({"fp": "int64", "pos": "int32", "n": "int32", "key": object, "part": object})

    return texts.where(F.size("words") >= LEAST).select("key", "part", "words").mapInPandas(run, "fp long, key string, part string, pos int, n int")


def near_texts(texts: DataFrame) -> DataFrame:
    """(key_e, key_t, edits, coverage): pairs of different texts of the two parts within the edit budget."""
    seeds = cut(_seeds(texts))
    side = lambda part, s: seeds.where(F.col("part") == part).select("fp", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "pos", "n")])
    most = F.floor(F.greatest("n_t", "n_e") / PER_EDIT)
    met = grid_join(side("train", "t"), side("eval", "e"), "fp").where((F.abs(F.col("n_t") - F.col("n_e")) <= most) & (F.abs(F.col("pos_t") - F.col("pos_e")) <= most) & (F.col("key_t") != F.col("key_e")))
    pairs = met.select("key_e", "key_t").distinct()
    we = texts.where("part = 'eval'").select(F.col("key").alias("key_e"), F.col("words").alias("words_e"))
    wt = texts.where("part = 'train'").select(F.col("key").alias("key_t"), F.col("words").alias("words_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ke, kt, a, w in zip(b["key_e"], b["key_t"], b["words_e"], b["words_t"]):
                d = aligned(list(a), list(w))
                if d is not None:
                    rows.append((ke, kt, d, 1 - d / max(len(a), len(w))))
            yield pd.DataFrame(rows, columns=["key_e", "key_t", "edits", "coverage"]).astype({"edits": "int32", "coverage": "float64", "key_e": object, "key_t": object})

    return pairs.join(we, "key_e").join(wt, "key_t").mapInPandas(run, "key_e string, key_t string, edits int, coverage double")


def cross_split_overlaps(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key_e, key_t, edits, coverage), records): overlapping texts of the two parts, and the records (id, part, split, source, key) of all texts.

    Records without words (null, blank or punctuation only) match nothing; a null or unknown split is no split.
    Equal texts have edits 0. Repeated rows are one record, that of the first delivery.
    """
    records = cut(words_of(first_delivery(table, "id", "added_at", ["split", "source", "text", "segmentation"])).where("part is not null and size(words) > 0"))
    # the words of a key are equal up to where they are parted; the least stands for all
    texts = cut(records.groupBy("key", "part").agg(F.min("words").alias("words")))
    same = texts.groupBy("key").agg(F.count("*").alias("parts")).where("parts = 2")
    exact = same.select(F.col("key").alias("key_e"), F.col("key").alias("key_t"), F.lit(0).alias("edits"), F.lit(1.0).alias("coverage"))
    return exact.unionByName(near_texts(texts)), records.drop("words")


def overlap_pairs(table: DataFrame) -> DataFrame:
    """(id_e, id_t, split, source, edits, coverage): every eval record with each train record whose text it repeats, exactly or almost.

    All pairs of records are written out; `overlap_links` gives the same links by classes of equal texts.
    """
    found, records = cross_split_overlaps(table)
    e = records.where("part = 'eval'").select(F.col("key").alias("key_e"), F.col("id").alias("id_e"), "split", "source")
    t = records.where("part = 'train'").select(F.col("key").alias("key_t"), F.col("id").alias("id_t"))
    return found.join(e, "key_e").join(t, "key_t").select("id_e", "id_t", "split", "source", "edits", "coverage")


def overlap_links(table: DataFrame) -> DataFrame:
    """(id, split, source, class, links, edits, coverage): one row per record with words.

    `class` is equal for equal words; `links` counts the records of the other part that hold the same words or almost. `edits` and `coverage`
    (share of the longer text's words that stay) are those of the closest of them, null without any. Copies are counted, not paired.
    """
    found, records = cross_split_overlaps(table)
    found = cut(found)
    held = records.groupBy("key", "part").agg(F.count("*").alias("n"))
    both = found.select(F.col("key_e").alias("key"), F.lit("eval").alias("part"), F.col("key_t").alias("other"), "edits", "coverage").unionByName(
        found.select(F.col("key_t").alias("key"), F.lit("train").alias("part"), F.col("key_e").alias("other"), "edits", "coverage")
    )
    its = held.select(F.col("key").alias("other"), F.when(F.col("part") == "train", "eval").otherwise("train").alias("part"), "n")
    links = both.join(its, ["other", "part"]).groupBy("key", "part").agg(F.sum("n").alias("links"), F.min("edits").alias("edits"), F.max("coverage").alias("coverage"))
    return records.join(links, ["key", "part"], "left").select("id", "split", "source", F.col("key").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "edits", "coverage")


def overlap_report(table: DataFrame) -> DataFrame:
    """(split, source, records, exact, near, links, covered): per split and source, the records of dev and test, those that overlap with
    train, the train records they overlap with, and the mean share of their words that train covers."""
    e = overlap_links(table).where("split in ('dev', 'test')")
    return e.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count(F.when(F.col("edits") == 0, 1)).alias("exact"), F.count(F.when(F.col("edits") > 0, 1)).alias("near"),
        F.sum("links").alias("links"), F.round(F.avg(F.coalesce("coverage", F.lit(0.0))), 6).alias("covered"),
    )
