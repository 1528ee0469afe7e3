"""Morphological derivation, and alignment of underlying with surface forms; per row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = frozenset("aeiou")


class Derivator:
    """Strips affixes from words down to a known stem.

    A word is read from both ends: a suffix is taken off (the longest first), then a prefix, as long as something known remains.
    What is left is repaired by spelling: a dropped e comes back, a doubled consonant is single, i becomes y, abil able, ise ize, and before ation
    or ate ific becomes ify.
    A prefix im, il or ir counts as in.
    """

    def __init__(self, prefixes: Iterable[str], suffixes: Iterable[str], stems: Iterable[str]):
        clean = lambda xs: {x.strip().lower() for x in xs if x and x.strip()}
        self.prefixes, self.suffixes, self.stems = clean(prefixes), clean(suffixes), clean(stems)
        self._longest = [max(map(len, xs), default=0) for xs in (self.prefixes | {"im"}, self.suffixes)]
        self._find = lru_cache(100_000)(self._search)

    def repairs(self, form: str, suffix: str) -> list[str]:
        """Spellings of the stem that a form may stand for from which that suffix was taken, the likeliest first; only the form itself without a suffix."""
        if not suffix:
            return [form]
        out = [form]
        if len(form) > 2 and form[-1] == form[-2] and form[-1] not in VOWELS:
            out.append(form[:-1])
        if form and form[-1] not in VOWELS:
            out.append(form + "e")
        if form.endswith("i"):
            out.append(form[:-1] + "y")
        for end, full in (("ific", "ify"), ("abil", "able"), ("ise", "ize")):
            if form.endswith(end) and (end != "ific" or suffix in ("ation", "ate")):
                out.append(form[: -len(end)] + full)
        return out

    def _search(self, form: str, stripped: str) -> tuple[tuple[str, ...], str, tuple[str, ...]] | None:
        for stem in self.repairs(form, stripped):
            if stem in self.stems:
                return (), stem, ()
        for spelt in self.repairs(form, stripped):
            for n in range(min(len(spelt) - 1, self._longest[1]), 0, -1):
                if spelt[-n:] in self.suffixes and (found := self._find(spelt[:-n], spelt[-n:])):
                    return found[0], found[1], (*found[2], spelt[-n:])
        for n in range(min(len(form) - 1, self._longest[0]), 0, -1):
            prefix = form[:n]
            name = "in" if prefix in ("im", "il", "ir") and prefix not in self.prefixes else prefix
            if name in self.prefixes and (found := self._find(form[n:], stripped)):
                return (name, *found[0]), found[1], found[2]
        return None

    def readings(self, word: str) -> list[tuple[tuple[str, ...], str, tuple[str, ...]]]:
        """(prefixes, stem, suffixes) of the word for every stem that the search would try, in its order; the first known stem is the search's result."""
        out, tried, seen = [], set(), set()

        def walk(form: str, stripped: str, pre: tuple[str, ...], suf: tuple[str, ...]) -> None:
            if (form, stripped) in seen:  # found before, with the same stems
                return
            seen.add((form, stripped))
            spellings = self.repairs(form, stripped)
            for stem in spellings:
                if stem not in tried:
                    tried.add(stem)
                    out.append((pre, stem, suf))
            for spelt in spellings:
                for n in range(min(len(spelt) - 1, self._longest[1]), 0, -1):
                    if spelt[-n:] in self.suffixes:
                        walk(spelt[:-n], spelt[-n:], pre, (spelt[-n:], *suf))
            for n in range(min(len(form) - 1, self._longest[0]), 0, -1):
                prefix = form[:n]
                name = "in" if prefix in ("im", "il", "ir") and prefix not in self.prefixes else prefix
                if name in self.prefixes:
                    walk(form[n:], stripped, (*pre, name), suf)

        walk(word.lower(), "", (), ())
        return out

    def derive(self, word: str | None, mode: str = "morphemes"):
        """roots: the stem; bundles: [prefixes joined, stem, suffixes joined]; morphemes: all of them in order.

        A word without a known stem is its own root; null gives null.
        """
        if word is None:
            return None
        pre, stem, suf = self._find(word.lower(), "") or ((), word.lower(), ())
        if mode == "roots":
            return stem
        if mode == "bundles":
            return ["".join(pre), stem, "".join(suf)]
        return [*pre, stem, *suf]

    def categories(self, word: str | None) -> list[str] | None:
        if word is None:
            return None
        pre, _, suf = self._find(word.lower(), "") or ((), word, ())
        return ["prefix"] * len(pre) + ["stem"] + ["suffix"] * len(suf)


def derive_column(word: Column, derivator: Derivator, mode: str = "morphemes") -> Column:
    lists = (derivator.prefixes, derivator.suffixes, derivator.stems)
    kind = "string" if mode == "roots" else "array<string>"

    @F.pandas_udf(kind)
    def run(words: pd.Series) -> pd.Series:
        d = Derivator(*lists)
        return pd.Series([d.derive(w, mode) for w in words])

    return run(word)


def derive_by_join(words: DataFrame, stems: DataFrame, prefixes: Iterable[str], suffixes: Iterable[str], word: str = "word") -> DataFrame:
    """(word, pieces): the morphemes of each distinct word, as `derive` finds them, the stems (one column) being a table of any size.

    Every stem that a word may have is joined with the known ones; the first in the order of the search counts. A word without a
    known stem is its own root.
    """
    lists = (list(prefixes), list(suffixes))

    @F.pandas_udf("array<struct<stem string, pieces array<string>>>")
    def readings(batch: pd.Series) -> pd.Series:
        d = Derivator(*lists, ())
        return pd.Series([[{"stem": stem, "pieces": [*pre, stem, *suf]} for pre, stem, suf in d.readings(w)] for w in batch])

    distinct = words.where(F.col(word).isNotNull()).select(word).distinct()
    known = stems.select(F.lower(F.trim(F.col(stems.columns[0]))).alias("_stem")).where("_stem <> ''").distinct()
    each = distinct.select(word, F.posexplode(readings(F.col(word))).alias("_rank", "_x")).select(word, "_rank", F.col("_x.stem").alias("_stem"), F.col("_x.pieces").alias("_pieces"))
    found = each.join(known.withColumn("_known", F.lit(True)), "_stem", "left")
    # the unsplit word is the first reading of all, so that every word has a row
    best = F.coalesce(F.min(F.when(F.col("_known"), F.struct("_rank", "_pieces")))["_pieces"], F.array(F.lower(word)))
    return found.groupBy(word).agg(best.alias("pieces"))


def fences(surface: str, pieces: list[str]) -> list[list[int]]:
    """All ways to cut the surface so that the pieces' letters align with it at the least edit cost; each is a list of end offsets.

    A cut falls between two letters of the surface; letters that the surface adds between pieces may go to either side.
    """
    deep = "".join(pieces)
    ends = set()
    at = 0
    for p in pieces[:-1]:
        at += len(p)
        ends.add(at)
    n, m = len(surface), len(deep)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            options = []
            if i < n and j < m:
                options.append(cost[i + 1][j + 1] + (surface[i] != deep[j]))
            if i < n:
                options.append(cost[i + 1][j] + 1)
            if j < m:
                options.append(cost[i][j + 1] + 1)
            cost[i][j] = min(options, default=0)
    found: set[tuple[int, ...]] = set()
    order = sorted(ends)
    todo = {(0, 0, 0, ())}
    seen = set(todo)
    while todo:
        i, j, k, cuts = todo.pop()
        nexts = []
        if k < len(order) and j == order[k]:
            nexts.append((i, j, k + 1, (*cuts, i)))
        if i == n and j == m:
            if k == len(order):
                found.add((*cuts, n))
        held = k < len(order) and j == order[k]
        if i < n and j < m and not held and cost[i][j] == cost[i + 1][j + 1] + (surface[i] != deep[j]):
            nexts.append((i + 1, j + 1, k, cuts))
        if i < n and cost[i][j] == cost[i + 1][j] + 1:
            nexts.append((i + 1, j, k, cuts))
        if j < m and not held and cost[i][j] == cost[i][j + 1] + 1:
            nexts.append((i, j + 1, k, cuts))
        for x in nexts:
            if x not in seen:
                seen.add(x)
                todo.add(x)
    return [list(x) for x in sorted(found)]


def fence_column(surface: Column, pieces: Column) -> Column:
    """Fences of each row; null where the surface or the pieces are null or there are no pieces."""

    @F.pandas_udf("array<array<int>>")
    def run(surfaces: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([fences(s, list(p)) if s is not None and p is not None and len(p) else None for s, p in zip(surfaces, lists)])

    return run(surface, pieces)


def alternates(pieces: Column) -> Column:
    """Pieces of a surface form after its hyphens are taken as boundaries."""
    return F.filter(F.flatten(F.transform(pieces, lambda p: F.split(p, "-"))), lambda p: p != "")


def linked(dictionary: DataFrame, word: str = "word", segs: str = "pieces") -> DataFrame:
    """(word, pieces): segmentations followed until no piece is segmented further.

    A piece that has been followed already on the way to itself stays, so a word that segments into itself, or into others that lead back
    to it, ends there. An iterated join on distinct words, as many rounds as the longest way; each round is cut.
    """
    from latticeflow.session import cut

    known = dictionary.select(F.col(word).alias("_p"), F.col(segs).alias("_sub")).where((F.size("_sub") > 1) & (F.col("_p") != "")).dropDuplicates(["_p"])
    # each piece with the words that were followed to reach it
    now = cut(dictionary.select(word, F.transform(segs, lambda p: F.struct(p.alias("p"), F.array(word).alias("way"))).alias("_x")))
    while True:
        each = now.select(word, F.posexplode("_x").alias("_i", "_y")).select(word, "_i", F.col("_y.p").alias("_p"), F.col("_y.way").alias("_way")).join(known, "_p", "left")
        goes_on = F.col("_sub").isNotNull() & ~F.array_contains("_way", F.col("_p"))
        if each.where(goes_on).isEmpty():
            return now.select(word, F.transform("_x", lambda x: x["p"]).alias(segs))
        way = F.concat("_way", F.array("_p"))
        part = F.when(goes_on, F.transform("_sub", lambda p: F.struct(p.alias("p"), way.alias("way")))).otherwise(F.array(F.struct(F.col("_p").alias("p"), F.col("_way").alias("way"))))
        packed = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), part.alias("x"))))
        now = cut(each.groupBy(word).agg(F.flatten(F.transform(packed, lambda s: s["x"])).alias("_x")))
