"""How often two items occur in the same record, and how far that exceeds chance: heavy and light items counted apart.

Heavy items (at most `HEAVY` of the most frequent) are columns of a bit matrix, block by block; their pairs are
popcounts of two columns' conjunction. Pairs of light items are counted by hash. For mixed pairs, the records of each
light item are probed for heavy ones, by adding up their rows of the matrix. The three are united and summed. Light and mixed pairs are first
counted by a 64-bit number of the pair alone; then only pairs whose number is frequent enough are counted by name, so a collision costs time but no result.
An item that fewer than `support` records hold can't be in a wanted pair; a bitmap of the others, of bounded size, lets tasks drop it.
Records stay as they are, in the tasks that read them; only counts of items and of pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.joins import bitmap, in_bitmap
from latticeflow.operators.records import first_delivery
from latticeflow.session import cut

#: Most heavy items; the least share of records that makes an item heavy; records of a block; light pairs held at a time.
HEAVY, SHARE, BLOCK, HELD = 512, 0.001, 4096, 1_000_000
#: Light items of a record whose pairs are numbered at once.
TOGETHER = 1000


def index_words(index: DataFrame) -> DataFrame:
    """(rec, words): one row per record of a skip-gram index, with its distinct words in lower case, in order.

    A record's words are those of `words`, or, where that is null, the sources and targets in the JSON `counts`. Nulls,
    empty strings and tokens in brackets are no words; null or broken JSON holds none. A record without words stays, since it
    counts as a record. Of a record delivered again the first delivery counts.
    """
    records = first_delivery(index, "index_id", "built_at", ["words", "counts"])
    nested = F.from_json("counts", "map<string,map<string,map<string,string>>>")
    sources = F.flatten(F.transform(F.map_values(nested), lambda m: F.map_keys(m)))
    targets = F.flatten(F.transform(F.map_values(nested), lambda m: F.flatten(F.transform(F.map_values(m), lambda t: F.map_keys(t)))))
    raw = F.coalesce("words", F.concat(F.coalesce(sources, F.array().cast("array<string>")), F.coalesce(targets, F.array().cast("array<string>"))))
    good = F.filter(F.transform(raw, lambda w: F.lower(w)), lambda w: w.isNotNull() & (w != "") & ~w.rlike(r"^\[.*\]$"))
    return records.select(F.col("index_id").alias("rec"), F.array_sort(F.array_distinct(F.coalesce(good, F.array().cast("array<string>")))).alias("words"))


def _popcounts(own: np.ndarray) -> np.ndarray:
    """own: records x heavy, bool. How many records hold both of each two heavy items (upper triangle)."""
    bits = np.packbits(own, axis=0)
    pad = -bits.shape[0] % 8
    cols = np.ascontiguousarray(np.pad(bits, ((0, pad), (0, 0))).T).view(np.uint64)
    out = np.zeros((len(cols), len(cols)), np.int64)
    for i in range(len(cols) - 1):
        out[i, i + 1 :] = np.bitwise_count(cols[i] & cols[i + 1 :]).sum(axis=1)
    return out


@lru_cache(maxsize=256)
def _places(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def stretches(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, number) of the pairs of a record's hashes; all at once, or those of one item at a time if they are many."""
    if len(h) <= TOGETHER:
        i, j = _places(len(h))
        yield i, j, pair_numbers(h[i], h[j])
    else:
        for i in range(len(h) - 1):
            j = np.arange(i + 1, len(h))
            yield np.full(len(j), i), j, pair_numbers(h[i], h[j])


def pair_numbers(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A 64-bit number of each pair of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        h = np.minimum(one, others) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29)) ^ np.maximum(one, others)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def pair_counts(records: DataFrame, items: str, support: int = 5) -> tuple[DataFrame, DataFrame]:
    """((word_a, word_b, n_ab), (word, n)): pairs word_a < word_b that at least `support` rows share, and each word's rows.

    `items` is an array of strings without nulls; repeated items of a row count once.
    """
    spark = records.sparkSession
    counts = cut(records.select(F.explode(F.array_distinct(items)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    total = records.count()
    rows = counts.where((F.col("n") >= support) & (F.col("n") >= SHARE * total)).orderBy(F.desc("n"), "word").limit(HEAVY).collect()  # bounded by HEAVY
    # light items have no hot key: each is in fewer rows than SHARE of all, or than each of HEAVY others
    shared = spark.sparkContext.broadcast((sorted(r.word for r in rows), *bitmap(counts.where(F.col("n") >= support).select(F.xxhash64("word").alias("h")), "h")))

    def known(batches: Iterator[pd.DataFrame], at: dict[str, int], bits: np.ndarray, width: int) -> Iterator[tuple[list[list[int]], list[list[str]], list[np.ndarray]]]:
        """For blocks of records, each one's heavy items by number, and its light items that enough records may hold, in order, with their hashes."""
        import xxhash

        hashes: dict[str, int | None] = {}
        for whole in batches:
            for k in range(0, len(whole), BLOCK):
                records_ = [set(x) if x is not None else set() for x in whole["_items"].iloc[k : k + BLOCK]]
                new = list({w for x in records_ for w in x} - at.keys() - hashes.keys())
                h = [xxhash.xxh64_intdigest(w, 42) for w in new]
                held = in_bitmap(np.array(h, np.uint64), bits, width).astype(bool).tolist()
                hashes |= {w: x if ok else None for w, x, ok in zip(new, h, held)}
                light = [sorted(w for w in x if w not in at and hashes[w] is not None) for x in records_]
                yield [[at[w] for w in x if w in at] for x in records_], light, [np.array([hashes[w] for w in ws], np.uint64) for ws in light]
                if len(hashes) > HELD:
                    hashes.clear()

    def rows_of(heavy: list[list[int]], light: list[list[str]], hashes: list[np.ndarray], k: int) -> tuple[np.ndarray, dict[str, tuple[np.uint64, list[int]]]]:
        """The block's bit matrix of heavy items, and each light item's hash and records."""
        own = np.zeros((len(heavy), k), bool)
        for r, hs in enumerate(heavy):
            own[r, hs] = True
        lists: dict[str, tuple[np.uint64, list[int]]] = {}
        for r, (ws, h) in enumerate(zip(light, hashes)):
            for w, x in zip(ws, h):
                lists.setdefault(w, (x, []))[1].append(r)
        return own, lists

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        names, bits, width = shared.value
        of_heavy = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64)
        probes: dict[np.uint64, np.ndarray] = {}
        held: list[np.ndarray] = []
        size = 0

        def out() -> pd.DataFrame:
            pair, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pd.DataFrame({"pair": pair.view(np.int64), "n": n})

        def mixed() -> pd.DataFrame:
            found = [(pair_numbers(h, of_heavy[at]), v[at]) for h, v in probes.items() if len(at := np.flatnonzero(v))]
            probes.clear()
            none = np.zeros(0, np.uint64)
            return pd.DataFrame({"pair": np.concatenate([none, *(a for a, _ in found)]).view(np.int64), "n": np.concatenate([none.astype(np.int64), *(n for _, n in found)]).astype(np.int64)})

        for heavy, light, hashes in known(batches, {w: i for i, w in enumerate(names)}, bits, width):
            for h in hashes:
                for _, _, numbers in stretches(h):
                    held.append(numbers)
                    size += len(numbers)
                    if size > HELD:
                        yield out()
                        size = 0
            if names:
                own, lists = rows_of(heavy, light, hashes, len(names))
                for h, rs in lists.values():
                    v = own[rs].sum(axis=0, dtype=np.int32)
                    probes[h] = probes[h] + v if h in probes else v
                if len(probes) > 20_000:
                    yield mixed()
        yield out()
        yield mixed()

    often = records.select(F.col(items).alias("_items")).mapInPandas(numbered, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    frequent = spark.sparkContext.broadcast(bitmap(cut(often.select("pair")), "pair"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        names, bits, width = shared.value
        k = len(names)
        of_heavy = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64)
        both = np.zeros((k, k), np.int64)
        wanted: dict[str, np.ndarray] = {}
        pairs: dict[tuple[str, str], int] = {}

        def hashed() -> pd.DataFrame:
            return pd.DataFrame({"word_a": [a for a, _ in pairs], "word_b": [b for _, b in pairs], "n": list(pairs.values())}).astype({"n": "int64", "word_a": object, "word_b": object})

        for heavy, light, hashes in known(batches, {w: i for i, w in enumerate(names)}, bits, width):
            own, lists = rows_of(heavy, light, hashes, k)
            if k:
                both += _popcounts(own)
                for w, (h, rs) in lists.items():
                    at = wanted.get(w)
                    if at is None:
                        at = wanted[w] = np.flatnonzero(in_bitmap(pair_numbers(h, of_heavy), *frequent.value))
                    if len(at):
                        v = own[np.ix_(rs, at)].sum(axis=0)
                        for i, n in zip(at.tolist(), v.tolist()):
                            if n:
                                pair = (w, names[i]) if w < names[i] else (names[i], w)
                                pairs[pair] = pairs.get(pair, 0) + n
                if len(wanted) > 100_000:
                    wanted.clear()
            for ws, h in zip(light, hashes):
                for i, j, numbers in stretches(h):
                    ok = in_bitmap(numbers, *frequent.value) > 0
                    for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                        pairs[ws[a], ws[b]] = pairs.get((ws[a], ws[b]), 0) + 1
                    if len(pairs) > HELD:
                        yield hashed()
                        pairs.clear()
        yield hashed()
        i, j = np.nonzero(both)
        yield pd.DataFrame({"word_a": [names[x] for x in i], "word_b": [names[x] for x in j], "n": both[i, j]}).astype({"word_a": object, "word_b": object})

    found = records.select(F.col(items).alias("_items")).mapInPandas(count, "word_a string, word_b string, n long").groupBy("word_a", "word_b").agg(F.sum("n").alias("n_ab"))
    return found.where(F.col("n_ab") >= support), counts


def lifted_pairs(records: DataFrame, items: str, support: int = 5, lift: float = 4.0) -> DataFrame:
    """(word_a, word_b, n_ab, n_a, n_b, records, lift): pairs with n_ab >= support and n_ab * records >= lift * n_a * n_b.

    All rows of `records` count as records, those without items too; an empty table has no pairs.
    """
    found, counts = pair_counts(records, items, support)
    total = records.count()
    a = counts.select(F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    out = found.join(a, "word_a").join(b, "word_b").withColumn("records", F.lit(total).cast("long"))
    held = F.col("n_ab").cast("double") * F.col("records") >= F.lit(float(lift)) * F.col("n_a") * F.col("n_b")
    return out.where(held).withColumn("lift", F.col("n_ab").cast("double") * F.col("records") / F.col("n_a") / F.col("n_b"))
