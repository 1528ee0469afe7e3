"""Passages of held-out items in a corpus: shared q-grams counted in overlapping blocks and diagonal bands, then banded alignment.

The symbols of the q-grams are words, each a 64-bit code, not letters: an added word shifts the diagonal by one however long it
is, so bands of a fixed width hold every passage. By the q-gram lemma a passage of n words with e edits shares at least
n - Q + 1 - Q * e of its q-grams with the document; `NEED` is the least of these bounds over all passages to look for.

Documents are read once. A bitmap of the items' q-grams, of bounded size, is all that is sent to the tasks; only blocks of words that hold
`NEED` of them leave the scan. Their q-grams are joined with those of the items' blocks, and counted per pair of blocks; pairs that
reach the bound are counted again by diagonal bands, and bands that reach it are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.joins import bitmap, grid_join, in_bitmap
from latticeflow.llm.plaintext import reader_words
from latticeflow.session import cut

#: Words of a passage, and words to one edit.
PASSAGE, PER_EDIT = 25, 10
#: Words of the longest passage to look for: from one more on, two unaltered words in its middle part it into two, one of which is within the budget.
LONGEST = next(n for n in range(2 * PASSAGE, 9 * PASSAGE) if n + 1 - 2 * (PASSAGE - 1) - (n + 1) // PER_EDIT >= 2)
#: Edits of the longest passage; words of the longest part of a document that is one.
EDITS = LONGEST // PER_EDIT
PART = LONGEST + EDITS
#: Words of a q-gram, and shared q-grams that every passage has.
Q = 5
NEED = min(n - Q + 1 - Q * (n // PER_EDIT) for n in range(PASSAGE, LONGEST + 1))
#: Blocks overlap by half: those of items have twice LONGEST words, those of documents twice PART; so each passage is whole in one of each.
#: Diagonals of a band, which overlap by half too.
BAND = 2 * (EDITS + 1)
assert NEED > 0


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram of an array of word codes."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = (h ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Coder:
    """Codes of words; those met before are remembered, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = xxhash.xxh64_intdigest(w)
            out.append(c)
        return np.array(out, np.uint64)


def blocks(n: int, half: int) -> list[tuple[int, int]]:
    """(number, start) of blocks of two halves that cover n words; a last block of one half only is part of the one before."""
    return [(k, k * half) for k in range(max(1, -(-n // half) - 1))]


def counted(g: np.ndarray) -> list[tuple[int, int]]:
    """(q-gram, how often), as signed numbers."""
    values, n = np.unique(g, return_counts=True)
    return list(zip(values.astype(np.int64).tolist(), n.tolist()))


def _items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, whole, no, codes, grams) of the blocks of all items of PASSAGE words or more; `whole` is equal for equal words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        coder = Coder()
        for b in batches:
            rows = []
            for i, t in zip(b["_item"], b["_text"]):
                codes = coder(reader_words(t)) if t else np.zeros(0, np.uint64)
                if len(codes) >= PASSAGE:
                    whole = xxhash.xxh3_128_digest(codes.tobytes())
                    for no, at in blocks(len(codes), LONGEST):
                        part = codes[at : at + 2 * LONGEST]
                        rows.append((i, whole, no, part.astype(np.int64).tolist(), counted(grams(part))))
            yield pd.DataFrame(rows, columns=["_item", "whole", "no", "codes", "grams"]).astype({"no": "int32", "whole": object})

    kind = dict(items.dtypes)[key]
    return items.where(F.col(key).isNotNull()).select(F.col(key).alias("_item"), F.col(text).alias("_text")).mapInPandas(
        run, f"_item {kind}, whole binary, no int, codes array<bigint>, grams array<struct<gram:bigint,n:int>>"
    )


def likely_blocks(docs: list[list[str]], coder: Coder, bits: np.ndarray, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(document's place, codes, q-grams in the bitmap) of the documents' blocks in whose first half a window with NEED or more of them begins."""
    sizes = [len(w) for w in docs]
    flat = coder([w for words in docs for w in words])
    h = grams(flat)
    hit = in_bitmap(h, bits, width)
    sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    out, start = [], 0
    for d, n in enumerate(sizes):
        last = start + n - Q + 1  # q-grams from here on reach into the next document
        if n >= PASSAGE - EDITS and sums[last] - sums[start] >= NEED:
            # a passage that begins at some word has all its q-grams in the window of PART words from there
            ends = np.minimum(np.arange(start, last) + PART - Q + 1, last)
            begins = np.flatnonzero(sums[ends] - sums[start:last] >= NEED)
            for no in np.unique(np.minimum(begins // PART, len(blocks(n, PART)) - 1)).tolist():
                a = start + no * PART
                own = np.arange(a, min(a + 2 * PART - Q + 1, last))
                out.append((d, flat[a : min(start + n, a + 2 * PART)], h[own[hit[own] > 0]]))
        start += n
    return out


def _doc_blocks(docs: DataFrame, key: str, text: str, bits: np.ndarray, width: int) -> DataFrame:
    """(doc, block, codes, grams); `block` is equal for equal words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        coder = Coder()
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                ids = list(part["_doc"])
                rows = [
                    (ids[d], xxhash.xxh3_128_digest(codes.tobytes()), codes.astype(np.int64).tolist(), counted(g))
                    for d, codes, g in likely_blocks([reader_words(t) if t else [] for t in part["_text"]], coder, shared.value, width)
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["_doc", "block", "codes", "grams"])

    kind = dict(docs.dtypes)[key]
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("_text")).mapInPandas(
        run, f"_doc {kind}, block binary, codes array<bigint>, grams array<struct<gram:bigint,n:int>>"
    )


def bands(a: np.ndarray, b: np.ndarray) -> list[int]:
    """First diagonals (document's place less item's) of the bands that hold NEED or more shared q-grams, the fullest first."""
    i, j = np.nonzero(grams(a)[:, None] == grams(b)[None, :])
    if len(i) < NEED:
        return []
    half = BAND // 2
    at = (j - i) // half  # the band before holds it too
    low = int(at.min()) - 1
    n = np.bincount(at - low)
    both = n[:-1] + n[1:]  # band k: diagonals of k and k + 1
    return [(int(k) + low) * half for k in np.argsort(-both, kind="stable") if both[k] >= NEED]


def aligned(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """For each (item's block, document's block, first diagonal of a band) whether the band holds a passage within the budget.

    The least edits of every window of item words along every diagonal, EDITS of which are added on either side of the band. The
    first and the last word of a passage are unaltered, since a copy that ends before an altered word is only a shorter copy.
    """
    size, wide, width = 2 * LONGEST, 2 * PART, BAND + 2 * EDITS
    a, b = np.zeros((len(pairs), size), np.uint64), np.zeros((len(pairs), wide), np.uint64)
    has_a, has_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for p, (x, y, _) in enumerate(pairs):
        a[p, : len(x)], b[p, : len(y)], has_a[p, : len(x)], has_b[p, : len(y)] = x, y, True, True
    first = np.array([d - EDITS for _, _, d in pairs])
    j = first[:, None, None] + np.arange(size)[None, :, None] + np.arange(width)[None, None, :]
    inside = (j >= 0) & (j < wide)
    j = np.where(inside, j, 0)
    row = np.arange(len(pairs))[:, None, None]
    same = inside & has_b[row, j] & has_a[:, :, None] & (b[row, j] == a[:, :, None])
    starts = size - PASSAGE + 1
    never, ramp = np.int16(1000), np.arange(width, dtype=np.int16)
    cost = np.where(same[:, :starts], np.int16(0), never)
    cost = np.minimum.accumulate(cost - ramp, axis=2) + ramp
    found = np.zeros(len(pairs), bool)
    for k in range(1, LONGEST):  # windows of k words become windows of k + 1
        left = min(starts, size - k)
        cost, here = cost[:, :left], same[:, k : k + left]
        if k + 1 >= PASSAGE:
            found |= PER_EDIT * np.where(here, cost, never).min(axis=(1, 2)).astype(int) <= k + 1
        new = cost + ~here
        new[:, :, :-1] = np.minimum(new[:, :, :-1], cost[:, :, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=2) + ramp
    return found


def holds_passage(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[bool]:
    """For each (item's block, document's block) whether one of its bands holds a passage."""
    left = {p: bands(a, b) for p, (a, b) in enumerate(pairs)}
    out = [False] * len(pairs)
    while left := {p: ds for p, ds in left.items() if ds and not out[p]}:
        now = list(left)
        for at in range(0, len(now), 64):
            some = now[at : at + 64]
            for p, ok in zip(some, aligned([(*pairs[p], left[p][0]) for p in some])):
                out[p] = bool(ok)
        left = {p: ds[1:] for p, ds in left.items()}
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pairs = [(np.asarray(a, np.int64).view(np.uint64), np.asarray(c, np.int64).view(np.uint64)) for a, c in zip(b["codes_i"], b["codes_d"])]
        yield b.loc[holds_passage(pairs), ["whole", "block"]]


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc): each item with each document that holds a passage of it within the edit budget.

    Null and blank texts, and items under `PASSAGE` words, match nothing; a null key is no row. An item listed twice is two items, and
    a document's id on several rows is one document. Equal items and equal blocks of documents are compared once, whoever holds them.
    Tables of any size on either side are joined by q-grams; nothing but the bounded bitmap passes through the driver.
    """
    parts = cut(_items(items, item_key, text))
    item_grams = cut(parts.select("whole", "no", F.explode("grams").alias("g")).select("whole", "no", "g.gram", F.col("g.n").alias("n_i")).distinct())
    bits, width = bitmap(item_grams.select("gram").distinct(), "gram")
    found = cut(_doc_blocks(docs, doc_key, text, bits, width))
    doc_grams = found.select("block", F.explode("grams").alias("g")).select("block", "g.gram", F.col("g.n").alias("n_d")).distinct()
    shared = grid_join(doc_grams, item_grams, "gram").groupBy("block", "whole", "no").agg(F.sum(F.least("n_d", "n_i")).alias("n")).where(F.col("n") >= NEED)
    pairs = shared.select("block", "whole", "no").join(parts.select("whole", "no", F.col("codes").alias("codes_i")).dropDuplicates(["whole", "no"]), ["whole", "no"])
    pairs = pairs.join(found.select("block", F.col("codes").alias("codes_d")).dropDuplicates(["block"]), "block")
    passages = pairs.select("whole", "block", "codes_i", "codes_d").mapInPandas(_verified, "whole binary, block binary").distinct()
    holders = passages.join(found.select("_doc", "block"), "block").select("whole", "_doc").distinct()
    return holders.join(parts.select("_item", "whole").distinct(), "whole").select(F.col("_item").alias(item_key), F.col("_doc").alias(doc_key)).distinct()
