"""Scalar expressions over text and arrays of tokens; lengths are code points, as in SQL's length()."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark of a word's beginning.
SPACE = "▁"
#: Special tokens that count as one character and never split.
SPECIALS = ("[SP1]", "[SP2]", "[SP3]", "[CLS]", "[SEP]", "[BOS]", "[EOS]", "[PAD]", "[UNK]", "[MASK]")


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once (expressions of higher-order functions have no names)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_length(chunk: Column, specials: Sequence[str] = SPECIALS, prefix: str | None = None) -> Column:
    """Length of a chunk: a special token is 1, a continuation prefix isn't counted."""
    n = F.length(chunk)
    if prefix:
        n = F.when(chunk.startswith(prefix), n - len(prefix)).otherwise(n)
    return F.when(chunk.isin(*specials), 1).otherwise(n).cast("int")


def block_length(chunks: Column, specials: Sequence[str] = SPECIALS) -> Column:
    return F.aggregate(F.transform(chunks, lambda c: chunk_length(c, specials)), F.lit(0), lambda a, x: a + x)


def mark_spaces(text: Column, space: str = SPACE) -> Column:
    """The text without blanks at its ends, inner spaces replaced by the space mark."""
    return F.translate(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), " ", space)


def space_chunks(text: Column, specials: Sequence[str] = SPECIALS, dummy: bool = True, space: str = SPACE) -> Column:
    """Chunks of a text split at spaces (empty ones kept), each with the space mark, unless the first chunk is special."""
    chunks = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), " ", -1)
    if not dummy:
        return chunks
    return F.transform(chunks, lambda c: F.when(c.isin(*specials) | F.get(chunks, F.lit(0)).isin(*specials), c).otherwise(F.concat(F.lit(space), c)))


def pretokens(text: Column) -> Column:
    """Runs of word characters, and runs of other characters that aren't blank."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def strip_mark(tokens: Column, space: str = SPACE, drop: Sequence[str] = ("[PAD]",)) -> Column:
    """Tokens without the space mark at their front; bare marks and padding dropped."""
    bare = F.transform(F.filter(tokens, lambda t: ~t.isin(*drop)), lambda t: F.regexp_replace(t, f"^{space}+", ""))
    return F.filter(bare, lambda t: t != "")


def prefix_sums(lengths: Column, exclusive: bool = False) -> Column:
    """Running sums; with `exclusive` they begin with 0 and are one longer."""
    run = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.cast("int"))))
    return run if exclusive else F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0)))


def spans(tokens: Column, specials: Sequence[str] = SPECIALS) -> Column:
    """[(s, e)] of tokens laid end to end."""
    sums = prefix_sums(F.transform(tokens, lambda t: chunk_length(t, specials)), exclusive=True)
    n = F.size(tokens)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(sums, i).alias("s"), F.get(sums, i + 1).alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def with_boundaries(tokens: Column, specials: Sequence[str] = SPECIALS) -> Column:
    """[(unit, rb)]: each token with its right boundary."""
    return F.zip_with(tokens, prefix_sums(F.transform(tokens, lambda t: chunk_length(t, specials))), lambda t, b: F.struct(t.alias("unit"), b.alias("rb")))


def signature(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.length(t))


def cut_by_signature(surface: Column, lengths: Column) -> Column:
    """The surface cut into pieces of the given lengths."""
    starts = prefix_sums(lengths, exclusive=True)
    return F.zip_with(F.slice(starts, 1, F.size(lengths)), lengths, lambda s, n: F.substr(surface, s + 1, n))


def pack_blocks(chunks: Column, max_length: int, specials: Sequence[str] = SPECIALS) -> Column:
    """Chunks packed in order into blocks of at most `max_length` characters: a block ends when the next chunk doesn't fit.

    A chunk over the limit is an error of the caller; it gets a block of its own.
    """
    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used"))

    def step(acc: Column, c: Column) -> Column:
        n = chunk_length(c, specials)
        fits = (acc["used"] + n <= max_length) | (F.size(acc["open"]) == 0)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(c))).otherwise(F.array(c)).alias("open"),
            F.when(fits, acc["used"] + n).otherwise(n).alias("used"),
        )

    return F.aggregate(chunks, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def truncate_blocks(chunks: Column, max_length: int, max_blocks: int, specials: Sequence[str] = SPECIALS) -> Column:
    """The first `max_blocks` packed blocks."""
    return F.slice(pack_blocks(chunks, max_length, specials), 1, max_blocks)


def remove_specials(tokens: Column, specials: Sequence[str] = SPECIALS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*specials))


def cut_long(chunks: Column, most: int) -> Column:
    """Chunks of which those over `most` characters are cut into pieces of `most` and a rest; nothing is left out but empty chunks."""

    def pieces(c: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / most).cast("int")), lambda i: F.substr(c, i * most + 1, F.lit(most)))
        return F.when(F.length(c) <= most, F.array(c)).otherwise(parts)

    return F.flatten(F.transform(F.filter(chunks, lambda c: c != ""), pieces))


def two_digits(x: Column) -> Column:
    """Two significant digits as Python's format(x, ".2") writes them: 0.5, 1.2e+01, 1e-05; null stays null.

    The JVM's formats round and pad otherwise, so this is an Arrow batch function.
    """

    def write(v: pd.Series) -> pd.Series:
        return pd.Series([format(float(y), ".2") for y in v], dtype=object)

    return F.when(x.isNotNull(), F.pandas_udf(write, "string")(x.cast("double")))


def product(x: Column) -> Column:
    return F.aggregate(x, F.lit(1).cast("double"), lambda a, b: a * b)


def shift(x: Column, by: int) -> Column:
    return F.transform(x, lambda v: v + by)


def edge_count(length: Column, max_unit: int) -> Column:
    """Edges of a full lattice of the given length with units of at most `max_unit` characters."""
    m = F.least(length, F.lit(max_unit))
    return (m * length - m * (m - 1) / 2).cast("long")
