"""Several values packed in one field: dialects chosen by minimum description length.

A dialect is a delimiter (or a mixture of all of them) and a way of quoting. Every field is parsed by
every dialect that fits it; the dialect whose parse has the shortest description wins. The description is
the dialect, its separators and the values; a value costs -log2 of its share of all values of the field if it is in
the field's code book, else its letters are spelt. The code book holds the exact counts, over all rows and their
candidate parses, of the `BOOK` most frequent values, by a hash of each; it is the only thing broadcast and has a fixed bound.

What a dialect can't write has an infinite description: an unquoted value that leaves the alphabet, where that is known (`strict`), and a
quoted value as a plain one. Where one description is finite no code book can change the choice; where no field has more, none is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.operators.records import first_delivery

#: The delimiters in use, and the quotes that open a value.
DELIMITERS = "-/|,;\t+~·–，、 "
QUOTES = "\"“'"
#: Entries of a field's code book.
BOOK = 50_000
#: Bits: a spelt character, the end of a spelt value, naming a quoting dialect, an odd separator, a character that the alphabet of unquoted values lacks.
CHAR_BITS, ESCAPE_BITS, QUOTE_BITS, ODD_BITS, ALIEN_BITS = 5.0, 12.0, 1.0, 16.0, 3.0

_BARE = r"(?P<v>\[SP[123]\]|[\p{L}\p{N}\p{M}:'’]+)"
_QUOTED = regex.compile(
    r"\"(?P<q>[^\"]*)\"|“(?P<q>[^”]*)”|(?<![\p{L}\p{N}\p{M}:'’])'(?P<q>[^'](?:[^']|'(?=[\p{L}\p{N}\p{M}]))*)'(?![\p{L}\p{N}\p{M}'’])|" + _BARE
)
_PLAIN = regex.compile(_BARE)
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]")
_MARKS = QUOTES + "”"
_BLANK = regex.compile(r"\s+")


class Parse(NamedTuple):
    """Values with their place in the text; whether each was quoted; the separators between them, and those around them."""

    values: list[str]
    spans: list[tuple[int, int]]
    quoted: list[bool]
    inner: list[str]
    outer: str


def scan(text: str, quoting: bool) -> Parse:
    """The parse that takes every separator for one; empty pieces are no values, list marks and blanks around other separators are none."""
    values, spans, quoted, gaps, at = [], [], [], [], 0
    gap = ""
    for m in (_QUOTED if quoting else _PLAIN).finditer(text):
        gap += text[at : m.start()]
        at = m.end()
        v = m["v"]
        own = v is None
        if own:
            v = m["q"].strip()
        if v:
            values.append(v)
            spans.append(m.span())
            quoted.append(own)
            gaps.append(gap)
            gap = ""
    gaps.append(gap + text[at:])
    body = text.strip()
    if body[:1] == "[" and body[-1:] == "]":
        gaps[0], gaps[-1] = gaps[0].replace("[", "", 1), gaps[-1].replace("]", "", 1)
    return Parse(values, spans, quoted, [g.strip() or g[:1] for g in gaps[1:-1]], gaps[0].strip() + (gaps[-1].strip() if len(gaps) > 1 else ""))


def well_quoted(text: str) -> bool:
    """Whether the field has quoted values, each between separators, and no quote mark besides."""
    at, quoted = 0, False
    for m in _QUOTED.finditer(text):
        if any(c in _MARKS for c in text[at : m.start()]):
            return False
        at = m.end()
        if m["v"] is None:
            quoted = True
            if _WORD.match(text[m.start() - 1 : m.start()]) or _WORD.match(text[at : at + 1]):
                return False
    return quoted and not any(c in _MARKS for c in text[at:])


def _kind(gap: str) -> str:
    """The delimiter that a separator is made of; several of one stand for empty pieces between them."""
    marks = set(gap.replace(" ", "")) or {" "}
    return next(iter(marks)) if len(marks) == 1 else gap


def _merged(text: str, p: Parse, delimiter: str) -> tuple[list[str], int, int] | None:
    """(values, separators, characters outside the alphabet) if only `delimiter` separates; None if that would join a quoted value."""
    values, seps, alien, start = [], 0, 0, 0
    for k, gap in enumerate([*p.inner, None]):
        if gap is not None and _kind(gap) != delimiter:
            if p.quoted[k] or p.quoted[k + 1]:
                return None
            alien += p.spans[k + 1][0] - p.spans[k][1]
            continue
        values.append(p.values[k] if start == k else text[p.spans[start][0] : p.spans[k][1]])
        seps += gap is not None
        start = k + 1
    return values, seps, alien


def candidates(text: str, strict: bool = True) -> list[tuple[str, list[str], float]]:
    """Each dialect: its name, its values, and the bits of everything but the values.

    The alphabet of unquoted values, if it is known (`strict`), has no code for other characters. What stands in quotes is one value whatever
    it contains, so a plain dialect has no code for a well quoted field.
    """
    found: list[tuple[str, list[str], float]] = []
    marked = any(q in text for q in QUOTES)
    well = marked and well_quoted(text)
    for quoting in (False, True) if marked else (False,):
        p = scan(text, quoting)
        if quoting and not any(p.quoted) and not well:
            continue
        kinds = dict.fromkeys(_kind(g) for g in p.inner)
        name = "quoted" if quoting else "plain"
        one = math.log2(len(DELIMITERS))
        odd = sum(1 for c in p.outer + "".join(p.inner) if c not in DELIMITERS and not c.isspace())
        base = math.inf if well and not quoting else QUOTE_BITS * quoting + ODD_BITS * odd + len(p.outer)
        if len(kinds) > 1:
            found.append((f"{name} mixed", p.values, base + 2 * one + one * len(p.inner)))
            for d in kinds:
                if merged := _merged(text, p, d):
                    values, seps, alien = merged
                    found.append((f"{name} {d}", values, base + one + seps + (math.inf if strict and alien else ALIEN_BITS * alien)))
        else:
            found.append((f"{name} {next(iter(kinds), 'single')}", p.values, base + one + len(p.inner)))
    return found


def possible(text: str, strict: bool = True) -> list[tuple[str, list[str], float]]:
    """The dialects that have a finite description of the field, whatever the code book; there is always one."""
    return [c for c in candidates(text, strict) if c[2] < math.inf]


def best_parse(text: str | None, book, strict: bool = True) -> tuple[str | None, list[str]]:
    """The cheapest dialect and its values; ties go to the first of plain, quoted, and of mixed and single delimiters. Null and blank fields hold no values.

    `book.get` gives the bits of a value, or None.
    """
    if text is None or not text.strip():
        return None, []
    fits = possible(text, strict)
    if len(fits) == 1:  # any other is infinitely longer
        return fits[0][0], fits[0][1]
    cost = lambda c: c[2] + sum(book.get(v) or ESCAPE_BITS + CHAR_BITS * len(v) for v in c[1])
    costs = [round(cost(c), 6) for c in fits]
    best = fits[costs.index(min(costs))]
    return best[0], best[1]


class Book:
    """Bits of values, by a 64-bit hash of each."""

    def __init__(self, bits: dict[int, float]):
        self.bits = bits

    def get(self, value: str) -> float | None:
        return self.bits.get(_hash(value))


def _hash(value: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(value)
    return h - (1 << 64) if h >> 63 else h


def ambiguous(df: DataFrame, fields: list[str], strict: bool) -> bool:
    """Whether any field of any row has more than one parse."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if any(t is not None and t.strip() and len(possible(t, strict)) > 1 for f in fields for t in b[f]):
                yield pd.DataFrame({"found": [1]})
                return

    maybe = df.select(*fields)
    if strict:  # with a known alphabet only quote marks leave a choice
        marked = [F.coalesce(F.col(f).rlike(f"[{QUOTES}”]"), F.lit(False)) for f in fields]
        maybe = maybe.where(reduce(or_, marked))
    return not maybe.mapInPandas(some, "found int").isEmpty()


def code_book(df: DataFrame, fields: list[str], size: int = BOOK, strict: bool = True) -> dict[str, Book]:
    """For each field the bits of its `size` most frequent values (ties by their hash), counted over all rows and all their parses.

    Only hashes and counts leave the tasks. No field is in it if none has more than one parse.
    """
    if not ambiguous(df, fields, strict):
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], int] = {}
        out = lambda: pd.DataFrame({"field": [fields[i] for i, _ in held], "value": [_hash(v) for _, v in held], "n": list(held.values())}).astype({"field": object, "value": "int64", "n": "int64"})
        for b in batches:
            for i, f in enumerate(fields):
                for t in b[f]:
                    if t is not None and t.strip():
                        for _, values, _ in possible(t, strict):
                            for v in values:
                                held[i, v] = held.get((i, v), 0) + 1
            if len(held) > 200_000:
                yield out()
                held = {}
        yield out()

    counts = df.select(*fields).mapInPandas(count, "field string, value long, n long").groupBy("field", "value").agg(F.sum("n").alias("n")).where("n > 1")
    books: dict[str, Book] = {}
    for f in fields:
        top = counts.where(F.col("field") == f).orderBy(F.desc("n"), "value").limit(size).collect()  # bounded by `size`
        total = sum(r.n for r in top)
        if top:
            books[f] = Book({r.value: max(0.5, math.log2(total / r.n)) for r in top})
    return books


def parse_packed(df: DataFrame, fields: list[str], books: dict[str, Book] | None = None, strict: bool = True) -> DataFrame:
    """Every field `f` becomes `f` (array of its values) and `f_dialect`; other columns stay.

    Null, empty and blank fields give an empty array and a null dialect. Works on rows, without a shuffle. Without `strict` unquoted values
    may hold any character, and costs alone settle which delimiter separates.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(code_book(df, fields, strict=strict) if books is None else books)
    rest = [c for c in df.columns if c not in fields]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{f}` array<string>, `{f}_dialect` string" for f in fields)])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[rest].copy()
            for f in fields:
                book = shared.value.get(f, {})
                done = [best_parse(t, book, strict) for t in b[f]]
                out[f] = pd.Series([v for _, v in done], index=b.index, dtype=object)
                out[f + "_dialect"] = pd.Series([d for d, _ in done], index=b.index, dtype=object)
            yield out

    return df.select(*rest, *fields).mapInPandas(parse, schema)


def unpack(df: DataFrame, key: str, fields: list[str], at: str | None = None, books: dict[str, Book] | None = None, strict: bool = True) -> DataFrame:
    """One row (key, field, pos, value) per packed value; pos from 0 in each field.

    With `at`, rows with the same key are one record, whose first delivery counts; without it, the rows of
    `df` must be records. Empty pieces are no values. Rows are whole: no value is dropped at any length.
    """
    records = first_delivery(df, key, at, fields) if at else df.select(key, *fields)
    parsed = parse_packed(records, fields, books, strict)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields])).alias("x")
    return parsed.select(key, each).select(key, "x.field", F.posexplode("x.values").alias("pos", "value"))
