"""How often every distinct term occurs, and in how many records: heavy and light terms counted apart.

A first pass keeps, per task, a bounded summary of frequent terms (Misra-Gries); a term in more than a 1/`HEAVY` share
of some task's terms is bound to be in it. The summaries' best terms are the heavy terms, at most `HEAVY` of them; only they are
broadcast. The second pass counts heavy terms in exact arrays, one row a task and term, and passes on the light terms with
their counts; the final sum is over few rows even for a term that a third of all records hold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most heavy terms (and entries of a task's summary), and most light terms that a task holds before it passes them on.
HEAVY, HELD = 4096, 200_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def text_terms(text: str | None) -> list[str]:
    """The longest runs of letters and digits of a text, composed and in lower case; none for null."""
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())) if text else []


def array_terms(values) -> list[str]:
    """The values of an array, without nulls and empty ones."""
    return [v for v in values if v] if values is not None else []


def _summaries(terms: Callable, col: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for b in batches:
            for x in b[col]:
                for t in terms(x):
                    held[t] = held.get(t, 0) + 1
                if len(held) > 8 * HEAVY:  # lower all counts so that at most HEAVY stay
                    cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -HEAVY - 1)[-HEAVY - 1])
                    held = {t: c - cut for t, c in held.items() if c > cut}
        top = sorted(held.items(), key=lambda kv: (-kv[1], kv[0]))[:HEAVY]
        yield pd.DataFrame({"term": [t for t, _ in top], "n": [c for _, c in top]}).astype({"term": object, "n": "int64"})

    return run


def heavy_terms(records: DataFrame, col: str, terms: Callable) -> list[str]:
    """At most HEAVY terms, by the summaries of all tasks; they only steer the counting, which is exact for all terms."""
    found = records.select(col).mapInPandas(_summaries(terms, col), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [r.term for r in found.orderBy(F.desc("n"), "term").limit(HEAVY).collect()]  # bounded by HEAVY


def term_counts(records: DataFrame, col: str, terms: Callable = text_terms) -> DataFrame:
    """(term, n, n_records): how often each term occurs in `col`, and in how many rows of `records`.

    Every row is a record; null, empty and blank fields hold no term. Terms of any length are counted.
    """
    heavy = records.sparkSession.sparkContext.broadcast(heavy_terms(records, col, terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {t: i for i, t in enumerate(heavy.value)}
        often, many = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        light: dict[str, list[int]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"term": list(light), "n": [v[0] for v in light.values()], "n_records": [v[1] for v in light.values()]}).astype({"term": object, "n": "int64", "n_records": "int64"})

        for b in batches:
            for x in b[col]:
                found = terms(x)
                mine: dict[str, int] = {}
                for t in found:
                    mine[t] = mine.get(t, 0) + 1
                for t, c in mine.items():
                    i = at.get(t)
                    if i is not None:
                        often[i] += c
                        many[i] += 1
                    elif (v := light.get(t)) is not None:
                        v[0] += c
                        v[1] += 1
                    else:
                        light[t] = [c, 1]
                if len(light) > HELD:
                    yield rows()
                    light = {}
        yield rows()
        own = np.flatnonzero(many)
        yield pd.DataFrame({"term": [heavy.value[i] for i in own], "n": often[own], "n_records": many[own]}).astype({"term": object})

    counted = records.select(col).mapInPandas(count, "term string, n long, n_records long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


def marked(counts: DataFrame, records: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """Adds (records, mark): `rare` for terms in at most `rare` records, `common` for those in at least that share of all.

    A term that is both (in tables of a few rows) has a row for each mark; a term that is neither has a null mark.
    """
    total = records.agg(F.count("*")).scalar()
    marks = F.filter(
        F.array(F.when(F.col("n_records") <= rare, "rare"), F.when(F.col("n_records") >= F.col("records") * common - 1e-9, "common")),
        lambda m: m.isNotNull(),
    )
    return counts.withColumn("records", total).withColumn("mark", F.explode_outer(marks))
