"""Records delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.session import cut

#: Most keys that are broadcast; beyond that they are hashed in a shuffle join.
SMALL = 1_000_000


def first_delivery(df: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """One row per key: the columns `cols` of its earliest delivery.

    Ties in `at` are settled by the values of `cols`, so the result doesn't depend on the order of
    the files; a null `at` counts as latest. A null key is no record and is dropped.
    The keys delivered more than once are counted first, from the key's column alone. Rows of the others pass as they are; only
    rows of repeated keys are grouped, their minimum taken before the shuffle too, so that a hot key sends one row per task.
    """
    known = df.where(F.col(key).isNotNull())
    again = cut(known.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    again = F.broadcast(again) if again.limit(SMALL + 1).count() <= SMALL else again.hint("shuffle_hash")
    order: list[Column] = [F.col(at).isNull().alias("_late"), F.col(at).alias("_at")]
    best = F.min(F.struct(*order, *[F.col(c) for c in cols])).alias("_r")
    twice = known.join(again, key, "left_semi").groupBy(key).agg(best).select(key, *[F.col("_r")[c].alias(c) for c in cols])
    return known.join(again, key, "left_anti").select(key, *cols).unionByName(twice)
