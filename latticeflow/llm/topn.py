"""The N best rows of every group, by skipping row groups whose statistics show that they can't hold any.

The rows are written clustered by group, best first, in row groups of a bounded number of rows. The footers of the written files give,
for every row group, the groups it holds, its best and worst score and its rows. Sums of rows in descending order of the worst score
tell a score that N rows of a group are known to reach: its current N-th score. A row group is skipped if its best score is strictly
below that of every group it holds. In this order a row group that holds several groups begins one of them, with its best rows, so it is
always needed; those of one group alone, which are most of a group longer than a row group, are not. The others are read in descending
order of their best score, each task keeping N rows of a group at a time and skipping on; a last window settles the rest.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.session import cut, delete, scratch

#: Rows of a row group (a part of a usual group's rows), and of a written file.
ROW_GROUP, FILE_ROWS = 64, 4_000_000
#: Row groups that are read at a time, in descending order of their best score.
STRETCH = 256
#: A group is told by two hashes of its whole name; statistics of numbers are exact, however long the name is.
_IDS = "h1 long, h2 long"


def _open(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(system.open_input_file(path))


def _stats(kind: str) -> str:
    return f"file string, rg int, alone boolean, {_IDS}, best {kind}, worst {kind}, n long"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for uri in b["file"]:
            with _open(uri) as f:
                meta = f.metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    rg = meta.row_group(g)
                    h1, h2, score = ((s.min, s.max) if (s := rg.column(at[c]).statistics) is not None and s.has_min_max else (None, None) for c in ("_h1", "_h2", "_score"))
                    alone = None not in (*h1, *h2, *score) and h1[0] == h1[1] and h2[0] == h2[1]
                    rows.append((uri, g, alone, h1[0] if alone else None, h2[0] if alone else None, score[1], score[0], rg.num_rows))
        out = pd.DataFrame(rows, columns=["file", "rg", "alone", "h1", "h2", "best", "worst", "n"])
        yield out.astype({"rg": "int32", "h1": "Int64", "h2": "Int64", "n": "int64"})


def needed_row_groups(stats: DataFrame, n: int) -> DataFrame:
    """The row groups without those of one group alone whose best score is strictly below the group's current N-th score.

    Row groups of several groups, or without statistics, always stay.
    """
    w = Window.partitionBy("h1", "h2").orderBy(F.desc("worst"), "file", "rg").rowsBetween(Window.unboundedPreceding, 0)
    alone = stats.where("alone")
    floor = alone.withColumn("_sum", F.sum("n").over(w)).where(F.col("_sum") >= n).groupBy("h1", "h2").agg(F.max("worst").alias("_floor"))
    kept = alone.join(floor, ["h1", "h2"], "left").where(F.col("_floor").isNull() | (F.col("best") >= F.col("_floor")))
    return kept.select(*stats.columns).unionByName(stats.where(~F.col("alone")))


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, descending_tie: bool = False, row_group: int = ROW_GROUP) -> DataFrame:
    """(group, tie, score, rank): the n rows of each group with the highest score; equal scores by the lower `tie`.

    Rows whose group, score or tie is null, and NaN scores, don't rank. Exactly equal rows are separate rows; a group of fewer
    than n rows is whole. `tie` must be numeric; scores keep their type. The group is compared as a string. The clustered rows are
    written to the shared folder and deleted once the result, at most n rows a group, is settled there.
    """
    return _skimmed(df, group, score, tie, n, descending_tie, row_group)[0]


def skipped(df: DataFrame, group: str, score: str, tie: str, n: int, row_group: int = ROW_GROUP) -> dict[str, int]:
    """How much of the clustered rows a run of `top_n` writes, and how much it reads: rows and row groups."""
    stats, local = _skimmed(df, group, score, tie, n, False, row_group)[1]
    written = stats.agg(F.sum("n").alias("rows written"), F.count("*").alias("row groups written")).first().asDict()
    read = local.agg(F.sum("_read").alias("rows read"), F.sum("_rgs").alias("row groups read")).first().asDict()
    return {k: v or 0 for k, v in (written | read).items()}


def _skimmed(df: DataFrame, group: str, score: str, tie: str, n: int, descending_tie: bool, row_group: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    import pyarrow.parquet  # noqa: F401  (the workers need it)

    spark = df.sparkSession
    sign = -1 if descending_tie else 1
    real = F.lit(True) if dict(df.dtypes)[score] not in ("double", "float") else ~F.isnan(score)
    g = F.col(group).cast("string")
    ranked = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & real & F.col(tie).isNotNull()).select(
        F.xxhash64(g).alias("_h1"), F.xxhash64(F.reverse(g), F.length(g)).alias("_h2"), g.alias("_group"), F.col(score).alias("_score"), F.col(tie).alias("_tie")
    )
    path = scratch(spark, "topn")
    # the ranges run over group and score, so that one long group spreads over many files
    (
        ranked.repartitionByRange(F.col("_h1"), F.col("_h2"), F.desc("_score"))
        .sortWithinPartitions("_h1", "_h2", F.desc("_score"), F.col("_tie") * sign)
        .write.option("parquet.block.row.count.limit", row_group)
        .option("maxRecordsPerFile", FILE_ROWS)
        .parquet(path)
    )
    kinds = dict(ranked.dtypes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))
    stats = cut(files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(_footers, _stats(kinds["_score"])))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor: dict[tuple[int, int], object] = {}
        names = ["_h1", "_h2", "_group", "_score", "_tie"]
        for b in batches:
            for uri, part in b.groupby("file", sort=False):
                left = list(zip(part["rg"], part["alone"], part["h1"], part["h2"], part["best"]))
                with _open(uri) as f:
                    while left:
                        # this task has n better rows of the only group of those that are skipped
                        left = [x for x in left if not (x[1] and (x[2], x[3]) in floor and x[4] < floor[x[2], x[3]])]
                        now, left = left[:STRETCH], left[STRETCH:]
                        if not now:
                            break
                        rows = f.read_row_groups([int(x[0]) for x in now], columns=names).to_pandas()
                        total = len(rows)
                        rows = rows.assign(_t=rows["_tie"] * sign).sort_values(["_h1", "_h2", "_group", "_score", "_t"], ascending=[True, True, True, False, True], kind="stable")
                        rows = rows.groupby(["_h1", "_h2", "_group"], sort=False).head(n)
                        of = rows.groupby(["_h1", "_h2"], sort=False)["_score"].agg(["size", "min"])
                        for key, least in of.loc[of["size"] >= n, "min"].items():
                            if key not in floor or least > floor[key]:
                                floor[key] = least
                        yield rows[["_group", "_score", "_tie"]].assign(_read=[total] + [0] * (len(rows) - 1), _rgs=[len(now)] + [0] * (len(rows) - 1))

    # row groups of one file go to one task, best first
    kept = needed_row_groups(stats, n).repartition("file").sortWithinPartitions("file", F.col("best").desc_nulls_first())
    local = cut(kept.mapInPandas(read, f"_group string, _score {kinds['_score']}, _tie {kinds['_tie']}, _read long, _rgs long"))
    with contextlib.suppress(Exception):  # a folder that can't be deleted is left to the cluster
        delete(spark, path)
    order = F.desc("_tie") if descending_tie else F.col("_tie")
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("_score"), order))
    best = local.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("_group").alias(group), F.col("_tie").alias(tie), F.col("_score").alias(score), "rank")

    return best, (stats, local)


def best_evaluations(log: DataFrame, n: int = 3) -> DataFrame:
    """(run_id, step, dev_accuracy, rank): the n best evaluations of each run by dev_accuracy, the earlier step first.

    Rows without a run_id or step, and those whose dev_accuracy is null, NaN or outside 0..1, don't rank. Of several rows for
    one step the one logged last counts; at equal times the one with the higher accuracy.
    """
    return top_n(last_evaluations(log), "run_id", "dev_accuracy", "step", n)


def last_evaluations(log: DataFrame) -> DataFrame:
    """(run_id, step, dev_accuracy) of the rows that rank."""
    usable = log.where(F.col("run_id").isNotNull() & F.col("step").isNotNull() & F.col("dev_accuracy").between(0, 1))
    return usable.groupBy("run_id", "step").agg(F.max(F.struct("logged_at", "dev_accuracy"))["dev_accuracy"].alias("dev_accuracy"))
