"""Filling containers of fixed capacity with items of varying length: exact complements first, best fit for the rest.

What is planned is not items but the histogram of their lengths, which no number of items makes longer than the
capacity. Single, pair and triple sums of the available lengths are indexed; the longest item takes the combination that
fills its gap exactly, as many times as the counts allow. Items without such a complement go to the tightest gap.
A plan is a list of patterns, each used so many times; it takes about as many steps as there are lengths. Items find their container by
their rank among equal lengths, which is counted in parts of bounded size, so neither one cache nor one length is ordered in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.operators.records import first_delivery
from latticeflow.session import cut

#: Items of one length that one task ranks, and most rows of a table that is broadcast.
RANKED, SMALL = 20_000, 100_000
#: Lengths that are tried as the first of a triple; a gap for which none of them does goes to best fit.
TRIES = 32
Pattern = tuple[tuple[int, ...], int]


def _pair(avail: np.ndarray, gap: int, used: tuple[int, ...], counts: np.ndarray) -> tuple[int, int] | None:
    """The two available lengths with the given sum, the longer one as long as possible; looked for in growing stretches."""
    high, size = gap - 1, 64
    while high >= (gap + 1) // 2:
        low = max(high - size, (gap + 1) // 2 - 1)
        # lengths from high down to low + 1, and their complements
        for k in np.flatnonzero(avail[low + 1 : high + 1][::-1] & avail[gap - high : gap - low]):
            x = high - int(k)
            if _holds((*used, x, gap - x), counts):
                return x, gap - x
        high, size = low, 4 * size
    return None


def _holds(pattern: tuple[int, ...], counts: np.ndarray) -> bool:
    return all(counts[x] >= pattern.count(x) for x in set(pattern))


def _sums(avail: np.ndarray) -> np.ndarray:
    """Which numbers up to the capacity are sums of two available lengths."""
    if len(avail) <= 512:
        out = np.zeros(2 * len(avail), bool)
        for x in np.flatnonzero(avail):
            out[x : x + len(avail)] |= avail
        return out[: len(avail)]
    f = np.fft.rfft(avail.astype(float), 2 * len(avail))
    return np.fft.irfft(f * f, 2 * len(avail))[: len(avail)] > 0.5


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """[(lengths of a container, number of such containers)] for lengths from 1 to capacity; all items are placed.

    What fits one container is put in one. Exact complements come first and best fit takes the rest; where exact fillings use up the short
    lengths that others would have needed, best fit alone may take fewer containers, and is taken then.
    """
    if 0 < sum(length * n for length, n in histogram.items()) <= capacity:
        return [(tuple(x for x in sorted(histogram, reverse=True) for _ in range(histogram[x])), 1)]
    exact, rest = _complements(histogram, capacity)
    first = exact + _best_fit(rest, capacity)
    second = _best_fit(sorted(histogram.items(), reverse=True), capacity)
    return min(first, second, key=lambda p: sum(n for _, n in p))


def _complements(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], list[tuple[int, int]]]:
    """Combinations that fill a container exactly, the longest length first, and (length, number) of what has none.

    A used combination exhausts a length at least, so there are no more steps than lengths.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    avail = counts > 0
    out: list[Pattern] = []
    rest: list[tuple[int, int]] = []
    sums, gone, left = None, 0, int(avail.sum())
    for length in np.flatnonzero(avail)[::-1].tolist():
        while counts[length]:
            gap = capacity - length
            pattern: tuple[int, ...] | None = None
            if gap == 0:
                pattern = (length,)
            elif _holds((length, gap), counts):
                pattern = (length, gap)
            elif pair := _pair(avail, gap, (length,), counts):
                pattern = (length, *pair)
            elif gap > 2:
                if sums is None or 16 * gone > left:  # lengths only vanish, so an older index lacks no sum
                    sums, gone, left = _sums(avail), 0, int(avail.sum())
                # lengths from gap - 2 down to 1 whose complement is a sum of two
                for k in np.flatnonzero(avail[1 : gap - 1][::-1] & sums[2:gap])[:TRIES]:
                    x = gap - 2 - int(k)
                    if pair := _pair(avail, gap - x, (length, x), counts):
                        pattern = (length, x, *pair)
                        break
            if pattern is None:
                rest.append((length, int(counts[length])))
                counts[length], avail[length] = 0, False
                gone += 1
                break
            times = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                counts[x] -= times
            for x in set(pattern):
                avail[x] = counts[x] > 0
                gone += not avail[x]
            out.append((pattern, times))
    return out, rest


def _best_fit(rest: list[tuple[int, int]], capacity: int) -> list[Pattern]:
    """Each length, longest first, to the tightest gap: `open_` maps a gap to the containers that have it, `gaps` are its keys in order."""
    open_: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], bins: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, bins))

    for length, n in rest:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                for per, bins in ((each, n // each), (n % each, 1)):
                    if per and bins:
                        put(capacity - per * length, (length,) * per, bins)
                break
            gap = gaps[at]
            pattern, bins = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            placed = min(bins, n)
            if bins > placed:
                put(gap, pattern, bins - placed)
            put(gap - length, (*pattern, length), placed)
            n -= placed
    return [p for g in gaps for p in open_[g]]


def pack_list(lengths: list[int | None], capacity: int | None) -> list[list[tuple[int, int]]]:
    """For each length the (size, container) of its pieces; none for null, zero and negative ones or a useless capacity.

    Only a length over the capacity has several pieces: full ones, then the rest. Containers are numbered from 0.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    if capacity is None or capacity < 1:
        return out
    slots: dict[int, list[int]] = {}
    bins = 0
    for i, n in enumerate(lengths):
        if n is None or n != n or n < 1:
            continue
        full, left = divmod(int(n), capacity)
        for _ in range(full):
            out[i].append((capacity, bins))
            bins += 1
        if left:
            slots.setdefault(left, []).append(i)
    for v in slots.values():
        v.reverse()
    for pattern, times in plan({k: len(v) for k, v in slots.items()}, capacity):
        for _ in range(times):
            for x in pattern:
                out[slots[x].pop()].append((x, bins))
            bins += 1
    return out


def _bounded(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it is proven small; else it is joined like any other."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def trimmed_size(ids: str, pad: str) -> Column:
    """Length of an array without the padding (the pad value or null) at its end; 0 for null."""
    last = F.array_max(F.transform(F.col(ids), lambda x, i: F.when(x.isNull() | F.coalesce(x == F.col(pad), F.lit(False)), 0).otherwise(i + 1)))
    return F.coalesce(last, F.lit(0))


def examples(encoded: DataFrame, caches: DataFrame) -> DataFrame:
    """(ex_id, cache, n, lengths, max_length, max_block_length): each example once (first delivery), n ids without padding.

    Examples without a known cache have null capacities.
    """
    first = first_delivery(encoded, "ex_id", "cached_at", ["cache", "input_ids", "lengths"])
    known = _bounded(caches.dropDuplicates(["cache"]).select("cache", "max_length", "max_block_length", "pad_id"))
    return first.join(known, "cache", "left").select("ex_id", "cache", trimmed_size("input_ids", "pad_id").alias("n"), "lengths", "max_length", "max_block_length")


def pack_rows(items: DataFrame, group: str, key: str, length: str, capacity: str) -> DataFrame:
    """(group, key, length, capacity, piece, size, bin): the container of each piece of each item; bins are numbered per group from 0.

    An item over the capacity is cut into full pieces and a rest, any other is one piece. A full piece has a container of its own
    and a null bin. Items with a null or useless capacity or
    a length under 1 have a null size and bin. Rows with one key are separate items. Equal capacities are assumed within a group.
    """
    base = items.select(group, key, F.col(length).cast("long").alias("length"), F.col(capacity).cast("long").alias("capacity"))
    ok = F.col("capacity").isNotNull() & (F.col("capacity") >= 1) & F.col("length").isNotNull() & (F.col("length") >= 1) & F.col(group).isNotNull()
    base = base.withColumns({"_ok": ok, "_full": F.when(ok, F.floor(F.col("length") / F.col("capacity"))).otherwise(F.lit(0).cast("long")), "_rest": F.when(ok, F.col("length") % F.col("capacity"))})
    base = cut(base.withColumn("_id", F.monotonically_increasing_id()))
    kinds = dict(base.dtypes)

    def patterns(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capacity_ = int(rows["capacity"].iloc[0])
        at: dict[int, int] = {}
        out, bins = [], 0
        for pattern, times in plan(dict(zip(rows["_rest"], rows["c"])), capacity_):
            for x in set(pattern):
                m = pattern.count(x)
                out.append((key_[0], x, at.get(x, 0), m, bins))
                at[x] = at.get(x, 0) + m * times
            bins += times
        return pd.DataFrame(out, columns=[group, "_rest", "from", "m", "bin0"])

    histogram = base.where("_rest > 0").groupBy(group, "capacity", "_rest").agg(F.count("*").alias("c"))
    # a group of the histogram has at most as many rows as the capacity
    runs = histogram.groupBy(group).applyInPandas(patterns, f"`{group}` {kinds[group]}, _rest long, `from` long, m long, bin0 long")
    runs = runs.groupBy(group, "_rest").agg(F.array_sort(F.collect_list(F.struct("from", "m", "bin0"))).alias("runs"))
    planned = _bounded(cut(runs.join(histogram.select(group, "_rest", F.ceil(F.col("c") / RANKED).alias("_salts")), [group, "_rest"])))

    salted = base.where("_rest > 0").select(group, "_rest", "_id").join(planned, [group, "_rest"]).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))
    parts = salted.groupBy(group, "_rest", "_salt").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group, "_rest").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_rest", "_salt").orderBy("_id")) - 1).join(before, [group, "_rest", "_salt"])
    rank = F.col("_r") + F.col("_before")
    run = F.element_at(F.filter("runs", lambda r: r["from"] <= rank), -1)
    placed = ranked.select("_id", run.alias("run"), rank.alias("rank"))
    placed = placed.select("_id", (F.col("run.bin0") + F.floor((F.col("rank") - F.col("run.from")) / F.col("run.m"))).alias("_bin"))
    whole = base.join(placed, "_id", "left")
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_full") + F.when(F.col("_rest") > 0, 0).otherwise(-1)),
        lambda i: F.struct(i.cast("int").alias("piece"), F.when(i < F.col("_full"), F.col("capacity")).otherwise(F.col("_rest")).alias("size"), F.when(i == F.col("_full"), F.col("_bin")).alias("bin")),
    )
    none = F.array(F.struct(F.lit(0).alias("piece"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("bin")))
    out = whole.withColumn("_p", F.explode(F.when(F.col("_ok"), pieces).otherwise(none)))
    return out.select(group, key, "length", "capacity", "_p.piece", "_p.size", "_p.bin")


def pack_blocks(items: DataFrame, key: str, lengths: str, capacity: str) -> DataFrame:
    """(key, pos, length, capacity, piece, size, bin): each row's own chunks packed into blocks; bins are numbered per row from 0.

    Null, zero and negative lengths are no chunks; a null list or useless capacity gives no rows.
    """
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, ls, c in zip(b[key], b[lengths], b[capacity]):
                if ls is None or c is None or c != c:
                    continue
                for pos, (n, pieces) in enumerate(zip(ls, pack_list(list(ls), int(c)))):
                    rows.extend((k, pos, int(n), int(c), p, size, bin_) for p, (size, bin_) in enumerate(pieces))
            yield pd.DataFrame(rows, columns=[key, "pos", "length", "capacity", "piece", "size", "bin"]).astype({"pos": "int32", "length": "int64", "capacity": "int64", "piece": "int32", "size": "int64", "bin": "int64"})

    return items.select(key, lengths, capacity).mapInPandas(run, f"`{key}` {kind}, pos int, length long, capacity long, piece int, size long, bin long")


def oversize(encoded: DataFrame, caches: DataFrame) -> DataFrame:
    """(ex_id, field, pos): the items that the packing had to cut, since they exceed the capacity."""
    ex = cut(examples(encoded, caches))
    rows = pack_rows(ex, "cache", "ex_id", "n", "max_length").where("piece = 0 and length > capacity").select("ex_id", F.lit("input_ids").alias("field"), F.lit(0).alias("pos"))
    blocks = pack_blocks(ex, "ex_id", "lengths", "max_block_length").where("piece = 0 and length > capacity").select("ex_id", F.lit("lengths").alias("field"), "pos")
    return rows.unionByName(blocks)


def fill_report(packed: DataFrame, group: str) -> DataFrame:
    """(group, capacity, pieces, containers, least, used): containers taken, the fewest that could do, and the share of space used."""
    real = packed.where("size is not null")
    own = real.where("bin is null").groupBy(group, "capacity").agg(F.count("*").alias("p"), F.count("*").alias("c"), F.sum("size").alias("s"))
    shared = real.where("bin is not null").groupBy(group, "capacity").agg(F.count("*").alias("p"), (F.max("bin") + 1).alias("c"), F.sum("size").alias("s"))
    out = own.unionByName(shared).groupBy(group, "capacity").agg(F.sum("p").alias("pieces"), F.sum("c").alias("containers"), F.sum("s").alias("_s"))
    least = F.ceil(F.col("_s") / F.col("capacity")).alias("least")
    return out.select(group, "capacity", "pieces", "containers", least, (F.col("_s") / (F.col("containers") * F.col("capacity"))).alias("used"))
