"""Dynamic programs over lattices, as expressions on an array of edges (s, e, token, logp) per row.

All are folds over the nodes 0..length, within one row and without a shuffle. The edges are sorted once by their end (or start) and
each node takes its slice of them, so a fold evaluates its expression once per edge. Impossible is -Infinity; an unreachable
node never gives NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeflow.functions.text import let

NEG_INF = float("-inf")
EDGE = "struct<s:int,e:int,token:string,logp:double>"


def lse(values: Column) -> Column:
    """log-sum-exp of an array; -Infinity for an empty one."""

    def total(v: Column) -> Column:
        return let(F.array_max(v), lambda m: F.when(m.isNull() | (m == NEG_INF), F.lit(NEG_INF)).otherwise(m + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m)))))

    return let(values, total)


def _slices(edges: Column, field: str, nodes: Column) -> Column:
    """[edges whose `field` is node j] for the nodes j; `edges` are sorted by that field. Places are found by native scans."""

    def slice_at(named: Column, keys: Column, back: Column, j: Column) -> Column:
        first, last = F.array_position(keys, j).cast("int"), F.size(keys) + 1 - F.array_position(back, j).cast("int")
        return F.when(first > 0, F.slice(named, first, last - first + 1)).otherwise(F.slice(named, 1, 0))

    def sliced(named: Column) -> Column:
        return let(F.transform(named, lambda x: x[field]), lambda keys: let(F.reverse(keys), lambda back: F.transform(nodes, lambda j: slice_at(named, keys, back, j))))

    return let(edges, sliced)


def by_end(edges: Column, length: Column) -> Column:
    """[edges that end at node j] for j = 1..length."""
    ordered = F.array_sort(F.transform(edges, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["token"].alias("token"), x["logp"].alias("logp"))))
    return _slices(ordered, "e", F.sequence(F.lit(1), length))


def by_start_reversed(edges: Column, length: Column) -> Column:
    """[edges that start at node j] for j = length-1..0; `edges` are sorted by start, as in every lattice."""
    return _slices(edges, "s", F.sequence(length - 1, F.lit(0), F.lit(-1)))


def forward(ends: Column) -> Column:
    """alpha of the nodes 0..length."""
    return F.aggregate(ends, F.array(F.lit(0.0)), lambda al, es: F.concat(al, F.array(lse(F.transform(es, lambda x: F.get(al, x["s"]) + x["logp"])))))


def backward(starts: Column, length: Column) -> Column:
    """beta of the nodes 0..length."""
    up = F.aggregate(starts, F.array(F.lit(0.0)), lambda be, es: F.concat(be, F.array(lse(F.transform(es, lambda x: F.get(be, length - x["e"]) + x["logp"])))))
    return F.reverse(up)


def log_z(alpha: Column) -> Column:
    return F.element_at(alpha, -1)


def path_count(ends: Column) -> Column:
    """Number of paths, as a double."""
    return F.element_at(F.aggregate(ends, F.array(F.lit(1.0)), lambda n, es: F.concat(n, F.array(F.aggregate(es, F.lit(0.0), lambda a, x: a + F.get(n, x["s"]))))), -1)


def marginals(edges: Column, alpha: Column, beta: Column) -> Column:
    """Edges with `p`, the share of all paths that pass them.

    alpha and beta are named by `let`: the optimizer may put their expressions here, where they must not run once per edge.
    """

    def edge(x: Column, a: Column, b: Column) -> Column:
        z = log_z(a)
        p = F.when(z == NEG_INF, F.lit(0.0)).otherwise(F.exp(F.get(a, x["s"]) + x["logp"] + F.get(b, x["e"]) - z))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["token"].alias("token"), x["logp"].alias("logp"), p.alias("p"))

    return let(alpha, lambda a: let(beta, lambda b: F.transform(edges, lambda x: edge(x, a, b))))


def entropy(marginal_edges: Column, z: Column) -> Column:
    """Entropy of the distribution over paths, in nats: log Z less the expected weight of a path."""
    h = z - F.aggregate(F.filter(marginal_edges, lambda x: x["p"] > 0), F.lit(0.0), lambda a, x: a + x["p"] * x["logp"])
    return F.when(z == NEG_INF, F.lit(None).cast("double")).otherwise(F.greatest(h, F.lit(0.0)))


def expectation(marginal_edges: Column, value: Callable[[Column], Column]) -> Column:
    """Expected sum over a path of `value(edge)`."""
    return F.aggregate(marginal_edges, F.lit(0.0), lambda a, x: a + x["p"] * value(x).cast("double"))


def nbest(ends: Column, n: int) -> Column:
    """The n best paths [(cost, size, path)], best first; cost is the negative log weight.

    Ties go to fewer tokens, then to the lesser array of tokens. Only existing paths are returned.
    """
    none = F.array().cast("array<struct<cost:double,size:int,path:array<string>>>")
    start = F.array(F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("path"))))

    def step(best: Column, es: Column) -> Column:
        found = F.flatten(
            F.transform(
                es,
                lambda x: F.transform(
                    F.get(best, x["s"]),
                    lambda p: F.struct((p["cost"] - x["logp"]).alias("cost"), (p["size"] + 1).alias("size"), F.concat(p["path"], F.array(x["token"])).alias("path")),
                ),
            )
        )
        return F.concat(best, F.array(F.coalesce(F.slice(F.array_sort(found), 1, n), none)))

    return F.element_at(F.aggregate(ends, start, step), -1)


def merge_nbest(blocks: Column, n: int) -> Column:
    """The n best paths of a sequence of blocks, from the n best of each block."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("path")))

    def step(acc: Column, block: Column) -> Column:
        both = F.flatten(F.transform(acc, lambda a: F.transform(block, lambda b: F.struct((a["cost"] + b["cost"]).alias("cost"), (a["size"] + b["size"]).alias("size"), F.concat(a["path"], b["path"]).alias("path")))))
        return F.slice(F.array_sort(both), 1, n)

    return F.aggregate(blocks, start, step)


def softmax_weights(paths: Column) -> Column:
    """Weights of n-best paths, which sum to 1."""
    return let(lse(F.transform(paths, lambda p: -p["cost"])), lambda z: F.transform(paths, lambda p: F.exp(-p["cost"] - z)))
