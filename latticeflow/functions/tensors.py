"""Dynamic programs over many lattices at once, in numpy.

Sums over all pairs of a node and an edge are the square of a lattice's size; as SQL expressions they are interpreted element by element.
Here lattices of like length are one array of log weights by start and slot (the edge's length, then its copy, if several edges have the
same ends), padded with -Infinity, and each step runs over all of them. Impossible is -Infinity, and NaN where it is conditioned on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of a group's largest array, and the least length that is padded to the longest of its group.
BYTES, PAD = 4 << 20, 0.8


def lse(x: np.ndarray) -> np.ndarray:
    """log-sum-exp over the last axis."""
    m = x.max(axis=-1)
    m = np.where(np.isneginf(m), 0.0, m)
    return np.log(np.exp(x - m[..., None]).sum(axis=-1)) + m


def groups(lengths: np.ndarray, square: bool = True) -> Iterator[np.ndarray]:
    """Numbers of lattices of like length, few enough for arrays over their nodes (or pairs of nodes, if `square`)."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = int(lengths[order[at]])
        most = max(1, BYTES // (8 * (n + 1) * ((n + 1) if square else 8)))
        end = at + int(np.searchsorted(-lengths[order[at : at + most]], -PAD * n, side="right"))
        yield order[at : max(end, at + 1)]
        at = max(end, at + 1)


@dataclass
class Lattices:
    """Lattices of like length: their rows, lengths, weights (row, start, slot), and the edges' numbers (-1: no edge); `copies` slots a length."""

    rows: np.ndarray
    lengths: np.ndarray
    weights: np.ndarray
    edge: np.ndarray
    copies: int

    def ends(self, x: np.ndarray, rest: float = -np.inf) -> np.ndarray:
        """x (row, node) at the end of each edge (row, start, slot)."""
        k = self.weights.shape[2] // self.copies
        padded = np.pad(x[:, 1:], ((0, 0), (0, k - 1)), constant_values=rest)
        at = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1)
        return at if self.copies == 1 else np.repeat(at, self.copies, axis=2)

    def into(self, x: np.ndarray, j: int) -> np.ndarray:
        """x (row, node, ...) at the start of each edge that ends at node j, and the edge's weight, added up (row, ..., slot)."""
        c, found = self.copies, []
        for d in range(1, min(j, self.weights.shape[2] // c) + 1):
            w = self.weights[:, j - d, (d - 1) * c : d * c]
            found.append(x[:, j - d, ..., None] + (w if x.ndim == 2 else w[:, None]))
        return np.concatenate(found, axis=-1)

    def forward(self) -> np.ndarray:
        b, n, _ = self.weights.shape
        al = np.full((b, n + 1), -np.inf)
        al[:, 0] = 0.0
        for j in range(1, n + 1):
            al[:, j] = lse(self.into(al, j))
        return al

    def backward(self) -> np.ndarray:
        b, n, k = self.weights.shape
        be = np.full((b, n + k + 1), -np.inf)
        for j in range(n, -1, -1):
            if j < n:
                at = be[:, j + 1 : j + 1 + k // self.copies]
                be[:, j] = lse(self.weights[:, j] + (at if self.copies == 1 else np.repeat(at, self.copies, axis=1)))
            be[self.lengths == j, j] = 0.0
        return be[:, : n + 1]

    def all_pairs(self) -> np.ndarray:
        """Z(i -> j), by row, j and i."""
        b, n, _ = self.weights.shape
        z = np.full((b, n + 1, n + 1), -np.inf)
        z[:, 0, 0] = 0.0
        for j in range(1, n + 1):
            z[:, j, :j] = lse(self.into(z[:, :, :j], j))
            z[:, j, j] = 0.0
        return z

    def conditionals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, before, after) for each node: log P(edge | the path visits node), by row, start and slot.

        `before` has the starts below the node, `after` those from the node on; what overlaps the node or is impossible isn't above -Infinity.
        """
        al, be, z = self.forward(), self.backward(), self.all_pairs()
        n = self.weights.shape[1]
        left, right = al[:, :n, None] + self.weights, self.weights + self.ends(be)
        for node in range(n + 1):
            before = left[:, :node] + self.ends(z[:, node])[:, :node] - al[:, node, None, None]
            after = z[:, node:n, node, None] + right[:, node:] - be[:, node, None, None]
            yield node, before, after


def lattices(lengths: np.ndarray, row: np.ndarray, s: np.ndarray, e: np.ndarray, logp: np.ndarray, square: bool = True) -> Iterator[Lattices]:
    """Groups of lattices from their lengths and flat edges; `row` (ascending) is the lattice of each edge."""
    first = np.searchsorted(row, np.arange(len(lengths) + 1))
    for rows in groups(lengths, square):
        sizes = first[rows + 1] - first[rows]
        own = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[rows][own]
        n, k = max(1, int(lengths[rows].max())), int((e[at] - s[at]).max(initial=1))
        place = (own * n + s[at]) * k + (e[at] - s[at] - 1)
        order = np.argsort(place, kind="stable")
        ordered = place[order]
        new = np.flatnonzero(np.diff(ordered, prepend=-1))
        copy = np.empty(len(place), dtype=np.int64)
        copy[order] = np.arange(len(place)) - np.repeat(new, np.diff(new, append=len(place)))
        c = int(copy.max(initial=0)) + 1
        weights, edge = np.full(len(rows) * n * k * c, -np.inf), np.full(len(rows) * n * k * c, -1, dtype=np.int64)
        weights[place * c + copy], edge[place * c + copy] = logp[at], at
        yield Lattices(rows, lengths[rows], weights.reshape(len(rows), n, k * c), edge.reshape(len(rows), n, k * c), c)
