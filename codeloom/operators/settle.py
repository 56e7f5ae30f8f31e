"""Moves of graph nodes between communities, one node after the other, for links that fit one task.

All sums are whole numbers, so gains are exact.  Nodes are asked in the order of their numbers and links are sorted, so
that what comes out doesn't depend on partitions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries that are summed up at once where groups become nodes.
CHUNK = 1 << 20


class Links:
    """Neighbours of nodes 0..n-1: those of ``u`` are ``near[start[u]:start[u + 1]]``, with their weights; own: a node's weight to itself."""

    def __init__(self, start: np.ndarray, near: np.ndarray, weights: np.ndarray, own: np.ndarray) -> None:
        self.start, self.near, self.weights, self.own = start, near, weights, own

    def strength(self) -> np.ndarray:
        sums = np.zeros(len(self.own), dtype=np.int64)
        for a, b, at in self._chunks():
            sums[a:b] = np.bincount(at - a, self.weights[self.start[a] : self.start[b]], b - a).astype(np.int64)
        return sums + 2 * self.own

    def _chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, end, the node of each entry) of runs of nodes with about CHUNK entries."""
        a, n = 0, len(self.own)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.start, self.start[a] + CHUNK, "right")) - 1))
            yield a, b, np.repeat(np.arange(a, b), np.diff(self.start[a : b + 1]))
            a = b

    def merged(self, group: np.ndarray, n: int) -> Links:
        """The same with groups 0..n-1 as nodes."""
        keys, sums = [], []
        for a, b, at in self._chunks():
            key = group[at] * n + group[self.near[self.start[a] : self.start[b]]]
            found, place = np.unique(key, return_inverse=True)
            keys.append(found)
            sums.append(np.bincount(place, self.weights[self.start[a] : self.start[b]], len(found)).astype(np.int64))
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, place, np.concatenate(sums))
        u, v = found // n, found % n
        same, own = u == v, np.zeros(n, dtype=np.int64)
        np.add.at(own, group, self.own)
        own[u[same]] += total[same] // 2  # such a link was met from both its ends
        return Links(np.concatenate([[0], np.cumsum(np.bincount(u[~same], minlength=n))]), v[~same].astype(np.int32), total[~same], own)


def settle(links: Links, strength: np.ndarray, group: np.ndarray, total: int, rounds: int) -> tuple[np.ndarray, bool, bool]:
    """Groups after all moves that raise the modularity, whether any was made, and whether none is left.

    A node goes to the neighbour group of greatest gain, of equals to the smallest; it stays where none is above zero.
    Nodes whose neighbours moved are asked again; when there are none left a further round asks all, as a move also
    changes what its groups weigh to others.  Every move raises the modularity, so this ends.
    """
    n, near, weights = len(group), links.near, links.weights
    start, k, at = links.start.tolist(), strength.tolist(), group.tolist()
    even = bool(len(weights)) and int(weights.min()) == int(weights.max()) == 1
    weight = np.zeros(n, dtype=np.int64)
    np.add.at(weight, group, strength)
    weight, twice, any_move = weight.tolist(), 2 * int(total), False
    for _ in range(rounds):
        asked, waits, moved = deque(range(n)), bytearray(b"\1") * n, False
        while asked:
            u = asked.popleft()
            waits[u] = 0
            a, b = start[u], start[u + 1]
            others, toward = near[a:b].tolist(), {}
            if even:
                for v in others:
                    c = at[v]
                    toward[c] = toward.get(c, 0) + 1
            else:
                for v, w in zip(others, weights[a:b].tolist(), strict=True):
                    c = at[v]
                    toward[c] = toward.get(c, 0) + w
            now, own = at[u], k[u]
            stay = twice * toward.get(now, 0) - own * (weight[now] - own)
            best, most = now, stay
            for c, w in toward.items():
                gain = twice * w - own * weight[c]
                if (gain > most or (gain == most and c < best and most > stay)) and c != now:
                    best, most = c, gain
            if best != now:
                weight[now] -= own
                weight[best] += own
                at[u], moved = best, True
                for v in others:
                    if not waits[v] and at[v] != best:
                        waits[v] = 1
                        asked.append(v)
        if not moved:
            return np.array(at, dtype=np.int64), any_move, True
        any_move = True
    return np.array(at, dtype=np.int64), any_move, False


def cluster(base: Links, total: int, levels: int, rounds: int) -> tuple[np.ndarray, bool]:
    """The group of each node after all levels, and whether they settled: then neither a node nor a group has a move with a gain.

    After the last level nodes are asked again, from the groups they are in; where some move, levels follow anew.
    """
    strength, groups = base.strength(), np.arange(len(base.own))
    for _ in range(rounds):
        groups, moved, settled = settle(base, strength, groups, total, rounds)
        if not settled or not moved:
            return groups, settled
        links, at = base, groups
        for _ in range(levels):
            kept, at = np.unique(at, return_inverse=True)
            groups = at if links is base else at[groups]
            links = links.merged(at, len(kept))
            at, moved, settled = settle(links, links.strength(), np.arange(len(kept)), total, rounds)
            if not settled:
                return groups, False
            if not moved:
                break
        else:
            return groups, False
    return groups, False


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, Links, np.ndarray] | None:
    """Nodes, their links and, per node, what column c says, from rows (u, v, w, c) sorted by u and v; c stands on the rows of nodes with themselves."""
    first, counts, near, weights, loops = [], [], [], [], []
    for batch in batches:
        u, v, w = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("u", "v", "w"))
        same = u == v
        if same.any():
            loops.append((u[same], w[same], batch.column("c").fill_null(0).to_numpy(zero_copy_only=False)[same]))
        u, v, w = u[~same], v[~same], w[~same]
        if len(u):
            values, sizes = np.unique(u, return_counts=True)
            first.append(values)
            counts.append(sizes)
            near.append(v.astype(np.int32))
            weights.append(w.astype(np.min_scalar_type(int(w.max()))))
    if not first and not loops:
        return None
    none = np.zeros(0, dtype=np.int64)
    own_u, own_w, own_c = (np.concatenate([none, *[x[i] for x in loops]]) for i in range(3))
    first, counts = np.concatenate([none, *first]), np.concatenate([none, *counts])
    nodes = np.unique(np.concatenate([first, own_u]))
    place = np.zeros(int(nodes[-1]) + 1, dtype=np.int32)
    place[nodes] = np.arange(len(nodes), dtype=np.int32)
    sizes = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(sizes, place[first], counts)
    near = np.concatenate([np.zeros(0, dtype=np.int32), *near])
    weights = np.concatenate([np.zeros(0, dtype=np.uint8), *weights])
    for a in range(0, len(near), CHUNK):
        near[a : a + CHUNK] = place[near[a : a + CHUNK]]
    own, marks = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    own[place[own_u]], marks[place[own_u]] = own_w, own_c
    return nodes, Links(np.concatenate([[0], np.cumsum(sizes)]), near, weights, own), marks


def _answer(nodes: np.ndarray, groups: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(nodes), CHUNK):
        part = nodes[a : a + CHUNK].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(groups[a : a + CHUNK].astype(np.int32)), pa.array(np.full(len(part), settled))], ["n", "c", "settled"])


def levels_of(total: int, levels: int, rounds: int):
    """A function of the rows of all links, both ways, that gives (n, c, settled): communities after all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        if read is None:
            return
        nodes, links, _ = read
        groups, settled = cluster(links, total, levels, rounds)
        yield from _answer(nodes, groups, settled)

    return run


def block_of(total: int, rounds: int):
    """A function of the rows of some communities, whole, with the links among them, that gives (n, c, settled) after moves among these.

    A node's row with itself has its strength as weight, and its community.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        if read is None:
            return
        nodes, links, marks = read
        names, group = np.unique(marks, return_inverse=True)
        own, _, settled = settle(links, links.own, group, total, rounds)
        yield from _answer(nodes, names[own], settled)

    return run
