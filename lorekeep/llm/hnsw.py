"""Hierarchical navigable small-world graphs over one shard of unit vectors, in flat NumPy arrays.

Built by insertion: nodes come in random order, in batches no larger than half of the nodes already there.  A batch
searches the graph of the earlier nodes, level by level from the top; of the candidates met a diversity rule keeps the
``m`` to link to (one closer to a kept neighbour than to the node stands behind those that are not).  Links run
both ways; a node with more than ``2 m`` keeps the best by the same rule.  In the end every node searches the whole
graph once more and adds what it meets, so nodes of one batch are linked as well.  No block of all pairs is
computed.  A level's neighbours are one int32 array of shape (nodes, 2 m), -1 where empty.  Searches run for a
block of queries in lockstep.
"""

from __future__ import annotations

import numpy as np

#: Nodes that a search starts from at the top.
ENTRIES = 32


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The first m of each node's candidates, those not covered by a nearer kept one first.

    ``ids`` (nodes, candidates) with -1 for none, ``sims`` their cosines, best first; returns both cut to m.
    """
    n, k = ids.shape
    out, val = np.full((n, m), -1, np.int32), np.full((n, m), -np.inf, np.float32)
    for s in range(0, n, block):
        c, v = ids[s : s + block], sims[s : s + block]
        xc = x[c]
        between = xc @ xc.transpose(0, 2, 1)
        kept = c >= 0
        for j in range(2, k):  # the first two always stay, so tight groups hold together
            kept[:, j] &= ~(kept[:, :j] & (between[:, j, :j] > v[:, j, None])).any(1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :m]
        out[s : s + block, : order.shape[1]] = np.take_along_axis(c, order, 1)
        val[s : s + block, : order.shape[1]] = np.take_along_axis(v, order, 1)
    return out, val


class _Level:
    """Neighbours of the nodes of one level; nodes are numbered within the level in order of insertion."""

    def __init__(self, x: np.ndarray, width: int):
        self.x, self.width = x, width
        self.near, self.sims = np.full((len(x), width), -1, np.int32), np.full((len(x), width), -np.inf, np.float32)

    def link(self, src: np.ndarray, dst: np.ndarray, sims: np.ndarray) -> None:
        """Add the edges src -> dst; a node with too many keeps the best by the diversity rule."""
        own = self.near[nodes := np.unique(src)]
        a = np.concatenate([np.repeat(nodes, self.width), src])
        b = np.concatenate([own.ravel(), dst])
        v = np.concatenate([self.sims[nodes].ravel(), sims])
        ok = (b >= 0) & (a != b)
        a, b, v = a[ok], b[ok], v[ok]
        o = np.lexsort((b, -v, a))
        a, b, v = a[o], b[o], v[o]
        # a repeated edge has the same cosine but for rounding: drop by pair
        _, first = np.unique(a.astype(np.int64) << 32 | b, return_index=True)
        first.sort()
        a, b, v = a[first], b[first], v[first]
        start = np.searchsorted(a, nodes)
        count = np.diff(np.append(start, len(a)))
        most = min(int(count.max(initial=0)), 2 * self.width)
        ids, val = np.full((len(nodes), max(most, self.width)), -1, np.int32), np.full((len(nodes), max(most, self.width)), -np.inf, np.float32)
        place = np.arange(len(a)) - np.repeat(start, count)
        fits = place < most
        row = np.repeat(np.arange(len(nodes)), count)
        ids[row[fits], place[fits]], val[row[fits], place[fits]] = b[fits], v[fits]
        full = np.flatnonzero(count > self.width)
        if len(full):
            i, s = _diverse(self.x, ids[full], val[full], self.width)
            ids[full, : self.width], val[full, : self.width] = i, s
        self.near[nodes], self.sims[nodes] = ids[:, : self.width], val[:, : self.width]

    def both(self, src: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link each of src with its row of ids, both ways."""
        a, b, v = np.repeat(src, ids.shape[1]), ids.ravel(), sims.ravel()
        ok = b >= 0
        a, b, v = a[ok], b[ok], v[ok]
        if len(a):
            self.link(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v]))

    def walk(self, q: np.ndarray, at: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node each query reaches by always moving to the best neighbour."""
        moving = np.arange(len(q))
        while len(moving):
            c = self.near[at[moving]]
            s = np.einsum("bd,bmd->bm", q[moving], self.x[c])
            s[c < 0] = -np.inf
            j = s.argmax(1)
            b = s[np.arange(len(moving)), j]
            up = b > val[moving]
            moving, j, b, c = moving[up], j[up], b[up], c[up]
            at[moving], val[moving] = c[np.arange(len(moving)), j], b
        return at, val

    def beam(self, q: np.ndarray, at: np.ndarray, val: np.ndarray, ef: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the ``ef`` best nodes met by best-first search from ``at``, of the first ``known`` nodes."""
        n = len(q)
        ids, sims = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32)
        done, seen = np.zeros((n, ef), bool), np.zeros((n, known), bool)
        ids[:, 0], sims[:, 0] = at, val
        seen[np.arange(n), at] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            j = open_.argmax(1)
            more = open_[np.arange(len(live)), j] > -np.inf
            live, j = live[more], j[more]
            done[live, j] = True
            c = self.near[ids[live, j]]
            fresh = (c >= 0) & ~seen[live[:, None], c]
            r, p = np.nonzero(fresh)
            if not len(r):
                continue
            nodes, rows = c[r, p], live[r]
            seen[rows, nodes] = True
            s = np.full(c.shape, -np.inf, np.float32)
            s[r, p] = np.einsum("rd,rd->r", q[rows], self.x[nodes])
            s[s <= sims[live, -1][:, None]] = -np.inf
            hit = np.flatnonzero((s > -np.inf).any(1))
            if not len(hit):
                continue
            rows = live[hit]
            every = np.concatenate([sims[rows], s[hit]], 1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :ef]
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], c[hit]], 1), order, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(s[hit].shape, bool)], 1), order, 1)
            sims[rows] = np.take_along_axis(every, order, 1)
        return np.where(sims > -np.inf, ids, -1), sims


class Graph:
    """A searchable graph over ``x``, rows of unit length."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 16, seed: int = 7):
        n = len(x)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n).astype(np.int32)  # node -> row
        self.node = np.empty(n, np.int32)  # row -> node
        self.node[self.order] = np.arange(n, dtype=np.int32)
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        height = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(m)).astype(int), 6)
        #: Nodes of each level above the lowest, and where they stand on the level below.
        self.levels = [_Level(self.x, 2 * m)] if n else []
        self.members = [np.arange(n, dtype=np.int32)]
        while len(own := np.flatnonzero(height >= len(self.levels))) > ENTRIES:
            self.members.append(own.astype(np.int32))
            self.levels.append(_Level(self.x[own], 2 * m))
        begun = 0
        while begun < n:
            end = min(n, begun + max(1, begun // 2))
            self._insert(begun, end, m, ef)
            begun = end
        self.filled = n
        if n > 2:  # what nodes of one batch did not know of each other
            for s in range(0, n, 512):
                own = np.arange(s, min(n, s + 512))
                i, v = self.levels[0].beam(self.x[own], own.astype(np.int32), np.ones(len(own), np.float32), ef, n)
                v[i == own[:, None]] = -np.inf
                o = np.argsort(-v, axis=1, kind="stable")
                i, v = np.take_along_axis(np.where(v > -np.inf, i, -1), o, 1), np.take_along_axis(v, o, 1)
                self.levels[0].both(own, *_diverse(self.x, i, v, m))

    def _insert(self, begun: int, end: int, m: int, ef: int, block: int = 512) -> None:
        """Link the nodes from ``begun`` to ``end`` with the earlier ones, on every level they are on."""
        self.filled = begun
        found = []
        for level in range(len(self.levels)):
            nodes = self.members[level]
            a, b = np.searchsorted(nodes, begun), np.searchsorted(nodes, end)
            for s in range(a, b, block) if a else ():
                own = np.arange(s, min(b, s + block))
                q = self.levels[level].x[own]
                at, val = self._descend(q, level)
                i, v = self.levels[level].beam(q, at, val, ef, a)
                found.append((level, own, *_diverse(self.levels[level].x, i, v, m)))
        for level, own, i, v in found:
            self.levels[level].both(own, i, v)

    def _descend(self, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of ``level`` from which each query's search starts."""
        top = len(self.levels) - 1
        while top > level and not np.searchsorted(self.members[top], self.filled):
            top -= 1
        there = min(ENTRIES, int(np.searchsorted(self.members[top], self.filled)))
        g = q @ self.levels[top].x[:there].T
        at = g.argmax(1).astype(np.int32)
        val = g[np.arange(len(q)), at]
        while top > level:
            at, val = self.levels[top].walk(q, at, val)
            at = np.searchsorted(self.members[top - 1], self.members[top][at]).astype(np.int32)
            top -= 1
        return at, val

    def search(self, q: np.ndarray, k: int, ef: int = 32, own: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines), each (queries, k), best first, -1 and -inf where there are fewer.

        ``own``: the row that each query is, if it is one of the graph's; its search starts there.
        """
        ids, sims = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        for s in range(0, len(q) if self.filled else 0, block):
            part = np.ascontiguousarray(q[s : s + block], dtype=np.float32)
            if own is None:
                at, val = self._descend(part, 0)
            else:
                at = self.node[own[s : s + block]]
                val = np.einsum("rd,rd->r", part, self.x[at])
            i, v = self.levels[0].beam(part, at, val, max(ef, k), self.filled)
            ids[s : s + block, : i.shape[1]] = np.where(i >= 0, self.order[i], -1)[:, :k]
            sims[s : s + block, : v.shape[1]] = v[:, :k]
        return ids, sims
