"""A hierarchical navigable small-world graph of one shard, as flat neighbour arrays.

Rows are inserted in batches, a whole batch walking the graph in step: each walk keeps
a beam of the ``ef`` most similar rows seen, expands the best one not yet expanded and
ends when all are.  What a row finds on insertion are its neighbours among the earlier
rows and, by one matrix product, in its batch.  Later rows find it in turn only as far
as their beams reach, so each row is also asked of the finished graph (``search`` with
``start``), the walk starting at itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


#: A layer of at most so many rows, above the bottom, is searched whole, by one product.
FLAT = 1024
#: Pairs of vectors multiplied at a time, and rows whose candidates are compared at a time, so that buffers stay small.
PART, ROWS = 1024, 64


class Layer:
    """One layer of the graph: ``links[i]`` holds up to ``cap`` neighbours of row i, -1 where none."""

    def __init__(self, rows: int, cap: int):
        self.links = np.full((rows, cap), -1, np.int32)
        self.degree = np.zeros(rows, np.int32)


def dots(q: np.ndarray, who: np.ndarray, x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``q[who] . x[which]``, a part at a time through two buffers that stay in the processor's cache."""
    out = np.empty(len(who), np.float32)
    a, b = (np.empty((min(PART, len(who)), x.shape[1]), np.float32) for _ in range(2))
    for i in range(0, len(who), PART):
        n = min(PART, len(who) - i)
        np.take(q, who[i : i + n], 0, out=a[:n], mode="clip")
        np.take(x, which[i : i + n], 0, out=b[:n], mode="clip")
        np.einsum("ij,ij->i", a[:n], b[:n], out=out[i : i + n])
    return out


def walk(x: np.ndarray, layer: Layer, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``ef`` best rows (-1 where fewer) and their similarities, unordered."""
    b, n = len(q), len(x)
    ids = np.full((b, ef), -1, np.int32)
    sims = np.full((b, ef), -2.0, np.float32)
    done = np.ones((b, ef), bool)
    seen = np.zeros((b, n + 1), bool)  # the first column stands for no row, -1
    seen[:, 0] = True
    rows = np.arange(b)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", q, x[entry]), False
    seen[rows, entry + 1] = True
    out_ids, out_sims = ids.copy(), sims.copy()
    live = rows
    cap = layer.links.shape[1]
    flat = seen.ravel()
    while len(live):
        best = np.where(done, np.float32(-3.0), sims).argmax(1)
        at = np.arange(len(live))
        stop = done[at, best]
        if stop.any():
            out_ids[live[stop]], out_sims[live[stop]] = ids[stop], sims[stop]
            go = np.flatnonzero(~stop)
            live, ids, sims, done, best = live[go], ids.take(go, 0), sims.take(go, 0), done.take(go, 0), best[go]
            if not len(live):
                break
            at = at[: len(live)]
        done[at, best] = True
        near = layer.links.take(ids[at, best], 0)
        place = (live[:, None] * (n + 1) + 1 + near).ravel()
        spot = np.flatnonzero(~flat.take(place))
        flat[place.take(spot)] = True
        value = np.full(len(live) * cap, -2.0, np.float32)
        value[spot] = dots(q, live.take(spot // cap), x, near.ravel().take(spot))
        value = value.reshape(-1, cap)
        # beams into which something new comes
        up = np.flatnonzero(value.max(1) > sims.min(1))
        value = value.take(up, 0)
        fresh = value > -2.0
        both = np.concatenate([sims.take(up, 0), value], 1)
        keep = np.argpartition(both, cap, axis=1)[:, cap:] + (at[: len(up)] * (ef + cap))[:, None]
        sims[up] = both.take(keep)
        ids[up] = np.concatenate([ids.take(up, 0), np.where(fresh, near.take(up, 0), -1)], 1).take(keep)
        done[up] = np.concatenate([done.take(up, 0), ~fresh], 1).take(keep)
    return out_ids, out_sims


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, up to ``most`` of which none is nearer to an already chosen one than to the row."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    b, c = ids.shape
    between = np.empty((b, c, c), np.float32)
    for i in range(0, b, ROWS):
        vec = x[np.maximum(ids[i : i + ROWS], 0)]
        np.matmul(vec, vec.transpose(0, 2, 1), out=between[i : i + ROWS])
    nearest = np.full((b, c), -2.0, np.float32)  # similarity of each candidate to the chosen ones
    taken = np.zeros((b, c), bool)
    count = np.zeros(b, np.int32)
    for j in range(c):
        take = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > nearest[:, j])
        taken[:, j] = take
        count += take
        at = np.flatnonzero(take)
        nearest[at, j + 1 :] = np.maximum(nearest[at, j + 1 :], between[at, j, j + 1 :])
    # fill up with the nearest of those passed over
    spare = (~taken) & (ids >= 0)
    room = most - count
    taken |= spare & (np.cumsum(spare, 1) <= room[:, None] // 2)
    rank = np.cumsum(taken, 1) - 1
    out = np.full((b, most), -1, np.int32)
    r, cc = np.nonzero(taken)
    out[r, rank[r, cc]] = ids[r, cc]
    return out


class Graph:
    """Insert unit vectors in order of their rows; ``insert_all`` yields what each batch found."""

    def __init__(self, x: np.ndarray, m: int = 8, ef: int = 20, batch: int = 512, seed: int = 1):
        self.x, self.m, self.ef, self.batch = np.ascontiguousarray(x, np.float32), m, ef, batch
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = (-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int)
        # rows of high layers come first, so that the layers above are there when the bottom fills
        self.order = np.argsort(-level, kind="stable")
        self.level = level[self.order]
        self.x = self.x[self.order]
        self.layers = [Layer(int((self.level >= k).sum()), 2 * m) for k in range((int(self.level.max()) if n else 0) + 1)]
        # from this layer on one product finds the best row, so no links are made
        self.flat = next((k for k in range(1, len(self.layers)) if len(self.layers[k].links) <= FLAT), len(self.layers))

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The entry into layer ``to`` for each query: the best row of the first flat layer, then greedy steps through those below it."""
        top = self.flat
        entry = self._first(q, len(self.layers[top].links) if top < len(self.layers) else 1)
        for k in range(top - 1, to, -1):
            ids, sims = walk(self.x[: len(self.layers[k].links)], self.layers[k], q, entry, 4)
            entry = ids[np.arange(len(q)), sims.argmax(1)]
        return entry

    def _first(self, q: np.ndarray, rows: int) -> np.ndarray:
        """For each query the most similar of the first ``rows`` rows."""
        return (q @ self.x[:rows].T).argmax(1).astype(np.int32)

    def search(self, q: np.ndarray, ef: int | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows (in the order given to the graph) and similarities found for each query; ``start`` are rows in the graph's order."""
        if not len(self.x):
            return np.full((len(q), 1), -1), np.full((len(q), 1), -2.0)
        ids, sims = walk(self.x, self.layers[0], q, self._descend(q, 0) if start is None else start.astype(np.int32), ef or self.ef)
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims

    def insert_all(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Build all layers; yields (row, row, similarity) of the pairs of at least ``least`` seen at the bottom."""
        for k in range(self.flat - 1, -1, -1):
            rows = len(self.layers[k].links)
            start = 0
            while start < rows:
                end = min(rows, start + (256 if not start else min(self.batch, start)))
                a, b, s = self._insert(k, start, end, least)
                if not k and len(a):
                    yield self.order[a], self.order[b], s
                start = end

    def _insert(self, k: int, start: int, end: int, least: float):
        layer, x = self.layers[k], self.x
        q = x[start:end]
        within = q @ q.T
        np.fill_diagonal(within, -2.0)
        r, c = np.divmod(np.flatnonzero(within >= least), end - start)
        r, c = r[r < c], c[r < c]
        pairs = [(r + start, c + start, within[r, c])]
        mates = min(12, end - start - 1)
        ids = np.full((end - start, 0), -1, np.int32)
        sims = np.zeros((end - start, 0), np.float32)
        if mates > 0:
            top = np.argpartition(within, -mates, axis=1)[:, -mates:]
            ids, sims = (top + start).astype(np.int32), np.take_along_axis(within, top, 1)
        if start:
            # the rows of the layer above come first here too; until they are all in, walks start at the best of the first rows
            above = len(self.layers[k + 1].links) if k + 1 < len(self.layers) else start + 1
            entry = self._descend(q, k) if start >= above else self._first(q, min(start, FLAT))
            seen_ids, seen_sims = walk(x[:start], layer, q, entry, self.ef)
            r, c = np.nonzero(seen_sims >= least)
            pairs.append((seen_ids[r, c], r + start, seen_sims[r, c]))
            ids, sims = np.concatenate([ids, seen_ids], 1), np.concatenate([sims, seen_sims], 1)
        if ids.shape[1]:
            chosen = choose(x, ids, sims, self.m)
            layer.links[start:end, : self.m] = chosen
            layer.degree[start:end] = (chosen >= 0).sum(1)
            r, c = np.nonzero(chosen >= 0)
            self._link_back(layer, chosen[r, c], (r + start).astype(np.int32))
        return tuple(np.concatenate([p[i] for p in pairs]) for i in range(3))

    def _link_back(self, layer: Layer, to: np.ndarray, new: np.ndarray) -> None:
        cap = layer.links.shape[1]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        there = (layer.links[to] == new[:, None]).any(1)
        to, new = to[~there], new[~there]
        if not len(to):
            return
        first = np.r_[True, to[1:] != to[:-1]]
        rank = np.arange(len(to)) - np.maximum.accumulate(np.where(first, np.arange(len(to)), 0))
        slot = layer.degree[to] + rank
        fits = slot < cap
        layer.links[to[fits], slot[fits]] = new[fits]
        np.add.at(layer.degree, to[fits], 1)
        if fits.all():
            return
        # what doesn't fit is chosen anew, among the links there are and the most similar of the others
        over, extra = to[~fits], new[~fits]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[over], self.x[extra]), over))
        over, extra = over[order], extra[order]
        rows, at = np.unique(over, return_inverse=True)
        k = np.arange(len(over)) - np.searchsorted(over, over)
        wide = min(int(k.max()) + 1, 64)
        ids = np.full((len(rows), cap + wide), -1, np.int32)
        ids[:, :cap] = layer.links[rows]
        some = k < wide
        ids[at[some], cap + k[some]] = extra[some]
        sims = np.einsum("ij,ikj->ik", self.x[rows], self.x[np.maximum(ids, 0)])
        sims[ids < 0] = -2.0
        kept = choose(self.x, ids, sims, cap)
        layer.links[rows] = kept
        layer.degree[rows] = (kept >= 0).sum(1)
