"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np

FIRST = 128  # vectors linked by comparing all of them, before the graph takes over
STEP = 4  # candidates that a search expands at once


class Layer:
    """Neighbours of the nodes of a level: row r of ``links`` has those of node ``nodes[r]``, -1 where there are fewer."""

    def __init__(self, n: int, width: int):
        self.links = np.full((n, width), -1, np.int32)
        self.nodes: np.ndarray = np.zeros(0, np.int64)


class Hnsw:
    """x: unit rows. All similarities are dot products."""

    def __init__(self, x: np.ndarray, m: int = 8, ef: int = 32, seed: int = 7):
        self.x, self.m, self.ef = np.ascontiguousarray(x, np.float32), m, ef
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(m)), 6).astype(int) if n else np.zeros(0, int)
        self.level = level
        self.layers = [Layer(n, 2 * m if k == 0 else m) for k in range(int(level.max(initial=0)) + 1)]
        done, size = 0, FIRST
        while done < n:
            self._insert(np.arange(done, min(n, done + size)))
            done += size
            size = min(max(FIRST, done), 1024)

    def _insert(self, new: np.ndarray) -> None:
        entry: np.ndarray | None = None
        for k in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[k]
            here = new[self.level[new] >= k]
            if len(layer.nodes):
                if entry is None:
                    entry = np.repeat(layer.nodes[None, :1], len(new), 0)
                ids, sims = self._beam(layer, self.x[new], entry, self.ef if k == 0 or len(here) else 8)
                entry = ids[:, :4]
            else:
                ids, sims = np.full((len(new), 0), -1, np.int64), np.zeros((len(new), 0), np.float32)
            if not len(here):
                continue
            rows = np.flatnonzero(self.level[new] >= k)
            own = self.x[here] @ self.x[here].T  # new vectors don't find each other in the graph
            np.fill_diagonal(own, -np.inf)
            take = min(self.ef, len(here))
            near = np.argpartition(-own, take - 1, axis=1)[:, :take] if take < len(here) else np.repeat(np.arange(len(here))[None], len(here), 0)
            cand = np.concatenate([ids[rows], here[near]], 1)
            sim = np.concatenate([sims[rows], np.take_along_axis(own, near, 1)], 1)
            sim = np.where(cand < 0, -np.inf, sim)
            chosen = self._select(cand, sim, layer.links.shape[1])
            layer.links[here] = chosen
            layer.nodes = np.r_[layer.nodes, here]
            self._link_back(layer, here, chosen)

    def _select(self, cand: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates those nearer to the row than to one chosen before; the nearest others fill up."""
        top = min(cand.shape[1], 2 * width)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :top]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        out = np.full((len(cand), width), -1, np.int32)
        for low in range(0, len(cand), 256):
            c, s = cand[low : low + 256], sim[low : low + 256]
            v = self.x[np.maximum(c, 0)]
            among = np.matmul(v, v.transpose(0, 2, 1))
            good = np.zeros(c.shape, bool)
            nearest = np.full(c.shape, -np.inf, np.float32)  # of each candidate, to those chosen
            count = np.zeros(len(c), int)
            for j in range(top):
                ok = np.isfinite(s[:, j]) & (s[:, j] > nearest[:, j]) & (count < width)
                good[:, j] = ok
                count += ok
                nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j]), nearest)
            rank = np.argsort(np.where(good, 0, np.where(np.isfinite(s), 1, 2)), axis=1, kind="stable")[:, :width]
            got = np.take_along_axis(np.where(np.isfinite(s), c, -1), rank, 1)
            out[low : low + 256, : got.shape[1]] = got
        return out

    def _link_back(self, layer: Layer, new: np.ndarray, chosen: np.ndarray) -> None:
        to = chosen.ravel()
        of = np.repeat(new, chosen.shape[1])[to >= 0]
        to = to[to >= 0].astype(np.int64)
        if not len(to):
            return
        sim = np.einsum("ij,ij->i", self.x[of], self.x[to])
        order = np.lexsort((-sim, to))
        of, to = of[order], to[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        width = layer.links.shape[1]
        keep = place < 2 * width
        extra = np.full((len(targets), min(int(count.max()), 2 * width)), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), count)[keep], place[keep]] = of[keep]
        old = layer.links[targets].astype(np.int64)
        extra = np.where((extra[:, :, None] == old[:, None, :]).any(2), -1, extra)
        cand = np.concatenate([old, extra], 1)
        s = np.einsum("ijk,ik->ij", self.x[np.maximum(cand, 0)], self.x[targets])
        layer.links[targets] = self._select(cand, np.where(cand < 0, -np.inf, s), width)

    def _beam(self, layer: Layer, q: np.ndarray, entry: np.ndarray, ef: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found from the entries for each vector of q, best first; -1 where there are fewer. Nodes under
        ``floor`` aren't followed."""
        n = len(self.x)
        rows = np.arange(len(q))
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        open_ = np.zeros((len(q), ef), bool)
        seen = np.zeros((len(q), n), bool)

        def merge(at: np.ndarray, new: np.ndarray) -> None:
            fresh = (new >= 0) & ~seen[at[:, None], np.maximum(new, 0)]
            new = np.where(fresh, new, -1)
            order = np.argsort(new, axis=1)  # the same node from two neighbours counts once
            srt = np.take_along_axis(new, order, 1)
            srt[:, 1:][srt[:, 1:] == srt[:, :-1]] = -1
            a, b = np.nonzero(srt >= 0)
            s = np.full(srt.shape, -np.inf, np.float32)
            s[a, b] = np.einsum("ij,ij->i", q[at[a]], self.x[srt[a, b]])
            seen[at[a], srt[a, b]] = True
            all_s = np.concatenate([sims[at], s], 1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            sims[at] = np.take_along_axis(all_s, best, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], srt], 1), best, 1)
            open_[at] = np.take_along_axis(np.concatenate([open_[at], s >= floor], 1), best, 1) & np.isfinite(sims[at])

        merge(rows, entry)
        while True:
            at = np.flatnonzero(open_.any(1))
            if not len(at):
                return ids, sims
            first = np.argsort(~open_[at], axis=1, kind="stable")[:, :STEP]
            live = np.take_along_axis(open_[at], first, 1)
            node = np.where(live, np.take_along_axis(ids[at], first, 1), -1)
            open_[at[:, None], first] = False
            nbr = np.where(node[:, :, None] >= 0, layer.links[np.maximum(node, 0)], -1).reshape(len(at), -1).astype(np.int64)
            merge(at, nbr)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes near each of any vectors, entered at the top layer, best first; -1 where there are fewer than ef."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.repeat(self.layers[-1].nodes[None, :1], len(q), 0)
        for layer in self.layers[:0:-1]:
            entry = self._beam(layer, q, entry, 8)[0][:, :4]
        return self._beam(self.layers[0], q, entry, ef)

    def neighbours(self, queries: np.ndarray, ef: int | None = None, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Nodes near each of the graph's own nodes ``queries``, themselves excluded, best first; -1 where fewer. Such a
        search begins at the node itself, where a descent would end; it doesn't follow nodes under ``floor``."""
        ids, sims = self._beam(self.layers[0], self.x[queries], queries[:, None], (ef or self.ef) + 1, floor)
        own = ids == queries[:, None]
        sims = np.where(own, -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :-1]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The graph as two arrays: the level of each node, and the neighbours of the nodes, layer by layer."""
        return self.level.astype(np.int8), np.concatenate([layer.links.ravel() for layer in self.layers])

    @classmethod
    def from_flat(cls, x: np.ndarray, level: np.ndarray, links: np.ndarray, m: int = 8) -> "Hnsw":
        out = cls.__new__(cls)
        out.x, out.m, out.ef, out.level = np.ascontiguousarray(x, np.float32), m, 40, level.astype(int)
        out.layers, at, n = [], 0, len(x)
        for k in range(int(out.level.max(initial=0)) + 1):
            layer = Layer(n, 2 * m if k == 0 else m)
            layer.links = links[at : at + layer.links.size].reshape(layer.links.shape)
            layer.nodes = np.flatnonzero(out.level >= k)
            at += layer.links.size
            out.layers.append(layer)
        return out


def sketch(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, dims: int = 128) -> np.ndarray:
    """Dense stand-ins of n sparse vectors: each term adds to two dimensions, with signs its hash gives."""
    x = np.zeros((n, dims), np.float32)
    h = term.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for k, mult in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            g = h * np.uint64(mult)
            g ^= g >> np.uint64(31)
            sign = np.where((g >> np.uint64(5)) & np.uint64(1), 1.0, -1.0)
            np.add.at(x, (row, ((g >> np.uint64(11)) % np.uint64(dims)).astype(int)), (w * sign).astype(np.float32))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def exact_dots(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the sparse rows a and b; entries come by row."""
    if not len(a):
        return np.zeros(0)
    local = np.unique(term, return_inverse=True)[1].astype(np.int64)
    width = int(local.max(initial=0)) + 1
    key = row * width + local
    order = np.argsort(key)
    key, val = key[order], w[order]
    start = np.searchsorted(row, np.arange(n + 1))
    count = (start[1:] - start[:-1])[a]
    pair = np.repeat(np.arange(len(a)), count)
    entry = start[a][pair] + np.arange(len(pair)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    want = b[pair] * width + local[entry]
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.bincount(pair, np.where(key[at] == want, w[entry] * val[at], 0.0), len(a))
