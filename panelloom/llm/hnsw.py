"""A navigable small-world graph in layers, built and searched for many vectors at once with numpy."""

from __future__ import annotations

import numpy as np

#: entries of a batch's table of visited nodes
VISITED = 1 << 25


def _rank(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Graph:
    """Unit vectors in rows; nodes of the higher layers come first, so layer l holds the first sizes[l] nodes.

    links[l] has the neighbours of a node in layer l, padded with -1.
    """

    def __init__(self, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.vectors, self.sizes, self.links = vectors, sizes, links

    @staticmethod
    def layers(n: int, degree: int) -> list[int]:
        """Each layer has 1/degree of the nodes of the layer below."""
        sizes = [n]
        while sizes[-1] > 4 * degree:
            sizes.append(sizes[-1] // degree)
        return sizes

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = 12, beam: int = 48) -> Graph:
        """vectors in random order. Batches grow with the graph; nodes of a batch also see each other."""
        n = len(vectors)
        sizes = cls.layers(n, degree)
        links = [np.full((size, 2 * degree), -1, np.int32) for size in sizes]
        graph = cls(vectors, sizes, links)
        for layer in range(len(sizes) - 1, -1, -1):
            # the layer's nodes, the upper layers' included, go in from the first: entry points come from above
            done = 0
            while done < sizes[layer]:
                batch = np.arange(done, min(sizes[layer], done + max(2 * degree, min(1024, done // 4))))
                graph._insert(layer, batch, done, degree, beam)
                done = batch[-1] + 1
        graph._answer()
        graph._connect()
        return graph

    def _answer(self, least: int = 3) -> None:
        """Adds links back from the two nearest neighbours of each node, and the third where `least` are not
        reached: a node to which only far ones link is not found from near."""
        links, n = self.links[0], self.sizes[0]
        wide = links
        back = np.zeros(n, np.int64)
        for at in range(0, n, 4096):
            own = links[at : at + 4096]
            back[at : at + 4096] = ((links[own] == np.arange(at, at + len(own))[:, None, None]).any(axis=2) & (own >= 0)).sum(axis=1)
        for rank in range(least):
            lone = np.flatnonzero(((back < least) | (rank < 2)) & (links[:, rank] >= 0))
            lone = lone[~(links[links[lone, rank]] == lone[:, None]).any(axis=1)]
            if not len(lone):
                continue
            # several with the same neighbour make a chain from it, as each row has room for one link
            lone = lone[np.argsort(links[lone, rank], kind="stable")]
            near = links[lone, rank]
            head = np.concatenate([[True], near[1:] != near[:-1]])
            columns = np.full((n, 2), -1, np.int32)
            columns[near[head], 0] = lone[head]
            columns[lone[:-1][~head[1:]], 1] = lone[~head]
            wide = np.hstack([wide, columns])
            back[lone] += 1
        self.links[0] = wide

    def _connect(self) -> None:
        """Adds links, until every node can be reached over the lowest layer from the first one: pruning may
        have taken the last link to a node."""
        links, n = self.links[0], self.sizes[0]
        reached = np.zeros(n, bool)
        front = np.array([0][:n], np.int64)
        while True:
            while len(front):
                reached[front] = True
                after = np.unique(links[front])
                front = after[(after >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                self.links[0] = links
                return
            # each lost node with a reached neighbour gets a link from it; if none has one, the first from node 0
            near = links[lost]
            ok = (near >= 0) & reached[near]
            some = ok.any(axis=1)
            at, to = (near[some, ok[some].argmax(axis=1)], lost[some]) if some.any() else (np.array([0]), lost[:1])
            at, first = np.unique(at, return_index=True)
            column = np.full((n, 1), -1, np.int32)
            column[at, 0] = to[first]
            links = np.hstack([links, column])
            front = to[first]

    def _insert(self, layer: int, batch: np.ndarray, done: int, degree: int, beam: int) -> None:
        vectors = self.vectors[batch]
        among = vectors @ vectors.T
        among[np.triu_indices(len(batch))] = -np.inf  # each sees those before it
        sims, ids = among, np.broadcast_to(batch, among.shape)
        if done:
            above, found = self._search(vectors, beam, layer, done)
            sims, ids = np.hstack([above, sims]), np.hstack([found, ids])
        sims, ids = _rank(sims, ids, min(beam, sims.shape[1]))
        ids = np.where(np.isfinite(sims), ids, -1)
        chosen = self._diverse(ids, sims, degree)
        self.links[layer][batch, : chosen.shape[1]] = chosen
        # and back: the new links of each neighbour, its old ones kept if there is room, else the diverse ones
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        old = self.links[layer][nodes]
        extra = np.full((len(nodes), counts.max()), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for at in range(0, len(nodes), 512):
            part = nodes[at : at + 512]
            both = np.hstack([old[at : at + 512], extra[at : at + 512]])
            sims = np.where(both >= 0, np.einsum("bd,bkd->bk", self.vectors[part], self.vectors[both]), -np.inf)
            sims, both = _rank(sims, both, both.shape[1])
            full = (both >= 0).sum(axis=1) > 2 * degree
            new = both[:, : 2 * degree].copy()
            if full.any():
                width = min(both.shape[1], 6 * degree)
                kept = self._diverse(both[full][:, :width], sims[full][:, :width], 2 * degree)
                new[full] = -1
                new[np.flatnonzero(full)[:, None], np.arange(kept.shape[1])] = kept
            self.links[layer][part, : new.shape[1]] = new

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, those that are nearer to the row's vector than to any
        chosen before; free places go to the best of the others. So tight groups keep ways out."""
        found = self.vectors[ids]
        between = np.einsum("bid,bjd->bij", found, found)
        rows = np.arange(len(ids))
        nearest = np.full(ids.shape, -np.inf, np.float32)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            take = (ids[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            nearest = np.where(take[:, None], np.maximum(nearest, between[rows, :, j]), nearest)
        order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1)

    def _search(self, queries: np.ndarray, beam: int, layer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes found among the first n of a layer, best first: similarities and ids."""
        step = max(1, min(1024, VISITED // max(n, 1), VISITED // (16 * beam)))
        parts = [self._walk(queries[at : at + step], beam, layer, n) for at in range(0, len(queries), step)]
        return np.vstack([s for s, _ in parts]), np.vstack([i for _, i in parts])

    def _walk(self, queries: np.ndarray, beam: int, layer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.sizes) - 1
        if layer == top:
            entry = np.zeros((len(queries), 1), np.int32)
        else:
            _, entry = self._walk(queries, 4, layer + 1, self.sizes[layer + 1])
            # while a layer is being filled, nodes from above that it doesn't hold yet are no entries
            entry = np.where((entry >= 0) & (entry < n), entry, -1)
            entry[:, 0] = np.where((entry < 0).all(axis=1), 0, entry[:, 0])
        links, rows = self.links[layer], np.arange(len(queries))
        seen = np.zeros((len(queries), n + 1), bool)  # the last column is for padding
        ids = np.full((len(queries), beam), -1, np.int32)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        open_ = np.zeros((len(queries), beam), bool)
        active, new = rows, entry
        wide = 4
        while len(active):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[active[:, None], new]] = -1
            seen[active[:, None], new] = True
            near = np.where(new >= 0, np.einsum("bd,bkd->bk", queries[active], self.vectors[new]), -np.inf).astype(np.float32)
            s = np.hstack([sims[active], near])
            i = np.hstack([ids[active], new])
            o = np.hstack([open_[active], new >= 0])
            if s.shape[1] > beam:
                at = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
                s, i, o = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1), np.take_along_axis(o, at, 1)
            # the best open nodes of each beam are expanded together
            k = min(wide, beam)
            best = np.where(o, s, -np.inf)
            at = np.argpartition(-best, k - 1, axis=1)[:, :k]
            go = np.take_along_axis(o, at, 1)
            np.put_along_axis(o, at, False, 1)
            sims[active], ids[active], open_[active] = s, i, o
            nodes = np.where(go, np.take_along_axis(i, at, 1), -1)
            more = go.any(axis=1)
            active, nodes = active[more], nodes[more]
            new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(nodes), k * links.shape[1])
            new = np.where(new < n, new, -1)
        return _rank(sims, ids, beam)

    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Per query the nodes found with similarity >= least. A beam whose worst node is still that near is
        doubled; one that would hold a quarter of the graph gives way to a scan of the whole graph."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        left, n = np.arange(len(queries)), self.sizes[0]
        while len(left) and beam * 4 < n:
            sims, ids = self._search(queries[left], beam, 0, n)
            for row, s, i in zip(left, sims, ids):
                out[row] = i[s >= least]
            left, beam = left[sims[:, -1] >= least], beam * 2
        for row, found in zip(left, self.scan(queries[left], least)):
            out[row] = found
        return out

    def scan(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """Per query all nodes with similarity >= least."""
        step = max(1, VISITED // (4 * max(1, len(self.vectors))))
        return [np.flatnonzero(s >= least) for at in range(0, len(queries), step) for s in queries[at : at + step] @ self.vectors.T]
