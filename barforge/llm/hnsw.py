"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at once."""

from __future__ import annotations

import numpy as np

#: Links a new node makes at each level (twice as many may stay at level 0), and the beam while building.
LINKS, BUILD_BEAM = 20, 40
#: Nodes inserted at once at most; links among them come from their own similarities.
BATCH = 256
#: Beam entries that are opened in one step.
OPEN = 2
#: Cosine to a node from which a vector becomes its member, no node of its own: else a dense group holds every beam that comes near it.
MERGE = 0.95


class Hnsw:
    """Rows of ``x`` (float32, unit length) are nodes, or members of a node. Levels are drawn from a fixed seed, so equal input gives an equal graph.

    ``lead`` has the node of each row, and ``least`` each node's lowest cosine to a member.
    """

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7, merge: float = MERGE) -> None:
        self.x, self.m, self.merge = np.ascontiguousarray(x, np.float32), links, merge
        n = len(x)
        self.lead, self.least = np.arange(n), np.ones(n)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log1p(-draw) / np.log(links)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        self.top = int(level.max(initial=0))
        self.near = [np.full((n, 2 * links if i == 0 else links), -1, np.int32) for i in range(self.top + 1)]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            size = min(BATCH, max(1, done))
            at = level[order[done]]
            batch = order[done : done + size]
            batch = batch[level[batch] == at]
            self._insert(batch, int(at), beam)
            done += len(batch)

    def links(self) -> dict[str, np.ndarray]:
        """What makes the graph together with its rows."""
        return {"entry": np.array(self.entry), "lead": self.lead, "least": self.least, **{f"near{i}": a for i, a in enumerate(self.near)}}

    @classmethod
    def from_links(cls, x: np.ndarray, a: dict) -> Hnsw:
        self = cls.__new__(cls)
        self.x, self.entry, self.lead, self.least = np.ascontiguousarray(x, np.float32), int(a["entry"]), a["lead"], a["least"]
        self.near = [a[f"near{i}"] for i in range(sum(k.startswith("near") for k in a))]
        self.top, self.m = len(self.near) - 1, self.near[0].shape[1] // 2
        return self

    def _beam(self, q: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (queries x width, best first, -1 where there are fewer) of a beam search at one level."""
        rows, n = len(q), len(self.x)
        near, x = self.near[level], self.x
        ids = np.full((rows, width), -1, np.int32)
        sims = np.full((rows, width), -2.0, np.float32)
        opened = np.ones((rows, width), bool)
        seen = np.zeros((rows, n), bool)
        ids[:, 0] = start
        sims[:, 0] = np.einsum("ij,ij->i", q, x[start])
        opened[:, 0] = False
        seen[np.arange(rows), start] = True
        live = np.arange(rows)
        step = min(OPEN, width)
        while len(live):
            # The best entries that aren't open yet.
            value = np.where(opened[live], -3.0, sims[live])
            pick = np.argpartition(-value, step - 1, axis=1)[:, :step] if width > step else np.argsort(-value, axis=1)[:, :step]
            ok = np.take_along_axis(value, pick, 1) > -2.5
            go = ok.any(1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            lr = live[:, None]
            opened[lr, pick] = True
            nxt = near[np.where(ok, ids[lr, pick], 0)]
            nxt[~ok] = -1
            nxt = np.sort(nxt.reshape(len(live), -1), axis=1)
            fresh = nxt >= 0
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            fresh &= ~seen[lr, np.maximum(nxt, 0)]
            r, c = np.nonzero(fresh)
            new = np.full(nxt.shape, -2.0, np.float32)
            if len(r):
                node = nxt[r, c]
                seen[live[r], node] = True
                new[r, c] = np.einsum("ij,ij->i", q[live[r]], x[node])
            all_s = np.concatenate([sims[live], new], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, nxt, -1)], 1)
            all_o = np.concatenate([opened[live], ~fresh], 1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            opened[live] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _select(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates (best first), up to ``keep`` that are nearer to the node than to one chosen before; then the best others."""
        rows, width = ids.shape
        c = self.x[np.maximum(ids, 0)]
        between = np.matmul(c, c.transpose(0, 2, 1))
        valid = ids >= 0
        chosen = np.zeros((rows, width), bool)
        for j in range(width):
            blocked = (chosen[:, :j] & (between[:, :j, j] > sims[:, j : j + 1])).any(1)
            chosen[:, j] = valid[:, j] & ~blocked & (chosen.sum(1) < keep)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :keep]
        out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _merge(self, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Makes rows of a batch members of the node found nearest, or of an earlier row of the batch; returns which stay nodes."""
        stay = sims < self.merge
        at = np.flatnonzero(~stay)
        to, near = ids[at], sims[at]
        mates = np.triu(own >= self.merge, 1) & stay[:, None] & stay[None, :]
        if mates.any():
            lead = np.arange(len(batch))
            for i in np.flatnonzero(mates.any(1)):
                if lead[i] == i:
                    new = mates[i] & (lead == np.arange(len(batch)))
                    lead[new] = i
            more = np.flatnonzero(lead != np.arange(len(batch)))
            stay[more] = False
            at, to, near = np.concatenate([at, more]), np.concatenate([to, batch[lead[more]]]), np.concatenate([near, own[lead[more], more]])
        self.lead[batch[at]] = to
        np.minimum.at(self.least, to, near)
        return stay

    def _insert(self, batch: np.ndarray, level: int, beam: int) -> None:
        q = self.x[batch]
        start = np.full(len(batch), self.entry)
        for at in range(self.top, level, -1):
            start = self._beam(q, start, 1, at)[0][:, 0]
        found = {}
        for at in range(level, -1, -1):
            found[at] = self._beam(q, start, beam, at)
            start = found[at][0][:, 0]
        own = q @ q.T
        stay = self._merge(batch, found[0][0][:, 0], found[0][1][:, 0], own)
        batch, own = batch[stay], own[stay][:, stay]
        if not len(batch):
            return
        np.fill_diagonal(own, -2.0)
        most = min(16, len(batch) - 1)
        mates = np.argsort(-own, axis=1)[:, :most]
        mate_sims = np.take_along_axis(own, mates, 1)
        for at, (ids, sims) in found.items():
            ids = np.concatenate([ids[stay], batch[mates].astype(np.int32)], 1)
            sims = np.concatenate([sims[stay], mate_sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            picked = self._select(ids, sims, self.m)
            self.near[at][batch, : self.m] = picked
            self._link_back(np.repeat(batch, self.m), picked.ravel(), at)

    def _link_back(self, node: np.ndarray, to: np.ndarray, at: int) -> None:
        near = self.near[at]
        cap = near.shape[1]
        good = to >= 0
        node, to = node[good], to[good]
        sim = np.einsum("ij,ij->i", self.x[node], self.x[to])
        order = np.lexsort((-sim, to))
        node, to = node[order], to[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, count)
        few = nth < cap
        new = np.full((len(target), cap), -1, np.int32)
        new[np.searchsorted(target, to[few]), nth[few]] = node[few]
        new[(new[:, :, None] == near[target][:, None, :]).any(2)] = -1  # linked already
        for i in range(0, len(target), 256):
            t = target[i : i + 256]
            ids = np.concatenate([near[t], new[i : i + 256]], 1)
            sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", self.x[t], self.x[np.maximum(ids, 0)]), -2.0)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            width = max(cap, int((ids >= 0).sum(1).max()))
            ids, sims = ids[:, :width], sims[:, :width]
            over = (ids >= 0).sum(1) > cap
            near[t[~over]] = ids[~over, :cap]
            if over.any():
                near[t[over]] = self._select(ids[over], sims[over], cap)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, and their similarities, of the ``beam`` best found of each query, best first; -1 and -2 where there are fewer."""
        start = np.full(len(q), self.entry)
        for at in range(self.top, 0, -1):
            start = self._beam(q, start, 1, at)[0][:, 0]
        return self._beam(q, start, min(beam, len(self.x)), 0)
