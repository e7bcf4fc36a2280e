"""A hierarchical navigable small-world graph in numpy, built and searched many vectors at a time."""

from __future__ import annotations

import numpy as np

LINKS = 10
BASE_LINKS = 20
BUILD_BEAM = 40
#: Nodes that a search opens per step and query.
OPENED = 4
BATCH = 512


def _pick(near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in falling order of ``near``, up to ``most`` that are not nearer to a picked one.

    Places left over go to the nearest of the rest. ``ids`` below 0 are no candidates.
    """
    rows, width = ids.shape
    seen = vectors[np.maximum(ids, 0)]
    between = seen @ seen.transpose(0, 2, 1)
    closest = np.full((rows, width), -np.inf, np.float32)
    count = np.zeros(rows, np.int64)
    picked = np.zeros((rows, width), bool)
    for k in range(width):
        take = (ids[:, k] >= 0) & (closest[:, k] < near[:, k]) & (count < most)
        picked[:, k] = take
        count += take
        np.maximum(closest, np.where(take[:, None], between[:, :, k], -np.inf), out=closest)
    rank = np.where(picked, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    chosen = np.take_along_axis(ids, order, 1)
    if width < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - width)), constant_values=-1)
    return chosen


class Graph:
    """Nodes are positions of ``vectors`` (float32 rows of length 1). ``layers[0]`` holds all."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0) -> None:
        self.vectors, self.entry = vectors, entry
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        count = len(self.vectors)
        rng = np.random.default_rng(count)
        heights = np.minimum(np.floor(-np.log(1 - rng.random(count)) / np.log(LINKS)).astype(int), 6)
        heights[0] = max(1, heights.max(initial=0))
        self.layers = [
            np.full((count, BASE_LINKS if k == 0 else LINKS), -1, np.int32) for k in range(heights[0] + 1)
        ]
        self.entry, done = 0, 1
        while done < count:
            batch = np.arange(done, min(count, done + min(BATCH, max(8, done))))
            q = self.vectors[batch]
            starts = np.full((len(batch), 1), self.entry, np.int64)
            for level in range(heights[0], -1, -1):
                joins = heights[batch] >= level
                ids, near = self.beam(q, starts, BUILD_BEAM if joins.any() else 1, level)
                if joins.any():
                    self._link(level, batch[joins], ids[joins], near[joins])
                starts = ids[:, :4].astype(np.int64)
            done = int(batch[-1]) + 1
        return self.layers

    def _link(self, level: int, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        layer, vectors = self.layers[level], self.vectors
        among = vectors[new] @ vectors[new].T  # nodes of a batch have not found each other
        np.fill_diagonal(among, -np.inf)
        some = min(16, len(new))
        top = np.argpartition(-among, some - 1, 1)[:, :some]
        own_near = np.take_along_axis(among, top, 1)
        own_ids = np.where(np.isfinite(own_near), new[top], -1)
        ids, near = np.hstack([ids, own_ids]), np.hstack([near, own_near])
        order = np.argsort(-near, 1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        links = _pick(near, ids, vectors, LINKS)
        layer[new, :LINKS] = links
        source = np.repeat(new, links.shape[1])[links.ravel() >= 0]
        target = links.ravel()[links.ravel() >= 0]
        order = np.lexsort((-(vectors[source] * vectors[target]).sum(1), target))
        source, target = source[order], target[order]
        touched, first, often = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, often)
        width = layer.shape[1]
        fit = place < width
        back = np.full((len(touched), width), -1, np.int64)
        back[np.repeat(np.arange(len(touched)), often)[fit], place[fit]] = source[fit]
        for at in range(0, len(touched), 1024):
            nodes, more = touched[at : at + 1024], back[at : at + 1024]
            all_ids = np.hstack([layer[nodes].astype(np.int64), more])
            all_ids.sort(axis=1)
            all_ids[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = -1
            all_near = np.einsum("rd,rkd->rk", vectors[nodes], vectors[np.maximum(all_ids, 0)])
            all_near[all_ids < 0] = -np.inf
            order = np.argsort(-all_near, 1, kind="stable")
            all_ids, all_near = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1)
            full = (all_ids >= 0).sum(1) > width
            layer[nodes[~full]] = all_ids[~full, :width]
            if full.any():
                layer[nodes[full]] = _pick(all_near[full], all_ids[full], vectors, width)

    def beam(self, q: np.ndarray, starts: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes met from ``starts`` for each query, nearest first; -1 for none."""
        layer, vectors = self.layers[level], self.vectors
        rows = len(q)
        seen = np.zeros((rows, len(vectors)), bool)
        ids = np.full((rows, width), -1, np.int64)
        near = np.full((rows, width), -np.inf, np.float32)
        opened = np.ones((rows, width), bool)
        live, new = np.arange(rows), starts
        while len(live):
            new = np.sort(new, axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(new, 0)]
            seen[np.broadcast_to(live[:, None], new.shape)[fresh], new[fresh]] = True
            score = np.einsum("rd,rkd->rk", q[live], vectors[np.maximum(new, 0)])
            score[~fresh] = -np.inf
            all_near = np.hstack([near[live], score])
            order = np.argsort(-all_near, 1, kind="stable")[:, :width]
            near[live] = np.take_along_axis(all_near, order, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(fresh, new, -1)]), order, 1)
            opened[live] = np.take_along_axis(np.hstack([opened[live], ~fresh]), order, 1)
            live = live[(~opened[live]).any(1)]
            if not len(live):
                break
            first = np.argsort(opened[live], 1, kind="stable")[:, :OPENED]
            usable = ~np.take_along_axis(opened[live], first, 1)
            nodes = np.take_along_axis(ids[live], first, 1)
            opened[live[:, None], first] = True
            new = layer[np.maximum(nodes, 0)].astype(np.int64)
            new[~usable] = -1
            new = new.reshape(len(live), -1)
        return ids, near

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.layers) - 1, 0, -1):
            starts = self.beam(q, starts, 4, level)[0]
        return self.beam(q, starts, width, 0)

    def within(self, q: np.ndarray, least: float, width: int) -> list[np.ndarray]:
        """For each query the nodes found with a product of ``least`` or more.

        What the beam holds above ``least`` is spread from along links until nothing new is above it,
        so more nodes than the beam is wide can be found.
        """
        found = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            for row, ids, near in zip(part, *self.search(part, min(width, len(self.vectors))), strict=True):
                hits = ids[(ids >= 0) & (near >= least)]
                edge = hits
                if len(hits):
                    seen = np.zeros(len(self.vectors), bool)
                    seen[ids[ids >= 0]] = True
                    while len(edge):
                        next_ = np.unique(self.layers[0][edge])
                        next_ = next_[next_ >= 0]
                        next_ = next_[~seen[next_]]
                        seen[next_] = True
                        edge = next_[self.vectors[next_] @ row >= least]
                        hits = np.concatenate([hits, edge])
                found.append(hits)
        return found
