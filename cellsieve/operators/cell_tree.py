"""Nearest cells through groups of centroids, exact by a bound on what a group can hold.

Centroids are put into about as many groups as the square root of their number. A group is a ball: a middle and the
largest distance of a member from it. For a point p every member c has |p·c - p·middle| <= |p| * radius. Groups are
left out where that bound is below the nth best similarity found, so most centroids are never compared where points and
centroids cluster; where they don't, the answer is the same, and a group meets many points as one matrix product.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from cellsieve import limits
from cellsieve.functions.vectors import SETTLED_DECIMALS

# Similarities are settled to so many decimals; bounds allow for it.
SLACK = 10.0**-SETTLED_DECIMALS * 2
ROUNDS = 4
# Points that meet a group at once: their similarities stay in the processor's caches.
POINTS_AT_ONCE = 1024
# Single precision screens while products stay far below its largest number.
SINGLE_RANGE = 1e30
MERGED_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Groups:
    """Balls around groups of centroids, and how many centroids each holds."""

    middles: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) similarity of any member, points x groups."""
        middle = points @ self.middles.T
        reach = np.sqrt((points * points).sum(axis=1))[:, None] * self.radii[None, :] + SLACK
        return middle - reach, middle + reach

    def candidates(self, points: np.ndarray, n: int) -> list[np.ndarray]:
        """For each point the groups that may hold one of its n nearest centroids, by the bounds alone."""
        lower, upper = self.bounds(points)
        order = np.argsort(-lower, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        out = []
        for row in range(len(points)):
            at = int(np.searchsorted(held[row], n))
            least = lower[row, order[row, at]] if at < len(self.sizes) else -np.inf
            out.append(np.flatnonzero(upper[row] >= least))
        return out


@dataclass(frozen=True)
class CellTree:
    """Centroids (in the order of their ids) by group: members[g] are row numbers, ascending."""

    matrix: np.ndarray
    groups: Groups
    members: list[np.ndarray]

    @classmethod
    def of(cls, matrix: np.ndarray, seed: int) -> CellTree:
        """Groups by a few rounds of k-means over the centroids."""
        n = len(matrix)
        wanted = max(1, math.isqrt(n))
        middles = matrix[np.random.default_rng(seed).choice(n, wanted, replace=False)]
        for last in range(ROUNDS):
            own = nearest_middles(matrix, middles)
            names, own = np.unique(own, return_inverse=True)
            sums = np.zeros((len(names), matrix.shape[1]))
            np.add.at(sums, own, matrix)
            middles = sums / np.bincount(own)[:, None]
        members = [np.flatnonzero(own == g) for g in range(len(middles))]
        radii = np.array([np.sqrt(((matrix[m] - c) ** 2).sum(axis=1).max()) for m, c in zip(members, middles)])
        return cls(matrix, Groups(middles, radii, np.array([len(m) for m in members])), members)

    @cached_property
    def packed(self) -> list[np.ndarray]:
        """The centroids of each group in single precision, made once per process."""
        return [self.matrix[member].astype(np.float32) for member in self.members]

    @cached_property
    def longest(self) -> float:
        return float(np.sqrt((self.matrix * self.matrix).sum(axis=1)).max(initial=0))

    def nearest(self, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid rows, similarities, compared): the n most similar centroids of each point, best first, lower row
        on ties, and how many similarities to centroids were worked out.

        Each point first meets the groups of highest bound until it holds n centroids. Then every group meets all points
        that its bound leaves open as one matrix product in single precision; what may rank by that, its rounding error
        allowed for, is worked out in double precision."""
        n = min(n, len(self.matrix))
        best = np.full((len(points), n), -np.inf)
        rows = np.full((len(points), n), len(self.matrix), np.int64)
        if not len(points):
            return rows, best, 0
        upper = self.groups.bounds(points)[1].T.copy()  # groups x points
        compared = 0
        active = np.arange(len(points))
        for _ in range(len(self.members)):
            group = upper[:, active].argmax(axis=0)
            met = upper[group, active] > -np.inf
            active, group = active[met], group[met]
            for g in np.unique(group).tolist():
                some, member = active[group == g], self.members[g]
                step = max(16, limits.TILE_ENTRIES // len(member))
                for at in range(0, len(some), step):
                    which = some[at : at + step]
                    sims = np.round(points[which] @ self.matrix[member].T, SETTLED_DECIMALS)
                    compared += sims.size
                    last = max(0, len(member) - n)
                    row, at_ = np.nonzero(sims >= np.partition(sims, last, axis=1)[:, last, None])
                    _merge(best, rows, which[row], member[at_], sims[row, at_])
                upper[g, some] = -np.inf
            active = active[best[active, n - 1] == -np.inf]
            if not len(active):
                break
        norms = np.sqrt((points * points).sum(axis=1))
        single = norms.max() * max(1.0, self.longest) < SINGLE_RANGE
        screened = points.astype(np.float32) if single else points
        # Both inputs are rounded, then each product and sum.
        error = norms * self.longest * (points.shape[1] + 8) * 2.0**-23 + SLACK
        for low in range(0, len(points), POINTS_AT_ONCE):
            every = np.arange(low, min(len(points), low + POINTS_AT_ONCE))
            for g, member in enumerate(self.members):
                floor = best[every, n - 1]
                some = every[upper[g, every] >= floor]
                if not len(some):
                    continue
                own = screened[low : every[-1] + 1] if len(some) == len(every) else screened[some]
                about = own @ (self.packed[g] if single else self.matrix[member]).T
                compared += about.size
                least = best[some, n - 1] - error[some]
                hit = np.flatnonzero(about.max(axis=1) >= least)
                if not len(hit):
                    continue
                row, at = np.nonzero(about[hit] >= least[hit, None])
                row, at = some[hit[row]], member[at]
                for part in range(0, len(row), MERGED_AT_ONCE):
                    r, c = row[part : part + MERGED_AT_ONCE], at[part : part + MERGED_AT_ONCE]
                    sims = np.round(np.einsum("ij,ij->i", points[r], self.matrix[c]), SETTLED_DECIMALS)
                    keep = sims >= best[r, n - 1]
                    _merge(best, rows, r[keep], c[keep], sims[keep])
        return rows, best, compared


def _merge(best: np.ndarray, rows: np.ndarray, point: np.ndarray, row: np.ndarray, sims: np.ndarray) -> None:
    """Further (point, centroid row, similarity), ascending by point, among the best of each point so far."""
    if not len(point):
        return
    n = best.shape[1]
    points, first, counts = np.unique(point, return_index=True, return_counts=True)
    if n == 1 and counts.max() == 1:
        better = (sims > best[points, 0]) | ((sims == best[points, 0]) & (row < rows[points, 0]))
        best[points[better], 0], rows[points[better], 0] = sims[better], row[better]
        return
    owner, place = np.repeat(np.arange(len(points)), counts), np.arange(len(point)) - np.repeat(first, counts)
    all_sims = np.full((len(points), n + int(counts.max())), -np.inf)
    all_rows = np.full(all_sims.shape, np.iinfo(np.int64).max)
    all_sims[:, :n], all_rows[:, :n] = best[points], rows[points]
    all_sims[owner, n + place], all_rows[owner, n + place] = sims, row
    top = np.lexsort((all_rows, -all_sims), axis=1)[:, :n]
    best[points] = np.take_along_axis(all_sims, top, axis=1)
    rows[points] = np.take_along_axis(all_rows, top, axis=1)


def nearest_middles(points: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """The middle at the least distance of each point."""
    half = (middles * middles).sum(axis=1) / 2
    step = max(16, limits.TILE_ENTRIES // max(1, len(middles)))
    parts = [(points[at : at + step] @ middles.T - half).argmax(axis=1) for at in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
