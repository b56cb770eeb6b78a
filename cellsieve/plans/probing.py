"""Probe sizes of the methods: as column expressions, and as rules that tasks walk through."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellsieve.operators.tiered import Tier

# Safety factor as a fraction, growth per round, first sizes of the fixed methods.
SAFETY_PARTS = (3, 2)
SAFETY = SAFETY_PARTS[0] / SAFETY_PARTS[1]
GROWTH = 3
FIRST_NPROBE = 64
FIRST_SEARCH_K = 100


def pre_nprobe(count: Column, k_remaining: Column, old_nprobe: Column, nlist: int) -> Column:
    """Cells expected to hold 1.5 x the missing survivors, plus three times the earlier width."""
    # The fraction keeps the floor division in integers.
    above, below = SAFETY_PARTS
    expected = F.floor((above * k_remaining * F.lit(nlist)).cast("bigint") / (below * count)).cast("bigint") + GROWTH * old_nprobe
    return F.greatest(F.lit(1), F.least(expected, F.lit(nlist))).cast("bigint")


def post_search_k(est: Column, k_remaining: Column, old_search_k: Column, total: int) -> Column:
    """Candidates expected to hold 1.5 x the missing survivors, plus three times the earlier number."""
    wanted = F.floor(SAFETY * k_remaining * F.lit(float(total)) / F.greatest(est, F.lit(1)))
    grown = F.least(F.lit(total), wanted.cast("bigint") + GROWTH * old_search_k)
    return F.when(est == 0, F.lit(total)).otherwise(grown).cast("bigint")


def post_nprobe(est: Column, search_k: Column, old_nprobe: Column, nlist: int) -> Column:
    """Cells expected to hold that many candidates, plus the earlier width."""
    spread = F.floor((search_k * F.lit(nlist)) / F.greatest(est, F.lit(1))).cast("bigint") + old_nprobe
    width = F.least(F.lit(nlist), F.greatest(F.lit(1), spread))
    return F.when(est == 0, F.lit(nlist)).otherwise(width).cast("bigint")


def settled_width(nlist: int, k: int, adaptive: bool) -> Callable[[np.ndarray], int]:
    """The rule that turns a query's running survivor totals, cell by cell, into its final probe width: the first
    width of the sequence whose cells hold min(k, survivors); none without survivors."""
    widths = fixed_widths(nlist)
    above, below = SAFETY_PARTS

    def width(seen: np.ndarray) -> int:
        survivors = int(seen[-1]) if len(seen) else 0
        wanted, found, size = min(k, survivors), 0, 0
        steps = iter(widths)
        while found < wanted:
            if adaptive:
                size = max(1, min(nlist, above * (wanted - found) * nlist // (below * survivors) + GROWTH * size))
            else:
                size = next(steps)
            found = min(wanted, int(seen[size - 1]))
        return size

    return width


def fixed_widths(nlist: int) -> list[int]:
    """64, 192, 576, ... up to the number of cells."""
    widths, width = [], FIRST_NPROBE
    while True:
        widths.append(min(width, nlist))
        if width >= nlist:
            return widths
        width *= GROWTH


@dataclass(frozen=True)
class PostRule:
    """The rounds of a search that filters its candidates: `est` estimated survivors size them, None means fixed sizes."""

    k: int
    est: int | None
    nlist: int
    total: int

    def sizes(self, found: int = 0, old_search_k: int = 0, old_nprobe: int = 0) -> tuple[int, int]:
        """(search_k, nprobe) of the first round, or of the next one after `found` hits."""
        first = old_search_k == 0
        if self.est is None:
            search_k = FIRST_SEARCH_K if first else min(self.total, GROWTH * old_search_k)
            nprobe = min(self.nlist, FIRST_NPROBE if first else GROWTH * old_nprobe)
        elif self.est == 0:
            search_k, nprobe = self.total, self.nlist
        else:
            wanted = math.floor(SAFETY * (self.k - found) * float(self.total) / self.est)
            search_k = min(self.total, wanted + GROWTH * old_search_k)
            nprobe = min(self.nlist, max(1, search_k * self.nlist // self.est))
        # A candidate list as long as the index means searching every cell.
        return search_k, self.nlist if search_k >= self.total else nprobe

    def tiers(self, most: int) -> list[Tier]:
        """What has to be kept for all rounds of at most `most` candidates that may occur before all cells are probed:
        each round between its sizes if all but one hit were found before and those if none was."""
        out: list[Tier] = []
        low = high = self.sizes()
        while low[1] < self.nlist and low[0] <= most:
            out.append(Tier(low[1], min(high[1], self.nlist - 1), min(high[0], most)))
            low, high = self.sizes(self.k - 1, *low), self.sizes(0, *high)
        return out

    def clipped(self, tiers: list[Tier]) -> bool:
        """Whether some round before all cells are probed may ask for more than `tiers` keep."""
        low = high = self.sizes()
        for tier in tiers:
            if min(high[1], self.nlist - 1) > tier.outer or high[0] > tier.cap:
                return True
            low, high = self.sizes(self.k - 1, *low), self.sizes(0, *high)
        return low[1] < self.nlist

    def walk(self, cell_rank: np.ndarray, passes: np.ndarray, tiers: list[Tier], near: Callable[[int], np.ndarray] | None = None) -> Walk:
        """The rounds over candidates (best first) kept for `tiers`; `near` says which rows lie in so many cells."""
        near = near or (lambda nprobe: np.flatnonzero(cell_rank < nprobe))
        search_k, nprobe = self.sizes()
        rounds = candidates = 0
        while nprobe < self.nlist and any(t.inner <= nprobe <= t.outer and search_k <= t.cap for t in tiers):
            within = near(nprobe)[:search_k]
            hits = within[passes[within]]
            rounds, candidates = rounds + 1, candidates + len(within)
            if len(hits) >= self.k:
                return Walk(hits[: self.k], search_k, nprobe, rounds, candidates)
            search_k, nprobe = self.sizes(len(hits), search_k, nprobe)
        return Walk(None, search_k, nprobe, rounds, candidates)


@dataclass(frozen=True)
class Walk:
    """hits: the rows that answer, or None with the sizes of the round that is due: all cells, or one whose candidates
    were not kept. rounds, candidates: what was searched on the way."""

    hits: np.ndarray | None
    search_k: int
    nprobe: int
    rounds: int
    candidates: int

    @property
    def sizes(self) -> tuple[int, int]:
        return self.search_k, self.nprobe
