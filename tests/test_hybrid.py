import numpy as np
import pytest

from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.predicates import Predicate
from cellsieve.plans import hybrid, probing

CASES = {
    "two columns": [Predicate("token_count", 500, "<"), Predicate("revdate", "2024-01-01 02:00", ">=")],
    "none": [],
    "selective": [Predicate("token_count", 1200, ">")],
    "same column twice": [Predicate("token_count", 200, "<"), Predicate("token_count", 50, ">")],
    "ids": [Predicate("item_id", list(range(3, 60)), "IN")],
    "nothing": [Predicate("token_count", 1, "<")],
}


def passes(local, predicates):
    mask = np.ones(len(local["ids"]), dtype=bool)
    for p in predicates:
        column = local["ids"] if p.key == "item_id" else local[p.key]
        if p.operator == "IN":
            mask &= np.isin(column, p.value)
        else:
            mask &= {"<": column < p.value, ">": column > p.value, ">=": column >= p.value}[p.operator]
    return mask


@pytest.fixture(scope="module")
def histogram(fine):
    return Histogram2D.build(fine.vectors).collected()


class Naive:
    """The four methods as plain loops over one query, for comparison."""

    def __init__(self, local, q, mask, k):
        self.local, self.mask, self.k = local, mask, k
        self.sims = np.round(local["vectors"] @ q, 9)
        ids, centroids = local["centroids"]
        cell_sims = np.round(centroids @ q, 9)
        order = sorted(range(len(ids)), key=lambda c: (-cell_sims[c], ids[c]))
        rank = {ids[c]: n for n, c in enumerate(order)}
        self.cell_rank = np.array([rank[c] for c in local["cells"]])
        self.n, self.nlist = len(local["ids"]), len(ids)

    def search(self, search_k, nprobe, allowed=None):
        keep = self.cell_rank < nprobe
        if allowed is not None:
            keep &= allowed
        return sorted(np.flatnonzero(keep), key=lambda i: (-self.sims[i], self.local["ids"][i]))[:search_k]

    def rounds(self, sizes, hits, enough):
        """Hits of the first round that has enough of them; a round's (search_k, nprobe) may hang on the one before."""
        size, found = None, []
        while not enough(size, found):
            size = sizes(size, len(found))
            found = hits(*size)
        return found

    def pre(self, adaptive):
        count = int(self.mask.sum())
        goal = min(count, self.k)

        def width(before, found):
            if adaptive:
                return max(1, 3 * (goal - found) * self.nlist // (2 * count) + 3 * before)
            return 3 * before or 64

        return self.rounds(
            lambda size, found: (goal, min(self.nlist, width(size[1] if size else 0, found))),
            lambda search_k, nprobe: self.search(search_k, nprobe, self.mask),
            lambda _, found: len(found) >= goal,
        )

    def post(self, est=None):
        def sizes(size, found):
            old_k, old_n = size or (0, 0)
            if est is None:
                search_k, nprobe = 3 * old_k or 100, 3 * old_n or 64
            elif est:
                search_k = int(1.5 * (self.k - found) * self.n / est) + 3 * old_k
                nprobe = max(1, min(self.n, search_k) * self.nlist // est)
            else:
                search_k = self.n
            return (search_k, min(self.nlist, nprobe)) if search_k < self.n else (self.n, self.nlist)

        return self.rounds(
            sizes,
            lambda search_k, nprobe: [i for i in self.search(search_k, nprobe) if self.mask[i]],
            lambda size, found: len(found) >= self.k or (size is not None and size[0] >= self.n),
        )[: self.k]


@pytest.mark.parametrize("k", [3, 90])
@pytest.mark.parametrize("case", list(CASES))
@pytest.mark.parametrize("method", hybrid.METHODS)
def test_methods_equal_their_loops(fine, queries, local, query_vectors, histogram, method, case, k):
    predicates = CASES[case]
    mask = passes(local, predicates)
    est = histogram.estimate([p for p in predicates if p.key != "item_id"])
    expected = set()
    for qid, q in query_vectors.items():
        naive = Naive(local, q, mask, k)
        if "pre" in method:
            found = naive.pre(method == hybrid.ADAP_PRE)
        else:
            found = naive.post(est if method == hybrid.ADAP_POS else None)
        expected |= {
            (qid, n + 1, int(local["ids"][i]), naive.sims[i], len(found) == k) for n, i in enumerate(found)
        }
    got = hybrid.filtered_search(fine, queries, predicates, k, method, histogram)
    assert {tuple(r) for r in got.select(*hybrid.RESULT_COLUMNS).collect()} == expected


@pytest.mark.parametrize("method", [hybrid.BASE_POS, hybrid.ADAP_POS])
def test_counting_equals_ranking(fine, queries, histogram, method, monkeypatch):
    args = (fine, queries, CASES["two columns"], 12, method, histogram)
    ranked = {tuple(r) for r in hybrid.filtered_search(*args).collect()}
    monkeypatch.setattr(hybrid, "RANKED_CANDIDATES", 0)
    assert {tuple(r) for r in hybrid.filtered_search(*args).collect()} == ranked


@pytest.mark.parametrize("method", hybrid.METHODS)
def test_metadata_outside_the_index(spark, fine, queries, histogram, method):
    from cellsieve.operators.ivf import replace

    bare = replace(fine, vectors=fine.vectors.drop("token_count", "revdate"))
    items = fine.vectors.select("item_id", "token_count", "revdate")
    predicates = CASES["two columns"]
    expected = {tuple(r) for r in hybrid.filtered_search(fine, queries, predicates, 10, method, histogram).collect()}
    got = hybrid.filtered_search(bare, queries, predicates, 10, method, histogram, items)
    assert {tuple(r) for r in got.collect()} == expected
    with pytest.raises(ValueError):
        hybrid.filtered_search(bare, queries, predicates, 10, method, histogram)


def test_unknown_method(fine, queries):
    with pytest.raises(ValueError):
        hybrid.filtered_search(fine, queries, [], 5, "pre_search")
    with pytest.raises(ValueError):
        hybrid.filtered_search(fine, queries, [], 5, hybrid.ADAP_POS)


@pytest.mark.parametrize(
    "count, k, old, expected",
    [(300, 10, 0, 25), (150000, 10, 0, 1), (1000, 5, 7, 24), (50, 100, 0, 512), (15000, 500, 0, 25)],
)
def test_pre_width(spark, count, k, old, expected):
    from pyspark.sql import functions as F

    width = probing.pre_nprobe(F.lit(count), F.lit(k), F.lit(old), 512)
    assert spark.range(1).select(width).head()[0] == expected


@pytest.mark.parametrize(
    "est, k, old, expected",
    [
        (15000, 10, 0, (150, 5)),
        (15000, 5, 150, (525, 17)),
        (0, 10, 0, (150000, 512)),
        (300, 10, 0, (7500, 512)),
        (150000, 10, 0, (15, 1)),
        (75000, 1000, 0, (3000, 20)),
    ],
)
def test_post_sizes(spark, est, k, old, expected):
    from pyspark.sql import functions as F

    search_k = probing.post_search_k(F.lit(est), F.lit(k), F.lit(old), 150_000)
    nprobe = probing.post_nprobe(F.lit(est), search_k, F.lit(0), 512)
    assert tuple(spark.range(1).select(search_k, nprobe).head()) == expected


def test_fixed_widths():
    assert probing.fixed_widths(512) == [64, 192, 512]
    assert probing.fixed_widths(16) == [16]
