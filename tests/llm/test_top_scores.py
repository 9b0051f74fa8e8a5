from math import floor

import numpy as np
import pytest

from dayledger.llm import top_scores

from .helpers import none_of

SCHEMA = "vec_id bigint, embedding array<float>, x string, number int, block string, score string"
ASKS = "vec_id % 50 = 0"


def filled(vectors):
    return [(i, v, "x", 1, "y", "z") for i, v in vectors]


def whole(v):
    ends = -(2**63), 2**63 - 1
    return tuple(min(max(floor(256 * float(np.float32(c))), ends[0]), ends[1]) for c in v)


def brute(vectors, k=5):
    own = {(i, whole(v)) for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    rows = []
    for i, x in own:
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in own if j != i and len(x) == len(y)]
            best = sorted((max(s, -(2**63 - 1)), j) for s, j in scores)[:k]
            rows += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(rows)


def planted(seed, n=900, dim=13):
    """Random vectors, near copies of one, a group of copies in a third of the rows, ties."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * 0.1
    near, same, ties = x[n // 9 : n // 2], x[n // 2 : 5 * n // 6], x[5 * n // 6 : 9 * n // 10]
    near[:] = near[0] + rng.standard_normal(near.shape) * 0.01
    same[:] = same[0]
    ties[:] = np.sign(ties) * 0.125
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(
    ("lists", "block", "heads"), [(4, None, 64), (1, 4096, 64), (2, 100, 64), (4, 100, 2), (13, 50, 1)]
)
def test_against_all_pairs(spark, lists, block, heads):
    rows = planted(lists)
    found = top_scores.best(spark.createDataFrame(filled(rows), SCHEMA), ASKS, lists=lists, block=block, heads=heads)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_odd_vectors(spark):
    rows = planted(9, 200, 4) + [(1000, [0.0] * 4), (1050, [0.0] * 4), (1050, [0.0] * 4), (1100, [1.0, 2.0]), (1101, [2.0, 1.0])]
    rows += [(1150, []), (1151, []), (1200, None), (1250, [None] * 4), (1300, [float("nan")] * 4), (None, [1.0] * 4)]
    rows += [(1350, [float("-inf")] + [0.0] * 3)]
    found = top_scores.best(spark.createDataFrame(filled(rows), SCHEMA), ASKS)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_few_candidates_and_negative_scores(spark):
    rows = [(50 * i, [-1.0 if i else 1.0, 0.5 * i]) for i in range(4)]
    found = top_scores.best(spark.createDataFrame(filled(rows), SCHEMA), ASKS)
    assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e9, 1e17, 1e30])
def test_large_components(spark, scale):
    """Scores that only whole numbers hold, and scores beyond 64 bits."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(3) * scale)]) for i in range(120)]
    found = top_scores.best(spark.createDataFrame(filled(rows), SCHEMA), ASKS, block=40)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_entries_below_the_share_stay_behind():
    """The cutoff bars nearly all entries, and none that it must not."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.standard_normal((4000, 64)) * 32).astype(np.int64)
    block = top_scores.Block(np.arange(4000), x, top_scores.LISTS)
    q = x[:40]
    totals = q @ x.T
    cutoff = -np.sort(-totals, 1)[:, 5]
    at, place = block.sufficient(q, cutoff, 6)
    kept = set(zip(at.tolist(), place.tolist(), strict=True))
    assert {(int(a), int(p)) for a, p in zip(*np.nonzero(totals >= cutoff[:, None]), strict=True)} <= kept
    assert len(kept) < 0.05 * totals.size


def test_empty_table(spark):
    assert top_scores.best(none_of(spark.createDataFrame(filled(planted(1, 800)), SCHEMA)), ASKS).count() == 0
