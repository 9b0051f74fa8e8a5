import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayledger.llm import caps, collisions

from .helpers import Groups, none_of

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, score string, part int"


def planted(rng, n=700, dim=16):
    """Vectors of different lengths; near copies, exact copies, a large group, and odd ones."""
    base = rng.standard_normal((n, dim))
    near = base[:80] + 0.02 * rng.standard_normal((80, dim))
    group = base[100] + 0.06 * rng.standard_normal((120, dim))
    x = np.concatenate([base, near, group, base[:10], 3 * base[10:15], np.repeat(base[20:21], 30, 0)])
    rows = [(i, [float(v) for v in np.float32(v)], 0, "x", "y", 1) for i, v in enumerate(x)]
    k = len(rows)
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1),
           [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    rows += [(k + i, v, None, None, None, None) for i, v in enumerate(odd)]
    rows += [rows[5], (None, rows[6][1], 0, "x", "y", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return planted(np.random.default_rng(1))


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_components_and_links_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(caps, "ONE_IN", 20)
    found = caps.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    mine = [(i, np.array(v)) for i, v, *_ in rows if i is not None and good(v)]
    links, groups = {}, Groups()
    for p, (i, a) in enumerate(mine):
        for q, (j, b) in enumerate(mine):
            if p != q and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i] = links.get(i, 0) + 1
                groups.join(i, j)
    rate = [links.get(i, 0) for i, _ in mine].count(0)
    told = {}
    for r in found:
        told.setdefault(r["vec_id"], []).append(r)
    got = sum(r["n_links"] for r in found)
    want = sum(links[i] for i, _ in mine if i in links)
    assert 0.99 * want <= got <= want and rate > 100
    # A row repeated counts for both; of components nothing is lost here.
    same = [told[i][0]["component_id"] == groups.root(i) for i, _ in mine]
    assert np.mean(same) > 0.99
    for r in found:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    for i, v, *_ in rows:
        if not good(v) and i is not None:
            assert told[i][0]["n_links"] == 0 and told[i][0]["component_id"] == i


def test_tiles_of_a_large_filter_give_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(caps.near_duplicates(df).collect(), key=str)
    monkeypatch.setattr(caps, "TILE", 16)
    assert sorted(caps.near_duplicates(df).collect(), key=str) == whole


def test_decoding_lists_all_filters_that_pass():
    rng = np.random.default_rng(2)
    for _ in range(50):
        one, two = rng.standard_normal(30), rng.standard_normal(30)
        sums = (one[:, None] + two[None, :]).ravel()
        assert caps.decode(one, two, 1.0, least=5).tolist() == np.flatnonzero(sums >= 1.0).tolist()
        few = caps.decode(one, two, 99.0, least=5)
        assert sorted(sums[few]) == pytest.approx(sorted(sums)[-5:])


def test_first_shared_filter():
    rng = random.Random(3)
    lists = [np.array(sorted(rng.sample(range(40), 8) + [50])) for _ in range(40)]
    shared = caps.first_shared(lists, 50)
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            assert shared[i, j] == bool(set(a[:-1]) & set(b[:-1])) or i == j


def exact(rows, k):
    mine = {(i, tuple(v)) for i, v, *_ in rows if i is not None and good(v)}
    mine = [(i, np.array(v)) for i, v in sorted(mine)]
    best = {}
    for i, a in mine:
        if i % 20 == 0:
            scores = sorted((-float(a @ b), j) for j, b in mine if j != i and len(a) == len(b))
            best[i] = [(j, -s) for s, j in scores[:k]]
    return best


def test_nearest_against_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = exact(rows, 20)
    for block, queries in ((4096, 4096), (100, 10)):
        found = collisions.nearest(df, F.col("vec_id") % 20 == 0, block=block, queries=queries)
        told = {}
        for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
            told.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
        assert told.keys() == want.keys()
        hits = 0
        for i, own in told.items():
            assert [x[2] for x in own] == list(range(1, len(want[i]) + 1))
            assert own == sorted(own, key=lambda x: (-x[1], x[0]))
            hits += len({x[0] for x in own} & {j for j, _ in want[i]})
        assert hits / sum(map(len, want.values())) > 0.95


def test_few_candidates_and_ties(spark):
    rows = [(20 * i, [1.0, float(i % 2)], 0, "x", "y", 1) for i in range(5)]
    found = collisions.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r)[:3] for r in found.collect()) == [
        (20 * i, rank, 20 * j) for i in range(5)
        for rank, j in enumerate(sorted((j for j in range(5) if j != i), key=lambda j: (-(1 + (i % 2) * (j % 2)), j)), 1)
    ]


def test_empty_tables(spark, rows):
    df = none_of(spark.createDataFrame(rows, SCHEMA))
    assert caps.near_duplicates(df).count() == 0
    assert collisions.nearest(df, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(rows, 20)
    found = collisions.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = sum(r["vec_id"] in {j for j, _ in want[r["query_id"]]} for r in found)
    assert hits / sum(map(len, want.values())) > 0.95
