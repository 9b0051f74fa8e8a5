import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayledger.llm import common, simhash

from .helpers import Groups, hard_docs, none_of, sentence


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, radius=4):
    prints = [plain_fingerprint(r["text"]) for r in rows]
    groups = Groups()
    for a in set(prints):
        for b in set(prints):
            if (a ^ b).bit_count() <= radius:
                groups.join(a, b)
    least = {}
    for r, p in zip(rows, prints):
        if r["doc_id"] is not None:
            root = groups.root(p)
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    return sorted(
        ((r["doc_id"], f"{p:016x}", least.get(groups.root(p))) for r, p in zip(rows, prints)), key=str
    )


def test_hard_documents_against_all_pairs(spark):
    docs = hard_docs(spark, random.Random(1))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(docs.collect())


def test_near_copies_over_many_tiles(spark):
    rng = random.Random(2)
    base = sentence(rng, 200)
    texts = [base] + [base + " " + sentence(rng, 3) for _ in range(150)]
    texts += [sentence(rng, 40) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(found.items()) == [(d, c) for d, _, c in sorted(plain(docs.collect()))]
    prints = simhash.fingerprints(docs).select("fingerprint").distinct()
    small = common.components(simhash.links(prints, tile=8)).collect()
    whole = common.components(simhash.links(prints)).collect()
    assert sorted(small) == sorted(whole) and small


def test_links_of_a_tile_are_few_and_connect():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 64, 300).astype(np.uint64)
    found = list(simhash.linked(a, a, True, 2))
    assert len(found) <= 2 * len(a)
    groups, want = Groups(), Groups()
    for i, j in found:
        groups.join(int(i), int(j))
    for i in range(len(a)):
        for j in range(len(a)):
            if int(a[i] ^ a[j]).bit_count() <= 2:
                want.join(i, j)
    assert [groups.root(i) for i in range(300)] == [want.root(i) for i in range(300)]


def similarity(a, b):
    """The plain similarity of two lists of words, by shingles of five."""
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def near_texts(rng, n):
    """Texts, and copies of them in which single words are replaced."""
    made = []
    for _ in range(n):
        words = sentence(rng, rng.randint(40, 400)).split()
        made.append(words)
        for _ in range(rng.randint(0, 2)):
            near = list(words)
            for _ in range(max(1, int(len(near) * rng.choice([0.005, 0.01, 0.02, 0.1])))):
                near[rng.randrange(len(near))] = sentence(rng, 1)
            made.append(near)
    return made


@pytest.mark.parametrize("tile", [simhash.COPIES_TILE, 40])
def test_near_copies_against_plain_similarity(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "COPIES_TILE", tile)
    texts = near_texts(random.Random(6), 120)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    near = far = held = 0
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            told, same = similarity(a, b), found[i] == found[j]
            if told >= 0.85:
                near, held = near + 1, held + same
            elif told < 0.3:
                far += same
    assert near > 40 and held >= 0.97 * near and far == 0
    assert all(c <= i for i, c in found.items())


def test_confirmed_tiles_are_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.int64).view(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (200, 4)).astype(np.uint64)
    a = base[rng.integers(0, 40, 200)] ^ np.where(rng.random((200, 4)) < 0.7, flips, np.uint64(0))

    def confirmed(i, j):
        return np.bitwise_count(a[i] ^ a[j]).sum(1, dtype=np.int64) <= 4

    groups, want = Groups(), Groups()
    for i, j in simhash.linked(a[:, 0].copy(), a[:, 0].copy(), True, 3, confirmed):
        groups.join(int(i), int(j))
    for i in range(200):
        for j in range(i):
            d = [(int(x) ^ int(y)).bit_count() for x, y in zip(a[i], a[j], strict=True)]
            if d[0] <= 3 and sum(d) <= 4:
                want.join(i, j)
    assert [groups.root(i) for i in range(200)] == [want.root(i) for i in range(200)]


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = hard_docs(spark, random.Random(4))
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    rows = left.where("doc_id IS NOT NULL").collect()
    found = {r["component_id"] for r in simhash.near_copies(docs).collect() if r["component_id"] is not None}
    assert sorted(r["doc_id"] for r in rows) == sorted(found)
    assert left.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()
    # Exact copies go, texts that share little stay.
    assert not {r["doc_id"] for r in rows} & set(range(60, 68)) and len(rows) >= 55


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (1, "q r s t u v", "z"), (2, "h i j k l m n", "x")]
    left = [
        sorted(map(tuple, simhash.one_of_each(
            spark.createDataFrame(order, "doc_id bigint, text string, lang string").repartition(n)
        ).collect()))
        for order, n in ((rows, 1), (rows[::-1], 3), (rows[1:] + rows[:1], 2))
    ]
    assert left[0] == left[1] == left[2] and [r[0] for r in left[0]] == [1, 2]


def test_empty_table(spark):
    docs = none_of(hard_docs(spark, random.Random(5)))
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(path + star + [(5000, 5000), (-3, -7)], "a bigint, b bigint")
    found = {r["id"]: r["component_id"] for r in common.components(edges).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {-3: -7, -7: -7}
    assert found == want


def test_ranks_number_each_group_without_gaps(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    found = common.ranked(rows, "g", ["id"], F.col("id"), rows_per_part=100).groupBy("g").agg(
        F.count_distinct("rank").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.count("*").alias("n"),
    )
    assert all(r["d"] == r["n"] and r["low"] == 0 and r["high"] == r["n"] - 1 for r in found.collect())
