import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from dayledger.llm import manifest

from .helpers import none_of

SCHEMA = (
    "doc_id bigint, source string, lang string, n_chars bigint, text string, "
    "tree string, digest string, block int, index int, n string"
)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [*row[:4], text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tops(nodes):
    """All levels of a tree over ``nodes``, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        run = level[place // 16 * 16 : place // 16 * 16 + 16]
        yield run[: place % 16], run[place % 16 + 1 :]
        place //= 16


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = own, tops([leaf_of(r) for r in own])
    whole = tops([trees[s][1][-1][0] for s in order])
    found = []
    for at, s in enumerate(order):
        own, levels = trees[s]
        for place, r in enumerate(own):
            sides = [*siblings(levels, place), *siblings(whole, at)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf_of(r, lower=changed)
            for left, right in sides:
                node = digest(*left, node, *right)
            proof = digest(*["".join(left + right) for left, right in sides])
            found.append((r[0], leaf_of(r), levels[-1][0], whole[-1][0], proof, node, node == whole[-1][0], changed))
    return sorted(found, key=str)


def table(sizes, rng):
    rows, number = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Ab cD", "é漢\U0001f600 X", "plain", "Q" * rng.randint(1, 300)])
            rows.append((number, source, rng.choice([None, "en", ""]), rng.choice([None, -3, 7]), text))
            number += rng.randint(1, 3)
    return rows


def filled(rows):
    return [(*r, "x", "y", 1, 2, "z") for r in rows]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1}, {None: 1, "a": 1}, {"a": 17, "b": 16, None: 15, "": 1},
        {"é": 257, "z": 4097, "Z": 33, None: 2, "~": 1} | {f"s{i}": 1 + i % 3 for i in range(30)},
    ],
)
def test_against_plain_trees(spark, sizes):
    rows = table(sizes, random.Random(len(sizes)))
    found = manifest.manifest(spark.createDataFrame(filled(rows), SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_odd_rows(spark):
    """Null ids, repeated rows, an id with two texts, a long text."""
    rows = [(None, "a", "en", 1, "Text"), (3, "a", "en", 1, "Text"), (3, "a", "en", 1, "Text"), (3, "a", "en", 1, "Other")]
    rows += [(None, None, None, None, None), (10**18, "a", "en", 1, "Long " * 200_000)]
    found = manifest.manifest(spark.createDataFrame(filled(rows), SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_deeper_blocks(spark, monkeypatch):
    """Small blocks give several tables of nodes, also over the sources."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = table({f"s{i}": 1 + i % 40 for i in range(40)} | {"big": 700}, random.Random(5))
    # Functions reach the workers by value here, so that they see the changed constants.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(manifest)
    try:
        found = manifest.manifest(spark.createDataFrame(filled(rows), SCHEMA)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(manifest)
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "a", "en", 1, "Capital" if i % 2 else "small") for i in range(200)]
    found = manifest.manifest(spark.createDataFrame(filled(rows), SCHEMA), F.col("doc_id") < 100)
    for r in found.collect():
        assert r["tampered"] == (r["doc_id"] < 100)
        assert r["verified"] == (not (r["doc_id"] < 100 and r["doc_id"] % 2))


def test_a_resumed_state_reads_only_what_follows():
    children = [digest(str(i)).encode() for i in range(16)]
    parent = manifest.Parent(children)
    for slot in range(16):
        new = digest("new").encode()
        whole = sha256(b"".join(children[:slot] + [new] + children[slot + 1 :])).hexdigest()
        assert manifest.resumed(parent.states[slot], new, parent.right(slot)).decode() == whole


def test_empty_table(spark):
    assert manifest.manifest(none_of(spark.createDataFrame(filled(table({"a": 2}, random.Random(1))), SCHEMA))).count() == 0
