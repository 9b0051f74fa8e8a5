import numpy as np
import pytest

from dayledger.llm import whitening

from .helpers import none_of

SCHEMA = "vec_id bigint, embedding array<float>, x string, n string, component string"


def filled(vectors):
    return [(i, v, "x", "y", "z") for i, v in vectors]


def brute(vectors):
    """n, S, eigenvalues, eigenvectors and trace over the distinct vectors, by plain algebra."""
    x = np.array(sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for _, v in vectors}), float)
    y = x - x.mean(0)
    v = y.T @ y / len(y)
    values, turn = np.linalg.eigh(v)
    return len(x), x.sum(0).astype(int), values[::-1], turn[:, ::-1], np.trace(v)


def planted(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.linspace(1, 0.7, dim) * 0.2 + 0.1
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    # A group of copies: one vector in a third of the rows counts once.
    return rows + [(n + i, rows[7][1]) for i in range(n // 2)]


def against(found, rows):
    n, sums, values, turn, trace = brute(rows)
    byid = {}
    for r in found:
        byid.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, v in rows:
        x = np.floor(256 * np.float32(v).astype(float)).astype(int)
        own = sorted(byid[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, min(4, len(v)) + 1))
        w = (x - sums / n) @ turn[:, :4] / np.sqrt(values[:4])
        got = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.sign(w * got)
        assert got == pytest.approx(w * signs, abs=1e-9)
        for r, e in zip(own, values, strict=False):
            assert r["n"] == n and r["deviation"] == int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)))
            assert r["explained"] == pytest.approx(e / trace, rel=1e-10)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("dim", [2, 5, 50])
def test_against_plain_algebra(spark, dim):
    rows = planted(400, dim)
    found = whitening.whiten(spark.createDataFrame(filled(rows), SCHEMA)).collect()
    assert len(found) == len(rows) * min(4, dim)
    against(found, rows)


def test_odd_vectors(spark):
    """Null, empty, non-finite and damaged vectors go; zero vectors, repeated rows and null ids stay."""
    rows = planted(60, 6) + [(500, [0.0] * 6), (501, [0.0] * 6), (502, [9.0] + [0.0] * 5)]
    odd = [(600, None), (601, []), (602, [float("nan")] * 6), (603, [float("inf")] + [1.0] * 5), (604, [None] + [1.0] * 5)]
    df = spark.createDataFrame(filled(rows + odd), SCHEMA)
    found = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in found} == {i for i, _ in rows}
    against(found, rows)
    again = spark.createDataFrame(filled(rows + [rows[3], (None, rows[4][1])]), SCHEMA)
    assert whitening.whiten(again).count() == 4 * (len(rows) + 2)


def test_lengths_apart_and_components_without_variance(spark):
    short = [(1000 + i, [0.01 * i, 0.02 * i]) for i in range(40)]
    rows = planted(50, 5)
    found = whitening.whiten(spark.createDataFrame(filled(rows + short), SCHEMA)).collect()
    against([r for r in found if r["vec_id"] < 1000], rows)
    assert {r["n"] for r in found if r["vec_id"] >= 1000} == {40}
    line = [(i, [float(i), float(i), float(i)]) for i in range(20)]
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(filled(line), SCHEMA)).collect()} == {1}
    same = spark.createDataFrame(filled([(i, [1.0, 2.0]) for i in range(5)]), SCHEMA)
    assert whitening.whiten(same).count() == 0


def test_large_numbers(spark):
    """Sums stay exact; a deviation beyond 64 bits is null."""
    rows = [(i, [float(2**i), 1.0]) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(filled(rows), SCHEMA)).collect()
    assert {r["n"] for r in found} == {40} and {r["deviation"] for r in found} == {None}
    assert whitening.whiten(spark.createDataFrame(filled([(1, [3e38, 1.0]), (2, [-3e38, 1.0])]), SCHEMA)).count() == 2


def test_certified_components_of_a_close_spectrum():
    """Plain matrices whose wanted values lie near the next ones, and of low rank."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.linspace(2, 1, 200), np.r_[5.0, 5.0, 4.9, 4.8, np.full(196, 4.5)], np.r_[np.ones(3), np.zeros(197)]):
        v = (turn * values) @ turn.T
        got, vectors = whitening.components(lambda q, v=v: v @ q, 200, 4)
        assert got == pytest.approx(np.sort(values)[::-1][:4], abs=1e-12)
        assert vectors.T @ vectors == pytest.approx(np.eye(4), abs=1e-12)
        assert v @ vectors == pytest.approx(vectors * got, abs=1e-10)


def test_empty_table(spark):
    assert whitening.whiten(none_of(spark.createDataFrame(filled(planted(9, 3)), SCHEMA))).count() == 0
