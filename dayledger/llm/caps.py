"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes it if their cosine reaches ``cap``. The directions are a
random product code: every pair of a code vector for the first half of the (randomly rotated)
components and one for the second half. A vector is decoded to the list of all filters it passes
from two short lists of inner products. Vectors that pass a common filter are compared, in double
precision; a pair that shares several filters counts at the first of them only.

The number of filters follows from the number of vectors, so that the vectors of a filter stay about
as many; a filter of many vectors is compared in tiles. No pair leaves a tile: what comes out is the
number of links of each vector and links that connect what is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import components, join_groups
from dayledger.llm.vectors import stacked, unit, usable, with_vectors
from dayledger.session import kept

COSINE = 0.95
#: Filters that a vector passes on average, and the fewest it takes (its best ones); vectors that a
#: filter has on average, and the least number of filters one in which a vector passes.
PASSED = 16
LEAST = 12
SHARED = 128
ONE_IN = 400
#: Vectors of a filter that are compared at a time; rows of a group of small filters.
TILE = 1024
ROWS = 4096
SEED = 7


@lru_cache(maxsize=8)
def code(dim: int, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and the code vectors of both halves, of length sqrt(1/2) each."""
    draw = np.random.default_rng([seed, dim, size])
    rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    first = dim // 2 if dim > 1 else 1
    halves = []
    for part in (first, dim - first):
        vectors = draw.standard_normal((size, part))
        halves.append(unit(vectors) * np.sqrt(0.5) if part else np.zeros((size, 0)))
    return rotation, halves[0], halves[1]


def decode(one: np.ndarray, two: np.ndarray, cap: float, least: int = LEAST) -> np.ndarray:
    """All filters i * size + j with one[i] + two[j] >= cap, in order; the best few, if fewer."""
    size = len(one)
    order = np.argsort(-two)
    best = two[order]
    rows = np.flatnonzero(one >= cap - best[0])
    upto = np.searchsorted(-best, one[rows] - cap, side="right")
    if upto.sum() >= least:
        found = [i * size + order[:n] for i, n in zip(rows, upto, strict=True)]
        return np.sort(np.concatenate(found))
    few = min(least, size)
    top = np.argsort(-one)[:few]
    sums = one[top][:, None] + best[:few][None, :]
    flat = np.argsort(-sums, axis=None)[:least]
    return np.sort(top[flat // few] * size + order[flat % few])


def passes(vectors: DataFrame, count: int) -> DataFrame:
    """Every vector once for each filter it passes: filter, number, copies, vec, dim, filters."""
    one_in = max(ONE_IN, count / SHARED)
    size = max(2, int(np.ceil(np.sqrt(PASSED * one_in))))
    tail = -NormalDist().inv_cdf(1 / one_in)

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = []
            for dim, vec in zip(batch["dim"], batch["vec"], strict=True):
                rotation, one, two = code(int(dim), size)
                x = unit(np.asarray(vec, float)[None, :]) @ rotation
                half = one.shape[1]
                lists.append(decode((x[:, :half] @ one.T)[0], (x[:, half:] @ two.T)[0], tail / dim**0.5))
            yield batch.assign(filters=lists)

    return vectors.select("number", "copies", "vec", "dim").mapInPandas(
        of_batches, "number bigint, copies bigint, vec array<double>, dim int, filters array<bigint>"
    )


def first_shared(filters: list[np.ndarray], at: int) -> np.ndarray:
    """For rows that all pass ``at``: which of them share an earlier filter."""
    earlier = [f[f < at] for f in filters]
    flat = np.concatenate(earlier)
    owner = np.repeat(np.arange(len(filters)), [len(f) for f in earlier])
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    column = np.full(len(names), -1)
    column[several] = np.arange(len(several))
    marks = np.zeros((len(filters), len(several)), np.float32)
    use = column[place] >= 0
    marks[owner[use], column[place][use]] = 1
    return marks @ marks.T > 0


def compared(x: np.ndarray, filters: list[np.ndarray], at: int, half: int, cosine: float) -> np.ndarray:
    """Which rows link, each pair at its first common filter; ``half`` > 0: only across that row."""
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    if half:
        close[:half, :half] = False
        close[half:, half:] = False
    rows = np.flatnonzero(close.any(1))
    if len(rows):
        inner = np.ix_(rows, rows)
        close[inner] &= ~first_shared([filters[r] for r in rows], at)
    return close


def forest(close: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect all that ``close`` connects, one per row or merger."""
    root = np.arange(len(close))
    for i in np.flatnonzero(close.any(1)):
        roots = np.unique(np.append(root[close[i]], root[i]))
        if len(roots) > 1:
            for r in roots[1:]:
                yield int(roots[0]), int(r)
            root[np.isin(root, roots)] = roots[0]


def linker(cosine: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of one group of whole filters, or of one tile of a large filter."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        a, b, n = [], [], []
        for (at, dim), rows in group.groupby(["filter", "dim"]):
            rows = rows.sort_values(["part", "number"])
            parts = rows["part"].to_numpy()
            split = rows["low"].iloc[0] != rows["high"].iloc[0]
            half = int((parts == parts[0]).sum()) if split else 0
            if split and half == len(rows):
                continue
            x = unit(stacked(rows["vec"], int(dim)))
            filters = [np.asarray(f, np.int64) for f in rows["filters"]]
            close = compared(x, filters, int(at), half, cosine)
            if not close.any():
                continue
            numbers = rows["number"].to_numpy(np.int64)
            links = close @ rows["copies"].to_numpy(np.int64)
            linked = np.flatnonzero(links)
            a += numbers[linked].tolist()
            b += numbers[linked].tolist()
            n += links[linked].tolist()
            for i, j in forest(close):
                a.append(int(numbers[i]))
                b.append(int(numbers[j]))
                n.append(0)
        return pd.DataFrame({"a": a, "b": b, "links": n}, dtype="int64")

    return link


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (a, b, links) of different vectors: how many links ``a`` has (a = b), or a link (0)."""
    passed = kept(passes(vectors, vectors.count()), "passes")
    rows = passed.select("*", F.explode("filters").alias("filter"))
    sizes = passed.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(
        F.count("*").alias("n")
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-total // ROWS))
    parts = kept(
        sizes.where("n > 1").select("dim", "filter", F.ceil(F.col("n") / TILE).alias("parts")), "sizes"
    )
    dealt = join_groups(rows, parts, ["dim", "filter"]).withColumn(
        "part", F.pmod(F.xxhash64("number"), F.col("parts"))
    )
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    tiled = dealt.select("*", other).withColumns({
        "low": F.least("part", "other"), "high": F.greatest("part", "other"),
        "cell": F.when(F.col("parts") == 1, F.pmod(F.xxhash64("filter", "dim"), F.lit(cells)))
        .otherwise(-1 - F.col("filter")),
    })
    return tiled.select(
        "cell", "low", "high", "dim", "filter", "part", "number", "copies", "vec", "filters"
    ).groupBy("cell", "low", "high").applyInPandas(linker(cosine), "a bigint, b bigint, links bigint")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Equal vectors are one in the search and link with each other; each row counts. Vectors of
    different lengths do not link. A vector that cannot be compared (see ``comparable``) has no links
    and is a component of its own; so is a row without an id. Other columns are not read; an empty
    table gives an empty result.
    """
    own = usable(df, id_col, vector_col).withColumns({
        "one": F.xxhash64("vec"), "two": F.xxhash64(F.lit(1), "vec")
    })
    alike = kept(
        own.groupBy("one", "two").agg(
            F.min("vec_id").alias("number"), F.count("*").alias("copies"), F.first("vec").alias("vec"),
            F.first("dim").alias("dim"),
        ),
        "vectors",
    )
    found = kept(links(alike, cosine), "links")
    counts = found.groupBy(F.col("a").alias("number")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    told = kept(
        alike.select("one", "two", "number", "copies").join(counts, "number", "left").join(
            roots.withColumnRenamed("id", "number"), "number", "left"
        ).select(
            "one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "number").alias("component_id"),
        ),
        "told",
    )
    linked = join_groups(own.select("vec_id", "one", "two"), told, ["one", "two"]).select(
        "vec_id", "n_links", "component_id"
    )
    alone = with_vectors(df, id_col, vector_col).where("NOT usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
