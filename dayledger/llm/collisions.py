"""Nearest neighbours by counting collisions of random projections.

Every vector is projected on ``PROJECTIONS`` random lines; a block of vectors keeps one sorted array
per line. Around a query's own projection a window opens on every line. A vector that lies in enough
of the windows is a candidate and is compared with the query in full. The windows widen, by the same
factor on all lines, until the query's k-th best candidate is nearer than the distance for which the
windows stand; every vector as near as that has by then been a candidate with high probability.

Largest inner product becomes least distance by one more component: all vectors are divided by the
largest length and filled up to length 1, queries are scaled to length 1.

Blocks hold a bounded number of vectors and are searched by bounded groups of queries. The best of
each block meet in one window per query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.llm.vectors import stacked, usable
from dayledger.session import kept

NEAREST = 20
PROJECTIONS = 64
#: Half the width of a window, in units of the distance it stands for.
WIDTH = 1.4
#: Standard deviations by which the least count lies below what a vector at that distance expects.
SURE = 2.0
#: The first distance and the factor by which it grows.
FIRST = 0.8
WIDER = 1.15
#: Vectors of a block and queries that search it at a time.
BLOCK = 4096
QUERIES = 4096
#: Queries of a group whose windows are found together.
AT_ONCE = 256
SEED = 5


@lru_cache(maxsize=8)
def lines(dim: int, projections: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, projections))


def least_count(projections: int, width: float = WIDTH, sure: float = SURE) -> int:
    """Windows that a vector at the distance they stand for is in, but for ``sure`` deviations."""
    hit = erf(width / sqrt(2))
    return max(1, ceil(projections * hit - sure * sqrt(projections * hit * (1 - hit))))


class Block:
    """The vectors of a block, of one length, their sorted projections and their places in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, projections: int):
        self.ids, self.x, self.longest = ids, x, longest
        scaled = x / longest
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        self.lines = lines(x.shape[1], projections)
        projected = (np.column_stack([scaled, rest]) @ self.lines).T
        order = projected.argsort(1, kind="stable")
        self.values = np.take_along_axis(projected, order, 1)
        places = np.arange(len(x), dtype=np.int32)
        self.places = np.empty((projections, len(x)), np.int32 if len(x) >= 1 << 15 else np.int16)
        np.put_along_axis(self.places, order, places.astype(self.places.dtype)[None, :], 1)
        self.least = least_count(projections)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First places in the windows around the projections ``at``, and their numbers of places."""
        low = np.stack([v.searchsorted(p - half) for v, p in zip(self.values, at.T, strict=True)], 1)
        high = np.stack([v.searchsorted(p + half, "right") for v, p in zip(self.values, at.T, strict=True)], 1)
        kind = self.places.dtype
        return low.astype(kind), (high - low).astype(kind.str.replace("i", "u"))

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        """For each query the nearest found, nearest first, ties to the smaller id; none that has the
        query's id."""
        lengths = np.sqrt(np.einsum("ij,ij->i", q, q))
        at = (q / lengths[:, None]) @ self.lines[:-1]
        seen = self.ids[None, :] == own[:, None]
        best: list[list[tuple[float, int]]] = [[] for _ in own]
        offset = np.empty_like(self.places)
        inside = np.empty(self.places.shape, bool)
        active, distance = np.arange(len(own)), FIRST
        while len(active):
            low, wide = self.windows(at[active], WIDTH * distance)
            left = []
            for i, first, width in zip(active, low, wide, strict=True):
                # How many windows hold the vector: its place from the window's first one on.
                np.subtract(self.places, first[:, None], out=offset)
                np.less(offset.view(width.dtype), width[:, None], out=inside)
                counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16)
                # No two vectors of length 1 are further apart than 2.
                new = np.flatnonzero(((counts >= self.least) | (distance >= 2)) & ~seen[i])
                seen[i, new] = True
                # A product with all rows is quicker than picking out a good part of them.
                many = 8 * len(new) > len(self.x)
                scores = (self.x @ q[i])[new] if many else self.x[new] @ q[i]
                best[i] = sorted(
                    best[i] + [(-float(scores[j]), int(self.ids[new[j]])) for j in top(scores, self.ids[new], k)]
                )[:k]
                enough = self.longest * lengths[i] * (1 - distance * distance / 2)
                if distance < 2 and (len(best[i]) < k or -best[i][-1][0] < enough):
                    left.append(i)
            active, distance = np.array(left, np.int64), min(2.0, distance * WIDER)
        return [[(number, -score) for score, number in found] for found in best]


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    among = np.flatnonzero(scores >= least)
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def searcher(k: int, projections: int, longest: float) -> Callable:
    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        for dim, own in points.groupby("dim"):
            mine = asked[asked["dim"] == dim]
            if not len(mine):
                continue
            own = own.sort_values("vec_id")
            block = Block(own["vec_id"].to_numpy(np.int64), stacked(own["vec"], int(dim)), longest, projections)
            numbers, vectors = mine["vec_id"].to_numpy(np.int64), stacked(mine["vec"], int(dim))
            for start in range(0, len(numbers), AT_ONCE):
                some = numbers[start : start + AT_ONCE]
                for number, found in zip(some, block.search(some, vectors[start : start + AT_ONCE], k), strict=True):
                    rows += [(int(number), i, s) for i, s in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    return search


def nearest(
    df: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id",
    vector_col: str = "embedding", projections: int = PROJECTIONS, block: int = BLOCK,
    queries: int = QUERIES,
) -> DataFrame:
    """Each query's k largest inner products found: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` (of column ``vec_id``) holds; candidates are all rows
    with another id; fewer than k candidates are all returned. Vectors that cannot be compared, and
    rows without an id, take no part; vectors of different lengths are not compared. Rows that
    repeat an id and vector are one row. Other columns are not read; an empty table gives an empty
    result.
    """
    own = kept(usable(df, id_col, vector_col).dropDuplicates(["vec_id", "vec"]), "vectors")
    asked = own.where(is_query)
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    totals = own.agg(F.count("*").alias("n"), F.max(F.sqrt(squares)).alias("longest")).first()
    blocks = max(1, ceil(totals["n"] / block))
    groups = max(1, ceil(asked.count() / queries))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = own.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every_group,
        "vec_id", "vec", "dim",
    )
    spread = asked.select(
        every_block, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"),
        "vec_id", "vec", "dim",
    )
    found = dealt.groupBy("block", "group").cogroup(spread.groupBy("block", "group")).applyInPandas(
        searcher(k, projections, totals["longest"] or 1.0),
        "query_id bigint, vec_id bigint, score double",
    )
    place = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    )
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
