"""Exact largest inner products by a uniform threshold in three phases.

The components are cut into ``LISTS`` segments; a segment's share of the inner product is a vector's
local score, so a total is the sum of one entry of each local list. First every block of vectors
gathers the heads of its local lists, and the k-th best total among them is a safe cutoff of the
query: the true k-th best is no lower. The cutoff goes out with the query. A vector reaches it only
if one of its local scores reaches the cutoff's equal share, so the blocks collect just those
entries, and their remaining scores are resolved exactly in whole numbers. More lists make the share
smaller and collect more: two collect 1 to 3 % of all pairs of the given tables, four 14 to 20 %.

Blocks hold a bounded number of vectors and stay in one task each; the queries stream past them, so a
vector is shuffled once whatever the number of queries. What leaves a block is at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.llm.common import join_groups
from dayledger.llm.vectors import quantised, stacked_whole
from dayledger.session import kept

BEST = 5
LISTS = 2
#: Vectors of a block, by the number of vectors and of cores, and blocks that give heads of lists
#: (a cutoff is safe whichever blocks do).
LEAST_BLOCK, MOST_BLOCK = 4096, 65_536
HEADS = 64
#: Scores that a task holds at a time.
HELD = 1 << 21
#: No cutoff: fewer vectors than wanted were gathered.
NONE = -(2**63)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole rows of ``a`` and ``b``, exact, in the narrowest kind that holds them."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    for kind, limit in ((np.float32, 2**24), (np.float64, 2**53), (np.int64, 2**62)):
        if most < limit:
            return a.astype(kind) @ b.astype(kind).T
    return a.astype(object) @ b.astype(object).T


def resolved(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The totals of pairs of rows; beyond 64 bits the nearest 64-bit number."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**62:
        return np.einsum("ij,ij->i", q, x)
    totals = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([min(max(t, -(2**63)), 2**63 - 1) for t in totals], np.int64)


def segments(dim: int, lists: int) -> list[slice]:
    """The components of each local list."""
    ends = [dim * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def first(owner: np.ndarray, ids: np.ndarray, totals: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each owner, ties to the smaller id."""
    order = np.lexsort((ids, ~totals, owner))
    sorted_owner = owner[order]
    starts = np.searchsorted(sorted_owner, sorted_owner)
    return order[np.arange(len(order)) - starts < k]


class Block:
    """The vectors of a block and what it answers to queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: int):
        self.ids, self.x, self.parts = ids, x, segments(x.shape[1], lists)

    def heads(self, q: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of the k first entries of every local list."""
        found = []
        few = min(k, len(self.ids))
        for part in self.parts:
            scores = exact(q[:, part], self.x[:, part])
            best = np.argpartition(-scores, few - 1, axis=1)[:, :few]
            found.append(np.repeat(np.arange(len(q)), few) * len(self.ids) + best.ravel())
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))

    def sufficient(self, q: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of the entries that may reach the cutoff."""
        # The least whole number that is an equal share; without a cutoff every entry is collected.
        share = cutoff // len(self.parts) + (cutoff % len(self.parts) != 0)
        known = np.repeat((cutoff == NONE)[:, None], len(self.ids), 1)
        for part in self.parts:
            known |= (exact(q[:, part], self.x[:, part]) >= share[:, None]).astype(bool)
        return np.nonzero(known)

    def answers(self, numbers: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int, phase: str) -> pd.DataFrame:
        """The k best totals of each query among the block's heads or sufficient entries."""
        rows = max(1, HELD // max(1, len(self.ids)))
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        for i in range(0, len(q), rows):
            some, limit = q[i : i + rows], cutoff[i : i + rows]
            at, place = getattr(self, phase)(some, limit, k)
            for j in range(0, len(at), HELD // 16):
                a, p = at[j : j + HELD // 16], place[j : j + HELD // 16]
                total = resolved(some[a], self.x[p])
                good = total >= limit[a]
                found.append((a[good] + i, self.ids[p[good]], total[good]))
        owner, ids, totals = (np.concatenate(c) for c in zip(*found, strict=True))
        best = first(owner, ids, totals, k)
        return pd.DataFrame({"number": numbers[owner[best]], "vec_id": ids[best], "score": totals[best]})


def answerer(k: int, lists: int, phase: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reads each block's vectors, then the queries that stream past it."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for batch in batches:
            for key, own in batch.groupby(["dim", "block", "asks"], sort=True):
                if key[:2] != at:
                    at, held, block = key[:2], [], None
                x = stacked_whole(own["x"], key[0])
                if not key[2]:
                    held.append((own["id"].to_numpy(np.int64), x))
                    continue
                if held:
                    block = Block(*(np.concatenate(c) for c in zip(*held, strict=True)), lists)
                    held = []
                if block:
                    yield block.answers(
                        own["id"].to_numpy(np.int64), x, own["cutoff"].to_numpy(np.int64), k, phase
                    )

    return answer


def met(points: DataFrame, asked: DataFrame, blocks: int, k: int, lists: int, phase: str) -> DataFrame:
    """Every query's answers from each of ``blocks`` blocks: number, vec_id, score."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    rows = points.where(F.col("block") < blocks).select(
        "dim", "block", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "x",
        F.lit(NONE).cast("bigint").alias("cutoff"),
    ).union(asked.select("dim", every, F.lit(1), "number", "x", "cutoff"))
    dealt = rows.repartition(blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    return dealt.mapInPandas(answerer(k, lists, phase), "number bigint, vec_id bigint, score bigint")


def ranks(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each number, with their place."""
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best(
    df: DataFrame, is_query: Column | str, k: int = BEST, id_col: str = "vec_id", vector_col: str = "embedding",
    lists: int = LISTS, block: int | None = None, heads: int = HEADS,
) -> DataFrame:
    """Each query's k largest inner products of whole components: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` (of column ``vec_id``) holds; candidates are all rows
    with another id; fewer than k candidates are all returned; ties go to the smaller id. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part; zero vectors
    do, vectors of different lengths are not compared. Rows that repeat an id and vector are one row;
    an id with several vectors asks with each. A score beyond 64 bits is the nearest 64-bit number. Other columns are not read; an empty table
    gives an empty result.

    Equal vectors are one query, and k + 1 of the smallest ids of a vector are all that a result can
    hold, so groups of copies stay small.
    """
    k += 1  # a query's own row may be among its best
    own = quantised(df, id_col, vector_col).where("vec_id IS NOT NULL").distinct().withColumn("dim", F.size("x"))
    own = kept(own, "vectors")
    copies = Window.partitionBy("x").orderBy("vec_id")
    points = own.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k)
    asking = own.where(is_query)
    n = own.count()
    if block is None:
        cores = own.sparkSession.sparkContext.defaultParallelism
        block = min(max(LEAST_BLOCK, n // (4 * cores)), MOST_BLOCK)
    blocks = max(1, -(-n // block))
    points = kept(
        points.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x"),
        "points",
    )
    asked = kept(asking.select("dim", "x").distinct().withColumn("number", F.monotonically_increasing_id()), "asked")
    none = F.lit(NONE).cast("bigint")
    gathered = met(points, asked.withColumn("cutoff", none), min(blocks, heads), k, lists, "heads")
    cutoffs = ranks(gathered, k).where(F.col("place") == k).select("number", F.col("score").alias("cutoff"))
    limited = kept(
        asked.join(cutoffs, "number", "left").withColumn("cutoff", F.coalesce("cutoff", none)), "limited"
    )
    found = kept(ranks(met(points, limited, blocks, k, lists, "sufficient"), k), "found")
    named = asked.select("dim", "x", "number")
    asks = join_groups(asking.select("vec_id", "dim", "x"), named, ["dim", "x"]).select(
        F.col("vec_id").alias("query_id"), "number"
    )
    answered = asks.join(found.select("number", "vec_id", "score"), "number").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "number").orderBy(F.col("score").desc(), "vec_id")
    return answered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") < k).select(
        "query_id", "rank", "vec_id", "score"
    )
