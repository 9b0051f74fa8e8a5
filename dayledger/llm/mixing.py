"""Mixing sources to target weights by cube-method balanced sampling.

Sources get shares of the mix by weight, none more than ``cap`` times what it has. A document of a
source with rate r (target by size) is taken floor(r) times, and once more with probability
r - floor(r). Who is taken once more is a balanced sample: the probabilities move along the null
space of two totals, words and documents, three documents at a time, until each is 0 or 1. That is
done in chunks of each source; a chunk leaves a few documents, which the next round gathers.
A few documents of different sizes stay out of each chunk. Those of a source's last round and the two
left are the landing problem: of all ways to round them, the one whose words come closest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.llm.common import WORD, join_groups, ranked
from dayledger.session import kept

#: Weights of the sources in the order of their names, repeating; what all of them share, as a part
#: of all words; how often a source may be used.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Documents that one task moves at a time.
CHUNK = 1000
#: Documents, spread over the sizes, that stay out of a source's last round for the landing; half
#: as many stay out of each chunk before.
LANDING = 10
EDGE = 1e-9


def words(text: Column) -> Column:
    """The number of words, 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Each source's size and target, from one row per unit (source, total).

    Sources are ordered by code point, null last. Those that the shares would use more than ``cap``
    times stop there and the rest is shared among the others by weight. In the order of size by
    weight the stopped ones come first, so running totals find them. The windows hold one row per
    source.
    """
    totals = sizes.groupBy("source").agg(F.sum("total").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    weighted = totals.select("source", "source_size", weight.alias("weight")).withColumn(
        "most", cap * F.col("source_size")
    )
    every = Window.partitionBy()
    earlier = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    shared = share * F.sum("source_size").over(every)
    level = (shared - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    marked = weighted.withColumns({"shared": shared, "stops": level * F.col("weight") >= F.col("most")})
    stopped = F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("stops"), F.col("most")).otherwise(
        F.least(F.col("most"), (F.col("shared") - stopped) / free * F.col("weight"))
    )
    return marked.select("source", "source_size", target.alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move ``chance`` to 0 or 1, keeping its sum and that of chance x size.

    All but two at most arrive. ``draws`` are uniform numbers, one per move; every move settles one
    unit at least.
    """
    chance = chance.copy()
    active: list[int] = []
    for i, draw in zip(range(len(size)), draws, strict=True):
        if not EDGE < chance[i] < 1 - EDGE:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = (float(size[j]) for j in active)
        step = (b - c, c - a, a - b)
        if not any(step):
            step = (1.0, -1.0, 0.0)
        now = [float(chance[j]) for j in active]
        up = min(((1 - p) if u > 0 else p) / abs(u) for p, u in zip(now, step, strict=True) if u)
        down = min((p if u > 0 else (1 - p)) / abs(u) for p, u in zip(now, step, strict=True) if u)
        by = up if draw * (up + down) < down else -down
        moved = [p + by * u for p, u in zip(now, step, strict=True)]
        for j, p in zip(active, moved, strict=True):
            chance[j] = 0.0 if p < EDGE else 1.0 if p > 1 - EDGE else p
        active = [j for j in active if 0 < chance[j] < 1]
    return np.where(chance < EDGE, 0.0, np.where(chance > 1 - EDGE, 1.0, chance))


def landing(size: np.ndarray, chance: np.ndarray, want: float, documents: float) -> np.ndarray:
    """Round the few units left so that words, and then documents, come closest to their totals."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(left):
        return chance
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    settled = chance == 1
    words_off = np.abs(ways @ size[left] + size[settled].sum() - want)
    documents_off = np.abs(ways.sum(1) + settled.sum() - documents)
    scale = max(1.0, float(size.mean()))
    chance = chance.copy()
    chance[left] = ways[(words_off / scale + documents_off / 20).argmin()]
    return chance


def mover(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Moves the units of one chunk, and rounds what is left if nothing comes after it."""

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        # Large ones first, so that what is left in the end is small.
        rows = rows.sort_values(["size", "key"], ascending=[False, True])
        size = rows["size"].to_numpy(float)
        seed = int(rows["key"].to_numpy(np.int64).view(np.uint64).sum() & np.uint64(2**63 - 1))
        draws = np.random.default_rng(seed).random(len(rows))
        before = rows["chance"].to_numpy(float)
        kept_back = np.zeros(len(rows), bool)
        open_ones = np.flatnonzero((before > EDGE) & (before < 1 - EDGE))
        back = min(LANDING if last else LANDING // 2, len(open_ones))
        kept_back[open_ones[np.linspace(0, len(open_ones) - 1, back).astype(int)]] = True
        chance = before.copy()
        chance[~kept_back] = flight(size[~kept_back], before[~kept_back], draws[~kept_back])
        if last:
            chance = landing(size, chance, float((size * before).sum()), float(before.sum()))
        return rows.drop(columns="chunk").assign(chance=chance)

    return move


def balanced(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Settle ``chance`` of every unit (source, key, size, chance, ...) to 0 or 1.

    Rounds are written to the shared folder; each leaves a few units per chunk, and the last one has
    one chunk per source.
    """
    done: DataFrame | None = None
    left = units
    schema = left.schema
    while True:
        counted = kept(left.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks")))
        chunks = counted.agg(F.max("chunks")).first()[0] or 1
        last = chunks == 1

        dealt = join_groups(left, counted, ["source"]).withColumn(
            "chunk", F.pmod(F.xxhash64("key", F.lit(chunks)), F.col("chunks"))
        ).drop("chunks")
        moved = kept(
            dealt.groupBy("source", "chunk").applyInPandas(mover(last), schema),
            "moved",
        )
        whole = F.col("chance").isin(0.0, 1.0)
        settled = moved.where(whole)
        done = settled if done is None else done.union(settled)
        if last:
            return done
        left = moved.where(~whole)


def units_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: rows that repeat id, source and text count as one unit."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
        words(F.col(text_col)).alias("size"),
    )
    grouped = rows.groupBy("doc_id", "source", "content").agg(
        F.first("size").alias("size"), F.count("*").alias("rows")
    )
    return grouped.withColumns({
        "key": F.xxhash64("doc_id", "source", "content"), "total": F.col("size") * F.col("rows")
    })


def mix_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per unit: doc_id, source, content, size, rows, source_size, target, copies.

    ``copies`` is how often the unit's rows are taken in all: as often as the rate says, and the part
    of one that is left decides by the sample.
    """
    units = kept(units_of(docs, id_col, text_col, source_col), "units")
    aims = kept(targets(units, weights, share, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = join_groups(units, aims, ["source"]).withColumn("rate", rate * F.col("rows")).withColumns({
        "sure": F.floor("rate"), "chance": F.col("rate") - F.floor("rate")
    }).drop("rate")
    return balanced(rated, chunk).withColumn(
        "copies", F.col("sure") + F.col("chance").cast("bigint")
    ).drop("sure", "chance", "key", "total")


def of_row(row: Column) -> Column:
    """How often the row of that number, from 0, of a unit is taken: the first ones once more."""
    whole = F.call_function("div", F.col("copies"), F.col("rows"))
    return whole + F.when(row < F.col("copies") % F.col("rows"), 1).otherwise(0)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    ``size`` is the number of words, ``taken`` the words that the mix takes, repeats counted.
    Null and empty texts have size 0 and are taken or not without effect on words; a null source is
    a source of its own; rows that repeat id, source and text share what the source's rate gives them,
    none once more than another by more than one; other columns are not read. An empty table gives an empty result. The outcome depends on ids and texts alone,
    not on the order or partitions of the rows.
    """
    units = mix_units(docs, **settings)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("row")
    return units.select("*", each).withColumn("copies", of_row(F.col("row"))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "source",
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows that repeat id, source and text are numbered in bounded parts to tell which of them are taken
    once more; which ones are does not matter to the mix.
    """
    chosen = mix_units(docs, **settings).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
        F.col("content").alias("__content"), "copies", "rows",
    )
    id_col, text_col, source_col = (
        settings.get(k, d) for k, d in
        (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))
    )
    own = docs.select(
        F.struct(*docs.columns).alias("__row"), F.col(id_col).cast("bigint").alias("__number"),
        F.col(source_col).cast("string").alias("__from"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"),
    )
    same = (
        F.col("__number").eqNullSafe(F.col("__id")) & F.col("__from").eqNullSafe(F.col("__source"))
        & (F.col("__text") == F.col("__content"))
    )
    met = own.join(chosen, same)
    alone = met.where("rows = 1").select("__row", "copies")
    unit = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("__id", "__content", "__source")])
    several = kept(
        met.where("rows > 1").select("__row", "copies", "rows", unit.alias("__unit")).withColumn(
            "__order", F.monotonically_increasing_id()
        ),
        "repeated",
    )
    placed = ranked(several, "__unit", ["__order"], F.col("__order")).select("__row", of_row(F.col("rank")).alias("copies"))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    taken = alone.union(placed.where("copies > 0"))
    return taken.select("__row", times.alias("__time")).select("__row.*")
