"""What the operators share: columns, stored tables, held-out rows, components and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.operators.keys import join_groups
from dayledger.session import kept

#: ASCII white space, as the words of a text are split.
WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[..., DataFrame]


def for_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return ~F.coalesce(held_out(doc_id), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def as_bytes(text: Column) -> Column:
    """A text as the bytes of its UTF-8 form; null is the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each id of ``edges`` (columns a and b, both long).

    Alternates two steps until every component is a star: every node links its larger neighbours to its
    smallest one, then its smaller neighbours to it. Each step is a minimum per node and an equi
    join; no neighbour list is gathered, so a node may have any number of links. Every round is
    written to the shared folder, which cuts the lineage and survives lost executors.

    Returns id and component_id for the ids in ``edges``; ids without an edge are not in it.
    """
    links = kept(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        larger = join_groups(both.where("b > a"), least, ["a"])
        outer = larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = outer.groupBy("a").agg(F.min("b").alias("least"))
        inner = join_groups(outer, least, ["a"])
        links = kept(
            inner.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b")))
            .where("a <> b").distinct(),
            "links",
        )
        # Done when every node has one link up at most, and none has links on either side.
        sides = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            links.select("b", F.lit(0), F.lit(1))
        ).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if sides.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id"))
    )


def ranked(
    df: DataFrame, group: str, order: list[str], spread: Column, rows_per_part: int = 20_000
) -> DataFrame:
    """Number the rows of each group from 0 in column ``rank``, however large a group is.

    A group is dealt by ``spread`` into parts of about ``rows_per_part`` rows, each numbered in a
    window of its own; the parts' counts give what to add. ``df`` is read twice.
    """
    parts = df.groupBy(group).agg(F.ceil(F.count("*") / rows_per_part).alias("__parts"))
    dealt = join_groups(df, parts, [group]).withColumn(
        "__part", F.pmod(F.xxhash64(spread), F.col("__parts"))
    )
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        group, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    numbered = dealt.withColumn("__inside", inside)
    return join_groups(numbered, starts, [group, "__part"]).withColumn(
        "rank", F.col("__start") + F.col("__inside")
    ).drop("__parts", "__part", "__inside", "__start")


def training_sample(
    labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id"
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class (doc_id, label), and the classes' sizes.

    Only rows that may be learnt from count. Ids are drawn by the hash of the id, so the draw does
    not depend on the order of the rows. Rows whose id or label is null, or whose label is not 0 or
    1, are left out; an id labelled both ways counts as 1.
    """
    usable = labels.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & for_training(F.col("doc_id")))
    known = kept(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for c in (0, 1)
    ]
    return kept(drawn[0].union(drawn[1]), "sample"), sizes
