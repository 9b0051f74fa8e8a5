"""A Merkle manifest of a table: one tree of digests per source, and one over the sources.

A parent is the digest of up to ``FAN`` nodes' digests, as hex text in order. While it is built it
keeps a copy of the hash state before each of its slots. To fold a changed node up the tree, the
parent resumes the state before that slot and takes in the new digest and the siblings to the right
only; the siblings to the left are in the state.

Spark holds the tree in blocks of ``LEVELS`` levels. One grouped job takes the digests of every block
to its root, and the roots are the nodes of the next, ``FAN ** LEVELS`` times smaller table, until
each tree has one node. The way back gives every block its siblings above it, and the lowest blocks
fold their leaves. A block holds a bounded number of nodes however many leaves a source has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.llm.common import join_groups
from dayledger.operators.slices import sliced
from dayledger.session import kept

FAN = 16
#: Levels of a block, and the nodes of blocks that are handled at a time.
LEVELS = 3
BLOCK = FAN**LEVELS
ROWS = 4096
#: One document in so many is tampered with.
TAMPERED = 5

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, index bigint, n bigint, digest string"
PATHS = "tree string, block bigint, subroot string, root string, lefts array<string>, rights array<string>"
FOLDED = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean, tampered boolean"
)


def field(value: Column) -> Column:
    """A value in a leaf: its length in bytes and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def tree_of(source: Column) -> Column:
    """The name of a source's tree: never null, null first in the order of bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


class Parent:
    """The digest of a run of nodes, and the hash state before each of them."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state, self.states, self.children = sha256(), [], children
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return b"".join(self.children[:slot])

    def right(self, slot: int) -> bytes:
        return b"".join(self.children[slot + 1 :])


def resumed(state, replacement: bytes, right: bytes) -> bytes:
    """The digest of a parent whose hash stood at ``state`` before a child that is replaced."""
    state = state.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels that a block of a tree of ``n`` nodes has above them."""
    levels = 0
    while levels < LEVELS and FAN**levels < n:
        levels += 1
    return levels


def built(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of a block's nodes, level by level."""
    found = []
    for _ in range(levels):
        found.append([Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)])
        digests = [p.digest for p in found[-1]]
    return found


def blocks(nodes: pd.DataFrame) -> Iterator[tuple[str, int, pd.DataFrame, list[list[Parent]]]]:
    """The blocks among ``nodes``: tree, number, the nodes in order, and their parents."""
    for (tree, block), own in nodes.groupby(["tree", "block"], sort=False):
        own = own.sort_values("index")
        yield tree, block, own, built([d.encode() for d in own["digest"]], levels_of(int(own["n"].iloc[0])))


def raised(nodes: pd.DataFrame) -> pd.DataFrame:
    """The roots of blocks."""
    rows = []
    for tree, block, own, parents in blocks(nodes):
        root = parents[-1][0].digest.decode() if parents else own["digest"].iloc[0]
        rows.append((tree, block, -(-int(own["n"].iloc[0]) // BLOCK), root))
    return pd.DataFrame(rows, columns=["tree", "index", "n", "digest"])


def above(paths: pd.DataFrame) -> dict[tuple[str, int], tuple]:
    """What lies above each block: subroot, root, and the siblings on both sides, level by level."""
    return {
        (r.tree, r.block): (r.subroot, r.root, list(r.lefts), list(r.rights))
        for r in paths.itertuples(index=False)
    }


def lowered(nodes: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
    """What lies above each node of the blocks, given what lies above the blocks."""
    rows, known = [], above(paths)
    for tree, block, own, parents in blocks(nodes):
        subroot, root, lefts, rights = known[tree, block]
        for place, number in enumerate(own["index"]):
            slots = [(place // FAN**level, level) for level in range(len(parents))]
            sides = [(parents[level][at // FAN], at % FAN) for at, level in slots]
            rows.append((
                tree, number, subroot, root,
                [p.left(s).decode() for p, s in sides] + lefts, [p.right(s).decode() for p, s in sides] + rights,
            ))
    return pd.DataFrame(rows, columns=["tree", "block", "subroot", "root", "lefts", "rights"])


def folded(leaves: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
    """The leaves of whole blocks with proof and the root that their tampered digest folds to."""
    rows, known = [], above(paths)
    for tree, block, own, parents in blocks(leaves):
        subroot, root, lefts, rights = known[tree, block]
        up = [(sha256(left.encode()), right.encode()) for left, right in zip(lefts, rights, strict=True)]
        outside = b"".join(x.encode() for pair in zip(lefts, rights, strict=True) for x in pair)
        shared: dict[int, bytes] = {}
        for place, (doc_id, digest, changed) in enumerate(
            zip(own["doc_id"], own["digest"], own["changed"], strict=True)
        ):
            folding, at = (changed or digest).encode(), place
            for level in parents:
                parent, slot = level[at // FAN], at % FAN
                folding = resumed(parent.states[slot], folding, parent.right(slot))
                at //= FAN
            for state, right in up:
                folding = resumed(state, folding, right)
            proof = b""
            if parents:
                first, slot = place // FAN, place % FAN
                if first not in shared:
                    at, upper = first, []
                    for level in parents[1:]:
                        upper += [level[at // FAN].left(at % FAN), level[at // FAN].right(at % FAN)]
                        at //= FAN
                    shared[first] = b"".join(upper)
                proof = parents[0][first].left(slot) + parents[0][first].right(slot) + shared[first]
            rows.append((
                None if pd.isna(doc_id) else int(doc_id), digest, subroot, root, sha256(proof + outside).hexdigest(),
                folding.decode(), folding.decode() == root, changed is not None,
            ))
    columns = [c.split()[0] for c in FOLDED.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their index in their tree, from 0, and the tree's number of rows.

    Slices of the order are numbered on their own, so that a source of any size is in many tasks.
    """
    spread = rows.withColumn("__row", F.monotonically_increasing_id())
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = sliced(spread, ["tree", *order, "__row"], least=tasks)
    counts = cut.groupBy("tree", "__slice").agg(F.count("*").alias("__rows"))
    tree = Window.partitionBy("tree")
    starts = counts.select(
        "tree", "__slice", F.sum("__rows").over(tree).alias("n"),
        (F.sum("__rows").over(tree.orderBy("__slice")) - F.col("__rows")).alias("__start"),
    )
    inside = Window.partitionBy("tree", "__slice").orderBy(*order, "__row")
    placed = cut.withColumn("__inside", F.row_number().over(inside) - 1)
    return join_groups(placed, starts, ["tree", "__slice"]).withColumn(
        "index", F.col("__start") + F.col("__inside")
    ).drop("__row", "__slice", "__start", "__inside")


def celled(rows: DataFrame, block: Column, cells: int) -> DataFrame:
    """``rows`` with their block, and the cell of blocks that are handled together."""
    return rows.withColumn("block", block).withColumn(
        "cell", F.pmod(F.xxhash64("tree", "block"), F.lit(cells))
    )


def cells_of(nodes: DataFrame) -> int:
    return max(1, -(-nodes.count() // ROWS))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of those, until each tree has one node."""
    levels = [nodes]
    while len(levels) < 2 or (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        low = levels[-1].select(*[c.split()[0] for c in NODES.split(", ")])
        grouped = celled(low, F.floor(F.col("index") / BLOCK), cells_of(low)).groupBy("cell")
        levels.append(kept(grouped.applyInPandas(raised, NODES), "nodes"))
    return levels


def descended(
    nodes: DataFrame, paths: DataFrame, fold: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``fold`` of the nodes of whole blocks and what lies above these blocks."""
    cells = cells_of(nodes)
    low = celled(nodes, F.floor(F.col("index") / BLOCK), cells).groupBy("cell")
    return low.cogroup(celled(paths, F.col("block"), cells).groupBy("cell")).applyInPandas(fold, schema)


def manifest(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tampered.

    A leaf is the digest of doc_id, source, lang, n_chars and text; null fields, also a null id or
    source, have a form of their own. Rows of a source are ordered by id, null first, then by digest;
    rows that repeat are leaves of their own. ``tampered`` (by default one id in five by its crc32)
    marks the rows whose text loses its capitals before folding; where it is null the row is left as it
    is. ``verified`` tells whether the root folded from that row is the root. Other columns are not
    read; an empty table gives an empty result.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    own = {c: F.col(c) for c in FIELDS}
    lower = own | {"text": F.translate(F.col("text"), UPPER, UPPER.lower())}
    leaves = df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), tree_of(F.col("source")).alias("tree"),
        leaf(own).alias("digest"), F.when(tampered, leaf(lower)).alias("changed"),
    )
    levels = climbed(kept(numbered(leaves, ["doc_id", "digest"]), "leaves"))
    trees = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = climbed(kept(numbered(trees, ["name"]), "trees"))

    none = F.array().cast("array<string>")
    paths = tops[-1].select(
        "tree", F.lit(0).cast("bigint").alias("block"), F.col("digest").alias("subroot"),
        F.col("digest").alias("root"), none.alias("lefts"), none.alias("rights"),
    )
    for nodes in tops[-2::-1]:
        low = nodes.select(*[c.split()[0] for c in NODES.split(", ")])
        paths = kept(descended(low, paths, lowered, PATHS), "paths")
    names = tops[0].select("name", F.col("index").alias("block"), F.col("digest").alias("own"))
    paths = names.join(paths, "block").select(
        F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"), F.col("own").alias("subroot"),
        "root", "lefts", "rights",
    )
    for nodes in levels[-2:0:-1]:
        paths = kept(descended(nodes, paths, lowered, PATHS), "paths")
    return descended(levels[0], paths, folded, FOLDED)
