"""SimHash near duplicates by exact comparison of tiles of fingerprints.

Each text gives a 64-bit fingerprint. Equal fingerprints are one. The distinct ones are dealt into
tiles by the number of bits set in their upper and in their lower half; two tiles whose counts
differ by more than the radius in total cannot hold a linked pair and are never compared. The
others are compared whole, with exclusive-or and bit counts in numpy, block by block. A tile pair
returns links that connect what is linked in it, one per fingerprint at most, not all pairs; the
components are those of all links.

The comparison is exact and quadratic in the number of distinct fingerprints, apart from the tiles
skipped; a tile holds ``TILE`` fingerprints and a task one pair of tiles at a time.

``near_copies`` finds texts of a given similarity. Such texts differ in more bits than chance leaves to
64, so a text gets four fingerprints: pairs within ``WIDE`` bits in the first are confirmed by all 256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayledger.llm.common import as_bytes, components, join_groups
from dayledger.session import kept

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
ROWS_AT_ONCE = 64
#: Words of a shingle and similarity of near copies; fingerprints of a text, bits in which near copies
#: may differ in the first of them, and what is added to the expected number of bits in all.
WORDS = 5
SIMILAR = 0.8
PRINTS = 4
WIDE = 16
SLACK = 10
COPIES_TILE = 8192
BYTE_LANES = np.uint64(0x0101010101010101)


def hashes_of(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none of a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number; 0 of none."""
    if not len(hashes):
        return 0
    # Eight lanes of one byte each count up to 255 hashes at a time.
    starts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & BYTE_LANES, starts)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0)
    bits = counts.ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed number; a text without words has 0."""
    return majority(hashes_of(text, shingle))


def sketch(text: bytes, shingle: int = WORDS, prints: int = PRINTS) -> list[int]:
    """Several fingerprints of a text, each from other hashes of its shingles."""
    hashes, found = hashes_of(text, shingle), []
    for _ in range(prints):
        found.append(majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return found


def apart(similarity: float, prints: int = PRINTS) -> int:
    """Bits of ``prints`` fingerprints in which texts of a similarity differ, and a few more.

    A bit differs with the angle between the texts' shingles, over pi.
    """
    angle = acos(2 * similarity / (1 + similarity))
    return int(64 * prints * angle / pi + SLACK)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its signed 64-bit fingerprint; null and empty texts have 0."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"]
            )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text")
    ).mapInArrow(of_batches, "doc_id bigint, fingerprint bigint")


def tiles(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """The tiles of distinct fingerprints: high and low (bits set), part, parts, fps."""
    upper = F.shiftrightunsigned("fingerprint", 32)
    lower = F.col("fingerprint").bitwiseAND(0xFFFFFFFF)
    counted = distinct.select(
        "fingerprint", F.bit_count(upper).alias("high"), F.bit_count(lower).alias("low")
    )
    # At most 33 x 33 rows.
    parts = counted.groupBy("high", "low").agg(F.ceil(F.count("*") / tile).alias("parts"))
    dealt = counted.join(F.broadcast(parts), ["high", "low"]).withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    )
    return dealt.groupBy("high", "low", "part", "parts").agg(
        F.collect_list("fingerprint").alias("fps")
    )


def linked(
    a: np.ndarray, b: np.ndarray, same: bool, radius: int,
    confirmed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> Iterator[tuple[int, int]]:
    """Links that connect all of ``a`` and ``b`` that lie within the radius of each other and are
    ``confirmed`` by their places.

    At most one link for each of ``a`` and, after those, one for each merger among ``b``.
    """
    root = np.arange(len(b))
    for start in range(0, len(a), ROWS_AT_ONCE):
        rows = a[start : start + ROWS_AT_ONCE]
        close = np.bitwise_count(rows[:, None] ^ b[None, :]) <= radius
        if same:
            close[np.arange(len(rows)), start + np.arange(len(rows))] = False
        if confirmed is not None:
            i, j = np.nonzero(close)
            close[i, j] = confirmed(start + i, j)
        for i in np.flatnonzero(close.any(1)):
            roots = np.unique(root[close[i]])
            for r in roots:
                yield start + i, r
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a and b between fingerprints that connect all pairs at ``radius`` or fewer bits."""
    own = kept(tiles(distinct, tile), "tiles")
    parts = own.groupBy("high", "low").agg(F.max("parts").alias("other_parts"))
    offsets = F.array(*[
        F.struct(F.lit(h).alias("h"), F.lit(w).alias("l"))
        for h in range(-radius, radius + 1) for w in range(-radius, radius + 1)
        if abs(h) + abs(w) <= radius and (h, w) >= (0, 0)
    ])
    near = own.select("high", "low", "part", F.explode(offsets).alias("to")).select(
        "high", "low", "part",
        (F.col("high") + F.col("to.h")).alias("other_high"),
        (F.col("low") + F.col("to.l")).alias("other_low"),
    ).join(
        F.broadcast(parts.withColumnsRenamed({"high": "other_high", "low": "other_low"})),
        ["other_high", "other_low"],
    ).withColumn(
        "other_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("other_parts") - 1))
    ).where(
        "high <> other_high OR low <> other_low OR part <= other_part"
    )
    key = ["high", "low", "part"]
    other = own.select(*[F.col(c).alias(f"other_{c}") for c in key], F.col("fps").alias("other_fps"))
    paired = near.join(own.select(*key, "fps"), key).join(other, [f"other_{c}" for c in key])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a, b = (np.asarray(x, np.int64).view(np.uint64) for x in (row.fps, row.other_fps))
                same = (row.high, row.low, row.part) == (
                    row.other_high, row.other_low, row.other_part
                )
                found = np.array(list(linked(a, b, same, radius)), np.int64).reshape(-1, 2)
                yield pd.DataFrame({
                    "a": a[found[:, 0]].view(np.int64), "b": b[found[:, 1]].view(np.int64)
                })

    return paired.mapInPandas(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay, each
    with its component; a null id takes part but names no component unless all ids of it are null.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    printed = kept(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fingerprint"), radius))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["id"], "left").select(
        "fingerprint", "least", F.coalesce("component_id", "fingerprint").alias("root")
    )
    rooted = kept(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = kept(
        join_groups(rooted, named, ["root"]).select("fingerprint", "component_id"), "classes"
    )
    return join_groups(printed, classes, ["fingerprint"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id and prints, the fingerprints of its text."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "prints"]
            )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text")
    ).mapInArrow(of_batches, "doc_id bigint, prints array<bigint>")


def copy_links(distinct: DataFrame, limit: int, radius: int = WIDE, tile: int = COPIES_TILE) -> DataFrame:
    """Links a and b between sketches (number, prints) that connect all that differ in ``limit`` bits or
    fewer, and ``radius`` or fewer in the first fingerprint.

    Tiles go by the number of bits set in the first one; a tile meets those whose numbers differ by no
    more than the radius.
    """
    counted = distinct.withColumn("set", F.bit_count(F.col("prints")[0]))
    # At most 65 rows.
    parts = counted.groupBy("set").agg(F.ceil(F.count("*") / tile).alias("parts"))
    dealt = counted.join(F.broadcast(parts), "set").withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.stack([np.asarray(p, np.int64) for p in rows["prints"]])
        return pd.DataFrame({
            "set": rows["set"].iloc[:1], "part": rows["part"].iloc[:1],
            "ids": [rows["number"].to_numpy(np.int64).tobytes()], "prints": [prints.tobytes()],
        })

    own = kept(
        dealt.groupBy("set", "part").applyInPandas(packed, "set int, part bigint, ids binary, prints binary"),
        "copy-tiles",
    )
    upward = F.explode(F.sequence(F.col("set"), F.least(F.col("set") + radius, F.lit(64)))).alias("other_set")
    near = own.select("set", "part", upward).join(
        F.broadcast(parts.withColumnsRenamed({"set": "other_set", "parts": "other_parts"})), "other_set"
    ).withColumn(
        "other_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("other_parts") - 1))
    ).where("set <> other_set OR part <= other_part")
    other = own.select(*[F.col(c).alias(f"other_{c}") for c in ("set", "part", "ids", "prints")])
    paired = near.join(own, ["set", "part"]).join(other, ["other_set", "other_part"])

    def arrays(ids: bytes, prints: bytes) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.frombuffer(ids, np.int64)
        return numbers, np.frombuffer(prints, np.uint64).reshape(len(numbers), -1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                (ids, a), (others, b) = arrays(row.ids, row.prints), arrays(row.other_ids, row.other_prints)
                same = (row.set, row.part) == (row.other_set, row.other_part)

                def confirmed(i: np.ndarray, j: np.ndarray, a=a, b=b) -> np.ndarray:
                    return np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= limit

                found = list(linked(a[:, 0].copy(), b[:, 0].copy(), same, radius, confirmed))
                at = np.array(found, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": ids[at[:, 0]], "b": others[at[:, 1]]})

    return paired.mapInPandas(compare, "a bigint, b bigint")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR,
    shingle: int = WORDS,
) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest id among its near copies.

    Near copies share about ``similarity`` of their shingles or more, as told by 256 bits: of pairs at a
    similarity of 0.8 one in twenty is missed, at 0.9 none; of pairs at 0.7 half is taken, at 0.6 one in
    eighteen, at 0.5 one in a hundred. Texts without words are copies of each other. Null ids take part but name no component unless all ids of
    it are null. Other columns are not read; an empty table gives an empty result.
    """
    printed = kept(sketches(docs, id_col, text_col, shingle), "sketches")
    distinct = kept(
        printed.groupBy("prints").agg(F.min("doc_id").alias("least")).withColumn(
            "number", F.monotonically_increasing_id()
        ),
        "distinct-sketches",
    )
    roots = components(copy_links(distinct.select("number", "prints"), apart(similarity)))
    rooted = kept(
        distinct.join(roots, distinct["number"] == roots["id"], "left").select(
            "prints", "least", F.coalesce("component_id", "number").alias("root")
        ),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = kept(join_groups(rooted, named, ["root"]).select("prints", "component_id"), "classes")
    return join_groups(printed, classes, ["prints"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies (``near_copies``): of each component the smallest doc_id stays.

    Rows that repeat a doc_id are one document: the first row by the digest of its text stays (null is
    empty), then by that of its other columns, so reruns agree. Rows without a doc_id cannot be told
    apart and all stay. Columns stay as they are; an empty table gives an empty result.
    """
    found = near_copies(docs)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    stays = docs.join(first, docs["doc_id"] == first["__first"], "left_semi")
    # Spark prunes the window in the map tasks to one row an id each.
    others = F.xxhash64(*[F.col(c) for c in hashed(docs)])
    marked = stays.withColumns({"__text": F.md5(as_bytes(F.col("text"))), "__others": others})
    order = ["__text", "__others"]
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return marked.withColumn("__place", one).where("__place = 1").select(*docs.columns).union(
        docs.where("doc_id IS NULL")
    )


def hashed(docs: DataFrame) -> list[str]:
    """The columns that can be hashed."""
    return [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
