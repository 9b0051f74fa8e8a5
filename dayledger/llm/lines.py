"""Line deduplication by a segment-partition edit join.

A line is read as a row of letters: its words, or its characters if it has so few words that none may
differ. Two lines link if ``allowed`` insertions, deletions and replacements of letters make one of the
other: a share of the square root of the shorter line's number of letters, so the threshold grows with
the line and the work stays in proportion to it. Cut into one segment more than that, the shorter line
has a segment that the longer one holds unchanged near the same place. So a line signs every run of its
letters that may be a segment of a line of a length in reach, lines that share a sign are brought
together, and a banded bit-parallel edit distance verifies them.

One shuffle by sign drops what no other line shares. Of signs that the same lines share the least stays;
the rest is dealt into cells, to which every text travels once; lines of a hot sign meet in tiles. No
pair leaves the task that compares it: out come the number of links of each line and links that connect
what is linked. Equal lines are one from the start, so copies of a line cost nothing in the join. Lines
are told apart by 128-bit hashes. Blank lines are not compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, groupby
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.llm.common import as_bytes, components, join_groups
from dayledger.llm.packing import bounded
from dayledger.session import kept

#: Edits that link, as a share of the square root of a line's letters: 1 from 9 letters on, 2 from 36,
#: 3 from 81, 10 from 900.
SHARE = 1 / 3
#: Lines of a sign that are compared at a time; rows of a cell of small signs.
TILE = 1024
ROWS = 4096
#: Lines up to which a sign's pairs are looked at one by one.
FEW = 16
#: Lines that a task remembers having signed or sent; bytes of texts that it reads at a time.
REMEMBERED = 200_000
BYTES = 2 << 20
#: Bits a line of the map that keeps most lines out of a join, and the most that it has in all. A full
#: map loses nothing: more lines are sent.
BITS, MOST_BITS = 16, 1 << 26
#: Bits that words and characters are counted in, for a bound on the distance.
MARKS = 256

SHOWN = re.compile(rb"[!-~]")

PLACES = "row_key binary, doc_id bigint, place bigint, id binary, signs array<bigint>"
LINKS = "a binary, b binary, links bigint"


def line_id(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def lines_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Places and lines, without the blank ones."""
    shown = SHOWN.search
    for place, line in enumerate(text.split(b"\n")):
        if shown(line) or line and not letters_of(line).isspace():
            yield place, line


def letters_of(line: bytes) -> str:
    return line.decode("utf-8", "surrogateescape")


def allowed(n: int, share: float = SHARE) -> int:
    """Edits that link a line of ``n`` letters to one of as many or more."""
    return int(share * sqrt(n) + 1e-9)


def least_words(share: float = SHARE) -> int:
    """Words from which on a line is compared by words: the fewest of which one may differ."""
    return ceil((1 / share) ** 2 - 1e-9)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of ``edits + 1`` segments of about equal size, longer ones last."""
    count = edits + 1
    size, longer = divmod(length, count)
    found, start = [], 0
    for i in range(count):
        own = size + (i >= count - longer)
        found.append((start, own))
        start += own
    return found


@lru_cache(maxsize=4096)
def probed(n: int, share: float = SHARE) -> list[tuple[int, int]]:
    """Start and size of the runs of ``n`` letters that may be a segment of a line of the same length
    or of one that is shorter by no more than its edits; the line's own segments are among them.

    Before the first segment that is unchanged, at most i edits can have moved it; after it, at most
    ``edits - i`` can, seen from the end.
    """
    found = set()
    for length in range(max(1, n - allowed(n, share)), n + 1):
        edits = allowed(length, share)
        if not edits or n - length > edits:
            continue
        shift = n - length
        for i, (start, size) in enumerate(segments(length, edits)):
            after = edits - i
            low = max(0, start - i, start + shift - after)
            high = min(n - size, start + i, start + shift + after)
            found.update((at, size) for at in range(low, high + 1))
    return sorted(found)


def signs_of(line: bytes, share: float = SHARE) -> list[int]:
    """Hashes of the runs by which a line may meet another one, from 0 on."""
    sign, found = xxhash.xxh3_64_intdigest, []
    words = line.split()
    runs = probed(len(words), share)
    if runs:
        # A word starts behind all before it and as many spaces.
        data, at = b" ".join(words), [0, *accumulate(map(len, words))]
        found = [sign(data[at[i] + i : at[i + size] + i + size - 1], 1) for i, size in runs]
    # As many words more than its partner can a line have that is compared by characters.
    if len(words) < least_words(share) + allowed(len(line), share):
        letters = line if line.isascii() else letters_of(line)
        parts = [letters[i : i + size] for i, size in probed(len(letters), share)]
        if letters is not line:
            parts = [part.encode("utf-8", "surrogateescape") for part in parts]
        found += [sign(part, 2) for part in parts]
    return found


def shared(a, b, most: int) -> int:
    """Length of the common beginning, ``most`` at most, by halving."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(a, b, edits: int) -> bool:
    """Whether the edit distance of two sequences is ``edits`` or less.

    After equal ends are cut off, the band around the diagonal is kept as bits of an integer: bit k of
    level e is set if ``k - edits`` more letters of ``a`` than of ``b`` were read with e edits or
    fewer. The places of a letter are one mask, which moves down with the band when it is used.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    start = shared(a, b, len(a))
    a, b = a[start:], b[start:]
    end = shared(a[::-1], b[::-1], len(a))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a:
        return len(b) <= edits
    width = 2 * edits + 1
    whole = (1 << width) - 1
    # Level e, before any letter of b is read: up to e letters of a were read.
    levels = [((1 << e + 1) - 1) << edits & whole for e in range(edits + 1)]
    # The mask of a letter and the step at which it was right: bit k stands for a[step + k - edits].
    masks: dict = {}
    for place in range(min(edits, len(a))):
        mask, _ = masks.get(a[place], (0, 0))
        masks[a[place]] = (mask | 1 << place + edits, 0)
    for step, letter in enumerate(b):
        entering = step + edits
        if entering < len(a):
            mask, since = masks.get(a[entering], (0, step))
            masks[a[entering]] = (mask >> step - since | 1 << 2 * edits, step)
        mask, since = masks.get(letter, (0, step))
        equal = mask >> step - since
        before, after = levels, []
        for e, level in enumerate(before):
            reached = level & equal
            if e:
                reached |= before[e - 1] >> 1 | before[e - 1] | after[-1] << 1
            after.append(reached & whole)
        levels = after
        if not levels[-1]:
            return False
    return bool(levels[edits] >> (len(a) - len(b) + edits) & 1)


def marks(letters: Iterable) -> int:
    """Whether each of ``MARKS`` classes of letters occurs an odd number of times, as bits.

    An edit changes two of them at most.
    """
    odd = 0
    for letter in letters:
        odd ^= 1 << (hash(letter) % MARKS)
    return odd


class Line:
    """A line as it is compared."""

    def __init__(self, line: bytes, share: float):
        self.line, self.share = line, share
        self.words = line.split()
        self.letters = letters_of(line)
        self.word_marks, self.letter_marks = marks(self.words), marks(self.letters)

    @cached_property
    def signs(self) -> set[int]:
        """As Spark holds them, from -2^63 on."""
        return {x - (x >> 63 << 64) for x in signs_of(self.line, self.share)}

    def may_link(self, other: Line) -> bool:
        """Not ruled out by lengths and marks."""
        n, m = len(self.words), len(other.words)
        edits = allowed(min(n, m), self.share)
        if edits:
            return abs(n - m) <= edits and (self.word_marks ^ other.word_marks).bit_count() <= 2 * edits
        n, m = len(self.letters), len(other.letters)
        edits = allowed(min(n, m), self.share)
        return abs(n - m) <= edits and (self.letter_marks ^ other.letter_marks).bit_count() <= 2 * edits

    def links(self, other: Line) -> bool:
        """Whether their edit distance is within the threshold."""
        edits = allowed(min(len(self.words), len(other.words)), self.share)
        if edits:
            return within(self.words, other.words, edits)
        edits = allowed(min(len(self.letters), len(other.letters)), self.share)
        return edits > 0 and within(self.letters, other.letters, edits)


def table_of(lines: list[Line]) -> tuple[np.ndarray, ...]:
    """Numbers of words and letters, and the marks as 64-bit numbers."""
    def split(odd: int) -> list[int]:
        return [odd >> i & (1 << 64) - 1 for i in range(0, MARKS, 64)]

    return (
        np.array([len(x.words) for x in lines], np.int64), np.array([len(x.letters) for x in lines], np.int64),
        np.array([split(x.word_marks) for x in lines], np.uint64).reshape(-1, MARKS // 64),
        np.array([split(x.letter_marks) for x in lines], np.uint64).reshape(-1, MARKS // 64),
    )


def pairs_of(lines: list[Line], share: float) -> Iterator[tuple[int, int]]:
    """Pairs of lines that their lengths and marks do not rule out, the smaller place first."""
    if len(lines) <= FEW:
        for i, x in enumerate(lines):
            for j in range(i + 1, len(lines)):
                if x.may_link(lines[j]):
                    yield i, j
        return

    def near(n: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edits = np.floor(share * np.sqrt(np.minimum(n[:, None], n[None, :])) + 1e-9).astype(np.int64)
        differ = sum(np.bitwise_count(odd[:, None, i] ^ odd[None, :, i]).astype(np.int64) for i in range(odd.shape[1]))
        return edits, (np.abs(n[:, None] - n[None, :]) <= edits) & (differ <= 2 * edits)

    words, letters, word_marks, letter_marks = table_of(lines)
    edits, by_words = near(words, word_marks)
    _, by_letters = near(letters, letter_marks)
    yield from map(tuple, np.argwhere(np.triu(np.where(edits > 0, by_words, by_letters), 1)).tolist())


def linker(share: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Compares the lines of each sign of a cell.

    A pair counts at the first sign that it shares. Out come the number of links of each line (a = b),
    and links (0) that connect all that is linked.
    """

    def link(met: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        counts: dict[bytes, int] = {}
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        read = {number: Line(line, share) for number, line in zip(texts["id"], texts["line"], strict=True)}
        met = met.sort_values(["sign", "low", "high"], kind="stable")
        rows = zip(*(met[c].tolist() for c in ("sign", "low", "high", "id", "part")), strict=True)
        for (sign, low, high), group in groupby(rows, lambda r: r[:3]):
            numbers, parts = zip(*(r[3:] for r in group), strict=True)
            own = [read[n] for n in numbers]
            for i, j in pairs_of(own, share):
                if low != high and parts[i] == parts[j]:
                    continue
                x, y, a, b = own[i], own[j], numbers[i], numbers[j]
                if min(x.signs & y.signs) != sign or not x.links(y):
                    continue
                counts[a] = counts.get(a, 0) + 1
                counts[b] = counts.get(b, 0) + 1
                up[root(a)] = root(b)
        found = [(a, a, n) for a, n in counts.items()] + [(a, root(a), 0) for a in up if root(a) != a]
        return pd.DataFrame(found, columns=["a", "b", "links"]).astype({"links": "int64"})

    return link


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits for the rows that hold an id and a text."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("-")).cast("binary")
    return F.unhex(F.md5(F.concat(number, F.lit(b":"), as_bytes(F.col(text_col)))))


def arrow(columns: dict[str, Iterable], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], list(kinds))


def places_of(docs: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    """Every line that is not blank, with its signs where the task has not signed it lately."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[bytes] = set()
        for batch in batches:
            for part in bounded(batch, BYTES):
                lines, places, numbers, signs, ends = [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    before = len(places)
                    for place, line in lines_of(text):
                        number = line_id(line)
                        if number not in signed:
                            if len(signed) >= REMEMBERED:
                                signed.clear()
                            signed.add(number)
                            signs += signs_of(line, share)
                        places.append(place)
                        numbers.append(number)
                        ends.append(len(signs))
                    lines.append(len(places) - before)
                owner = pa.array(np.repeat(np.arange(len(lines)), lines))
                flat = pa.array(np.array(signs, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2).take(owner), part.column(0).take(owner), pa.array(places, pa.int64()),
                        pa.array(numbers, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                    ],
                    [c.split()[0] for c in PLACES.split(", ")],
                )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"),
        row_key(id_col, text_col).alias("row_key"),
    ).mapInArrow(read, PLACES)


def spot(number: bytes, bits: int) -> int:
    return int.from_bytes(number[:7], "big") % bits


def map_of(ids: DataFrame) -> tuple[bytes, int]:
    """A bit map in which the bit of every id is set, sized by their number up to ``MOST_BITS``."""
    bits = 1 << 10
    count = ids.count()
    while bits < min(BITS * count, MOST_BITS):
        bits *= 2
    at = F.pmod(F.conv(F.substring(F.hex("id"), 1, 14), 16, 10).cast("bigint"), F.lit(bits))
    words = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("mask")
    ).toPandas()
    found = np.zeros(bits // 64, np.int64)
    found[words["word"]] = words["mask"]
    return found.astype("<i8").tobytes(), bits


def texts_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """id and line of ``ids``, and of a few more."""
    packed, bits = map_of(ids)
    kinds = {"id": pa.binary(), "line": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for part in bounded(batch, BYTES):
                made: dict[str, list] = {c: [] for c in kinds}
                for text in part.column(1).to_pylist():
                    for _, line in lines_of(text):
                        number = line_id(line)
                        at = spot(number, bits)
                        if not packed[at >> 3] >> (at & 7) & 1 or number in sent:
                            continue
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(number)
                        made["id"].append(number)
                        made["line"].append(line)
                yield arrow(made, kinds)

    own = docs.select(F.lit(0).alias("nothing"), as_bytes(F.col(text_col)).alias("text"))
    return own.mapInArrow(read, "id binary, line binary").dropDuplicates(["id"])


def meeting(places: DataFrame) -> DataFrame:
    """The lines of every sign that several share: sign, id, n (of that sign), first (the least id).

    Signs are dealt once. Of signs with the same lines the least is kept; the first sign that a pair
    shares is always among those.
    """
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signs = places.where(F.size("signs") > 0).select(F.explode("signs").alias("sign"), "id")
    sign = Window.partitionBy("sign")
    same = ["n", "first", "last", "mix_0", "mix_1"]
    # Nearly all signs have one line, which may be told by several tasks: they go before anything else.
    met = signs.repartition(tasks, "sign").withColumns({
        "first": F.min("id").over(sign), "last": F.max("id").over(sign),
    }).where("first <> last").distinct().withColumns({
        "n": F.count("*").over(sign), "mix_0": F.bit_xor(F.xxhash64("id")).over(sign),
        "mix_1": F.bit_xor(F.xxhash64(F.lit(1), "id")).over(sign),
    })
    met = kept(met, "met")
    least = met.groupBy(*same).agg(F.min("sign").alias("sign")).select("sign")
    return kept(met.join(least, "sign", "left_semi").select("sign", "id", "n", "first"), "members")


def links_of(docs: DataFrame, text_col: str, places: DataFrame, share: float) -> DataFrame:
    """Rows (a, b, links): how many lines ``a`` links to, in parts (a = b), and links that connect."""
    met = meeting(places)
    texts = texts_of(docs, text_col, met.select("id").distinct())
    cells = max(1, -(-met.count() // ROWS))
    parts = F.ceil(F.col("n") / TILE)
    dealt = met.select(
        "sign", "id", "n", "first", F.pmod(F.xxhash64("id"), parts).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"),
    ).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    # Signs of a group of lines have its least line in common and meet in one cell, unless they are many.
    sizes = met.where(F.col("n") <= TILE).groupBy("first").agg((F.count("*") > ROWS).alias("many"))
    dealt = dealt.join(kept(sizes, "sizes"), "first", "left")
    common = F.when(F.col("many"), F.xxhash64("first", "sign")).otherwise(F.xxhash64("first"))
    cell = F.when(F.col("n") > TILE, F.xxhash64("sign", "low", "high")).otherwise(F.pmod(common, F.lit(cells)))
    rows = kept(dealt.select(cell.alias("cell"), "sign", "low", "high", "id", "part"), "cells")
    # Columns of their own, so that the two sides can be grouped together.
    wanted = rows.select("cell", "id").distinct().join(texts, "id").select(
        *[F.col(c).alias(c) for c in ("cell", "id", "line")]
    )
    return rows.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInPandas(linker(share), LINKS)


def line_classes(places: DataFrame, links: DataFrame) -> DataFrame:
    """Every line that is not blank: row_key, place, id, first, links.

    ``first`` is the first place (doc_id, row_key, place) of the class of lines that links connect,
    ``links`` the number of other lines linked directly.
    """
    lines = kept(places.groupBy("id").agg(F.min(F.struct("doc_id", "row_key", "place")).alias("first")), "firsts")
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = kept(components(links.select("a", "b")).withColumnRenamed("component_id", "root"), "roots")
    rooted = lines.join(roots, "id")
    of_class = join_groups(
        rooted.select("id", "root"), rooted.groupBy("root").agg(F.min("first").alias("class_first")), ["root"]
    ).join(counts, "id").select("id", "class_first", "links")
    classes = lines.join(of_class, "id", "left").select(
        "id", F.coalesce("class_first", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return join_groups(places.select("row_key", "place", "id"), classes, ["id"])


def free_name(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """The documents with all their columns, ``text`` without lines seen before, and line_info.

    Of each class of lines the first one stays, in the order of doc_id (null first) and place.
    ``line_info`` (with underlines behind it, if the table has such a column) lists the lines that are
    not blank: place, stays, class_doc, class_place, links. Null texts are empty; blank lines stay;
    rows that repeat id and text are one row for this purpose, and all stay alike; an empty table gives
    an empty result.
    """
    places = kept(places_of(docs, id_col, text_col, share), "places")
    links = kept(links_of(docs, text_col, places, share), "links")
    stays = (F.col("first.row_key") == F.col("row_key")) & (F.col("first.place") == F.col("place"))
    info = line_classes(places, links).select(
        "row_key",
        F.struct(
            "place", stays.alias("stays"), F.col("first.doc_id").alias("class_doc"),
            F.col("first.place").alias("class_place"), "links",
        ).alias("line"),
    ).groupBy(F.col("row_key").alias("__key")).agg(F.collect_set("line").alias("__lines"))
    gone = F.transform(F.filter("__lines", lambda x: ~x["stays"]), lambda x: x["place"])
    told = info.select("__key", F.sort_array("__lines").alias("__lines"), gone.alias("__gone"))
    name = free_name(docs.columns, "line_info")
    joined = docs.join(told, row_key(id_col, text_col) == F.col("__key"), "left").select(
        *[as_bytes(F.col(c)).alias(c) if c == text_col else c for c in docs.columns],
        F.col("__lines").alias(name), "__gone",
    )

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, gone = batch.schema.get_field_index(text_col), batch.column(batch.num_columns - 1)
            some = pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False)
            left = []
            for text, out in zip(batch.column(at).filter(some), gone.filter(some), strict=True):
                places = set(out.as_py())
                left.append(b"\n".join(x for i, x in enumerate(text.as_py().split(b"\n")) if i not in places))
            columns = batch.columns[:-1]
            columns[at] = pc.replace_with_mask(columns[at], some, pa.array(left, columns[at].type))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    whole = joined.mapInArrow(shortened, joined.drop("__gone").schema)
    return whole.select(*[F.col(c).cast("string").alias(c) if c == text_col else c for c in whole.columns])
