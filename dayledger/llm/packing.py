"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and one rest. The histogram of the rests, in classes
of a few lengths, is the demand of a cutting-stock problem: a linear program over patterns (how many
rests of each class share a sequence), whose columns are priced by knapsack dynamic programming.
The rounded patterns are applied to the rests, numbered within each class, by Spark. Histogram,
program and patterns are bounded by the number of classes, whatever the number of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayledger.llm.common import as_bytes, ranked
from dayledger.session import kept

LENGTH = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Lengths that make a class: a rest is packed as if it had the longest length of its class.
STEP = 8
#: The program stops when its value is proven to be within this part of the best.
GAP = 0.001
MAX_PIVOTS = 6000
#: Words that a task remembers the ids of (twice as many at most), and the longest one of them; bytes
#: of texts that are encoded and words that are gathered at a time.
REMEMBERED = 400_000
LONGEST = 48
BYTES = 4 << 20
GATHERED = 1 << 20

#: How a tokenizer whose words are independent prepares a text.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}

# Composed letters that have one lower-case form, and how the pattern above splits words
# of them; the bytes that a byte-level alphabet writes as the character of that number.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[int, str]:
    """The character for each byte: its own if it is printed, else one from 256 on, in order."""
    others = [b for b in range(256) if b not in PRINTED]
    return {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as the tokenizer gives them, each word encoded once.

    A tokenizer that drops white space and never joins across it (``WORDWISE``) is asked for the
    distinct words of a batch only; the ids of a text are gathered by the words' numbers. The last
    ``REMEMBERED`` words or so are kept. Words of plain letters go to the tokenizer's model, split and
    spelled as the tokenizer would, others to the tokenizer itself. Texts that hold a special token's string go to the tokenizer
    whole, unless ``plain`` makes such strings ordinary text; so do all texts with any other tokenizer.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.by_word = {k: made.get(k) for k in WORDWISE} == WORDWISE
        # Rust's pattern syntax is the same for escaped punctuation.
        special = [] if plain else [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        self.special = "|".join(special)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.short: dict[str, list[int]] = {}
        self.letters = byte_letters()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in encoded]

    def of_part(self, part: str) -> list[int]:
        """The ids of a part of a plain word; parts of one or two letters are few and kept."""
        ids = self.short.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = [token.id for token in self.tokenizer.model.tokenize(spelled)]
            if len(part) < 3:
                self.short[part] = ids
        return ids

    def of_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids as bytes, in any order."""
        others = []
        for word in words:
            if word.isascii() and word.isalpha():
                yield word, np.array(self.of_part(word.lower()), "<u4").tobytes()
            elif PLAIN.fullmatch(word):
                ids = [x for part in PARTS.findall(word.lower()) for x in self.of_part(part)]
                yield word, np.array(ids, "<u4").tobytes()
            else:
                others.append(word)
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            yield from zip(part, (x.tobytes() for x in self.whole(part)), strict=True)

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        known, older = self.known, self.older
        fresh = []
        for word in words:
            if word not in known:
                ids = older.get(word)
                if ids is None:
                    fresh.append(word)
                elif len(word) <= LONGEST:
                    known[word] = ids
        made = dict(self.of_words(fresh))
        found = [known[w] if w in known else made[w] if w in made else older[w] for w in words]
        known.update((w, x) for w, x in made.items() if len(w) <= LONGEST)
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return found

    def gathered(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts without special tokens, through their words."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        own = self.learn(words.dictionary.to_pylist())
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids = np.empty(ends[-1], "<u4")
        for i in range(0, len(at), GATHERED):
            some = at[i : i + GATHERED]
            low, high = ends[i], ends[min(i + GATHERED, len(at))]
            shift = np.repeat(first[some] - ends[i : i + len(some)], size[some])
            ids[low:high] = flat[shift + np.arange(low, high)]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return [ids[a:b] for a, b in pairwise(bounds)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (binary, not null), without the end id."""
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.large_string())
        if not self.by_word:
            return self.whole(texts.to_pylist())
        if not self.special:
            return self.gathered(texts)
        apart = pc.match_substring_regex(texts, self.special)
        if not pc.any(apart).as_py():
            return self.gathered(texts)
        by_word = iter(self.gathered(texts.filter(pc.invert(apart))))
        whole = iter(self.whole(texts.filter(apart).to_pylist()))
        return [next(whole if special else by_word) for special in apart.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)


def bounded(batch: pa.RecordBatch, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch (id, binary text) in parts of about ``most`` bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(1)).to_numpy()
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in pairwise([*starts, len(part)]):
        yield batch.slice(a, b - a)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    length: int = LENGTH, plain: bool = False,
) -> DataFrame:
    """The pieces of every document: whole sequences from its start, then the rest.

    A rest of more than half a sequence is cut there. Without that, large rests lack small ones to
    share a sequence with.
    """
    end = END.to_bytes(4, "little")

    def rows_of(doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        tokens = len(ids) + 1
        ends, rest = [*range(length, tokens, length), tokens], tokens % length
        if rest > length // 2:
            ends.insert(-1, tokens - rest + length // 2)
        start = 0
        for stop in ends:
            if stop > start:
                crc = zlib.crc32(ids[start:stop])
                yield doc_id, start, stop - start, zlib.crc32(end, crc) if stop == tokens else crc, tokens
            start = stop

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer(), plain)
        for batch in batches:
            for part in bounded(batch):
                rows = [
                    row for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True)
                    for row in rows_of(doc_id, ids)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text")
    ).mapInArrow(cut, PIECES)


def priced(worth: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The pattern of the most worth that fits: unbounded knapsack by dynamic programming."""
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    for space in range(1, room + 1):
        usable = np.searchsorted(weight, space, side="right")
        best[space], choice[space] = best[space - 1], -1
        if usable:
            value = best[space - weight[:usable]] + worth[:usable]
            k = int(value.argmax())
            if value[k] > best[space]:
                best[space], choice[space] = value[k], k
    items, space = [], room
    while space > 0:
        k = int(choice[space])
        if k < 0:
            space -= 1
        else:
            items.append(k)
            space -= int(weight[k])
    return float(best[room]), items


def program(weight: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[Counter, float]]:
    """Patterns and how often to use each, near the optimum of the linear program."""
    m = len(weight)
    patterns = [Counter({i: int(room // weight[i])}) for i in range(m)]
    inverse = np.diag([1.0 / (room // w) for w in weight])
    use = inverse @ demand
    for _ in range(MAX_PIVOTS):
        worth = np.maximum(inverse.sum(0), 0.0)
        value, items = priced(worth, weight, room)
        if value <= 1 + GAP:
            break
        pattern = Counter(items)
        column = np.zeros(m)
        for k, n in pattern.items():
            column[k] = n
        direction = inverse @ column
        rising = direction > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, use / np.where(rising, direction, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use -= step * direction
        use[out] = step
        np.maximum(use, 0.0, out=use)
        inverse[out] /= direction[out]
        direction[out] = 0.0
        touched = np.flatnonzero(direction)
        inverse[touched] -= np.outer(direction[touched], inverse[out])
        patterns[out] = pattern
    return list(zip(patterns, use, strict=True))


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (rests by weight) and how many sequences have each; they hold every rest once.

    Whole uses of a pattern come first, then patterns rounded up where the rests allow it; what is
    left fills sequences with the largest rest that fits, again and again.
    """
    weights = sorted(w for w, n in histogram.items() if n)
    if not weights:
        return []
    weight = np.array(weights)
    left = np.array([histogram[w] for w in weights])
    chosen: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        for k, n in pattern.items():
            left[k] -= n * times
        chosen.append(({int(weight[k]): n for k, n in pattern.items()}, times))

    solved = program(weight, left.astype(float), room)
    for pattern, use in solved:
        times = min([int(use + 1e-6), *(int(left[k]) // n for k, n in pattern.items())])
        if times:
            take(pattern, times)
    for pattern, use in sorted(solved, key=lambda p: int(p[1]) - p[1]):
        if use % 1 > 1e-6 and all(left[k] >= n for k, n in pattern.items()):
            take(pattern, 1)
    while left.any():
        space, pattern = room, Counter()
        k = len(weight) - 1
        while k >= 0 and space >= weight[0]:
            k = min(k, int(np.searchsorted(weight, space, side="right")) - 1)
            fits = min(int(left[k]) - pattern[k], space // int(weight[k])) if k >= 0 else 0
            if fits > 0:
                pattern[k] += fits
                space -= fits * int(weight[k])
            k -= 1
        pattern = +pattern
        take(pattern, min(int(left[k]) // n for k, n in pattern.items()))
    return chosen


def sequences_of(
    chosen: list[tuple[dict[int, int], int]]
) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """By weight: ranks at which the patterns' shares end, their first sequences, rests in each."""
    by_weight: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in chosen:
        for weight, n in pattern.items():
            by_weight.setdefault(weight, []).append((n * times, first, n))
        first += times
    found = {}
    for weight, shares in by_weight.items():
        ranks, firsts, each = (np.array(x, np.int64) for x in zip(*shares, strict=True))
        found[weight] = (np.cumsum(ranks), firsts, each)
    return found, first


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    length: int = LENGTH, step: int = STEP, plain: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Strings of special tokens in a text become those tokens, as the tokenizer has it, unless ``plain``.
    Null and empty texts are documents of the end id alone; repeated rows are documents of their
    own, also those without an id; other columns are not read; an empty table gives an empty result.
    """
    own = kept(
        pieces(docs, id_col, text_col, tokenizer, length, plain).withColumn(
            "weight", F.ceil(F.col("length") / step)
        ),
        "pieces",
    )
    room = length // step
    # At most ``length / step`` rows.
    histogram = {r["weight"]: r["n"] for r in own.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    whole = histogram.pop(room, 0)
    chosen = plan(histogram, room)
    if whole:
        chosen = [*chosen, ({room: 1}, whole)]
    shares, _ = sequences_of(chosen)
    numbered = ranked(own, "weight", ["doc_id", "start", "ids_crc32"], F.struct("doc_id", "start"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), np.int64)
            weights, ranks = batch["weight"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            for weight in np.unique(weights):
                mine = weights == weight
                ends, firsts, each = shares[int(weight)]
                at = np.searchsorted(ends, ranks[mine], side="right")
                before = np.where(at > 0, ends[at - 1], 0)
                sequence[mine] = firsts[at] + (ranks[mine] - before) // each[at]
            yield batch.drop(columns=["weight", "rank"]).assign(sequence_id=sequence)

    placed = numbered.select(*[c.split()[0] for c in PIECES.split(", ")], "weight", "rank").mapInPandas(
        place, PIECES + ", sequence_id bigint"
    )
    earlier = Window.partitionBy("sequence_id").orderBy(
        F.col("length").desc(), "doc_id", "start", "ids_crc32"
    ).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
