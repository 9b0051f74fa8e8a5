"""Secrets in texts: fixed shapes, and strings that look random to two Markov models of characters.

Everything is DataFrame expressions. Places of matches come from the pieces between them: splitting
a text at a pattern and extracting the pattern give, in turn, what lies between and what matches, so
running lengths are the places, counted in code points.

The models are counts of pairs of neighbouring characters in two kinds of labelled strings: the
values that the fixed shapes find are random strings, other long words that are built like names are
ordinary identifiers. A long word is a secret if the random model explains it better by more than a margin
for each pair and in total.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.session import kept

#: The shapes, in the order of their names in a list of spans, and what a match needs.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
#: Words that the models read: long runs of the characters of keys and identifiers.
WORD = r"[A-Za-z0-9+/_=-]{16,}"
#: Fixed value: words built like names, of parts in letters: snake_case, kebab-case, CamelCase.
NAME = r"^[A-Z]?[a-z]+(?:[_-]?[A-Z]?[a-z]+)*$"
#: Weight of a character's own share against the counts of its pairs.
BACK_OFF = 8.0
#: Strings of each kind that training reads.
STRINGS = 20_000
#: Mean and total log-likelihood ratio that a secret exceeds.
EACH = 1.0
TOTAL = 20.0
#: Characters of the models are ASCII.
SIZE = 128


def matches(text: Column, pattern: str) -> Column:
    """Start, end and string of every match, leftmost first and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,match:string>>)").alias("spans"),
    )

    def step(done: Column, one: Column) -> Column:
        begin = done["at"] + F.length(one["before"])
        end = begin + F.length(one["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), one["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    both = F.zip_with(found, between, lambda m, b: F.struct(b.alias("before"), m.alias("match")))
    return F.aggregate(F.slice(both, 1, F.size(found)), start, step, lambda done: done["spans"])


def none() -> Column:
    return F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,match:string>>)")


def where_found(text: Column, pattern: str) -> Column:
    """The matches; texts without any are told by one search."""
    return F.when(text.rlike(pattern), matches(text, pattern)).otherwise(none())


def value_of(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def with_shapes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the matches of each shape and of long words: assign, access, hex, words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        where_found(text, ASSIGN).alias("assign"), where_found(text, ACCESS).alias("access"),
        where_found(text, HEX).alias("hex"), where_found(text, WORD).alias("words"),
    )
    return read.withColumn(
        "assign", F.filter("assign", lambda x: F.length(value_of(x["match"])) >= LEAST_VALUE)
    )


def apart(span: Column, *others: str) -> Column:
    """Whether a span overlaps none of the spans in the columns ``others``."""
    every = F.concat(*[F.col(c) for c in others])
    return ~F.exists(every, lambda x: (x["start"] < span["end"]) & (span["start"] < x["end"]))


def pairs_of(string: Column) -> Column:
    """Numbers of the pairs of neighbouring characters; the strings are ASCII."""
    codes = F.transform(F.split(string, ""), lambda c: F.ascii(c))
    return F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1),
        lambda a, b: a * SIZE + b,
    )


def sampled(found: DataFrame, strings: Column) -> DataFrame:
    """At most ``STRINGS`` distinct strings of at least two characters, drawn by their hash."""
    return found.select(F.explode(strings).alias("string")).where(
        F.length("string") > 1
    ).distinct().orderBy(F.xxhash64("string"), "string").limit(STRINGS)


def counts(strings: DataFrame) -> list[int]:
    seen = strings.select(F.explode(pairs_of(F.col("string"))).alias("pair")).groupBy("pair").count()
    found = [0] * (SIZE * SIZE)
    for row in seen.collect():
        if 0 <= row["pair"] < len(found):
            found[row["pair"]] = row["count"]
    return found


def smoothed(found: list[int]) -> list[float]:
    """Log probabilities of a character after another one.

    Counts of a pair are filled up by ``BACK_OFF`` of the second character's own share, so a
    character that a kind of string hardly has stays unlikely after any other.
    """
    seconds = [sum(found[second::SIZE]) + 0.5 for second in range(SIZE)]
    every = sum(seconds)
    logs = []
    for first in range(SIZE):
        row = found[first * SIZE : (first + 1) * SIZE]
        total = sum(row) + BACK_OFF
        logs += [math.log((n + BACK_OFF * s / every) / total) for n, s in zip(row, seconds, strict=True)]
    return logs


def train(found: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters, random against ordinary.

    Random strings are the labelled values and keys of the shapes, ordinary ones the long words that
    overlap none of them and are built like names. Both samples are bounded.
    """
    values = F.concat(
        F.transform("assign", lambda x: value_of(x["match"])),
        F.transform("access", lambda x: x["match"]), F.transform("hex", lambda x: x["match"]),
    )
    words = F.transform(
        F.filter("words", lambda x: apart(x, "assign", "access", "hex") & x["match"].rlike(NAME)),
        lambda x: x["match"],
    )
    random, ordinary = (smoothed(counts(sampled(found, s))) for s in (values, words))
    return [a - b for a, b in zip(random, ordinary, strict=True)]


def ratio(string: Column, model: list[float]) -> Column:
    """Total log-likelihood ratio of a string."""
    table = F.split(F.lit(" ".join(map(repr, model))), " ").cast("array<double>")
    return F.aggregate(
        pairs_of(string), F.lit(0.0), lambda total, pair: total + F.coalesce(F.get(table, pair), F.lit(0.0))
    )


def printed(spans: Column) -> Column:
    """kind:start:end of every span, by start and then by kind, joined by commas."""
    ordered = F.sort_array(spans)
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(
            ":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"], x["end"]
        )),
        ",",
    )


def of_kind(column: str, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")
    ))


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    each: float = EACH, total: float = TOTAL,
) -> DataFrame:
    """One row per document: doc_id, assign, access, hex, random (spans with their strings).

    Random spans are long words that overlap no other span. Null and empty texts have no spans;
    repeated rows are scanned alike; other columns are not read; an empty table gives an empty
    result. Texts are read once; the matches go to the shared folder.
    """
    found = kept(with_shapes(docs, id_col, text_col), "matches")
    model = train(found)
    random = F.filter("words", lambda x: apart(x, "assign", "access", "hex") & (
        ratio(x["match"], model) > F.greatest(F.lit(total), each * (F.length(x["match"]) - 1))
    ))
    return found.withColumn("random", random).drop("words")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts by shape, the digest of the shapes' spans, all spans as text."""
    base = F.concat(*[of_kind(k, k) for k in KINDS[:3]])
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(printed(base), 256).alias("base_sha256"),
        printed(F.concat(base, of_kind("random", "random"))).alias("spans"),
    )
