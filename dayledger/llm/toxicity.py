"""Toxicity by a linear classifier that is fitted against counterfactuals.

Features are the words and beginnings of words that tell toxic texts from others. The fit minimises the logistic loss plus
a penalty on the change of the score when a term for a group of people in a labelled text is swapped
for another term of its kind or for a word that is no feature, so that the mention of a group alone
does not raise the score, whichever group it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import held_out, training_sample
from dayledger.session import kept

#: Labelled texts per class that training reads; words it may use; how surely a word must tell the
#: classes apart (log-likelihood ratio).
TEXTS = 10_000
WORDS = 1000
EVIDENCE = 12.0
RIDGE = 1e-4
#: Weight of the counterfactual penalty.
SAME = 20.0
#: Bytes of a word's beginning that count as features, so that its endings need not all be learnt.
STEMS = (4, 5, 6)
STEPS = 600
THRESHOLD = 0.3

#: Terms for groups of people that may stand for each other.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("old", "young"), ("deaf", "blind", "disabled"),
)

#: Bytes that are not letters in ASCII part words, capitals become small; other
#: punctuation and spaces outside ASCII part words too.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKS = re.compile("[\\u0080-\\u00bf\\u00d7\\u00f7\\u2000-\\u206f\\u3000-\\u303f\\ufeff]")


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a text, and their beginnings, marked by a hyphen."""
    text = text or ""
    if not text.isascii():
        text = MARKS.sub(" ", text).lower()
    words = set(text.encode("utf-8", "replace").translate(LETTERS).split())
    stems = {w[:n] + b"-" for n in STEMS for w in words if len(w) > n}
    return words | stems


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found = words_of(text) & self.weights.keys()
        total = self.intercept + sum(self.weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def swaps(rows: list[list[int]], kinds: list[list[int]]) -> np.ndarray:
    """Pairs of features (from, to), one for each swap of a term in a labelled text; -1 is no feature."""
    found = []
    for row in rows:
        present = set(row)
        for kind in kinds:
            for term in present.intersection(kind):
                found += [(term, other) for other in [*kind, -1] if other not in present]
    return np.array(found, np.int64).reshape(-1, 2)


def fit(
    rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, features: int,
    kinds: list[list[int]], same: float = SAME, steps: int = STEPS,
) -> tuple[float, np.ndarray]:
    """Intercept and feature weights, by Adam steps over all rows."""
    flat = np.array([f for row in rows for f in row], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    pairs = swaps(rows, kinds)
    weights = weights / weights.sum()
    share = float((weights * labels).sum())
    beta = np.zeros(features + 1)
    beta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(1, steps + 1):
        z = beta[-1] + np.bincount(owner, beta[flat], len(rows))
        off = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.append(np.bincount(flat, off[owner], features), off.sum())
        slope[:-1] += RIDGE * beta[:-1]
        if len(pairs):
            level = np.append(beta[:-1], 0.0)
            change = same * (level[pairs[:, 0]] - level[pairs[:, 1]]) / len(rows)
            slope[:-1] += np.bincount(pairs[:, 0], change, features)
            slope[:-1] -= np.bincount(pairs[:, 1] % (features + 1), change, features + 1)[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        beta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(beta[-1]), beta[:-1]


def evidence(both: Column, toxic: Column, texts: int, toxic_texts: int) -> Column:
    """Log-likelihood ratio of a word's texts (``both``) and its toxic texts."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = toxic_texts / texts
    return 2 * (part(toxic, both * share) + part(both - toxic, both * (1 - share)))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", groups: tuple[tuple[str, ...], ...] = GROUPS, same: float = SAME,
) -> Model:
    """Fit on a bounded sample of the labelled rows that may be learnt from.

    With one class alone, or none, scores are the share of toxic texts, smoothed by one of each.
    """
    sample, sizes = training_sample(labels, label, TEXTS, id_col)
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    flat = Model(float(np.log(share / (1 - share))))
    if len(sizes) < 2:
        return flat

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "words": [sorted(words_of(t)) for t in batch["text"]],
            })

    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).join(sample, "doc_id").mapInPandas(
        distinct_words, "doc_id bigint, label int, words array<binary>"
    )
    read = kept(read, "training")
    drawn = {r["label"]: r["count"] for r in read.groupBy("label").count().collect()}
    if len(drawn) < 2:
        return flat
    terms = [[t.encode() for t in group] for group in groups]
    counted = read.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("texts"), F.sum("label").alias("toxic")
    )
    telling = counted.withColumn(
        "evidence", evidence(F.col("texts"), F.col("toxic"), sum(drawn.values()), drawn[1])
    ).where(F.col("evidence") >= EVIDENCE).orderBy(F.col("evidence").desc(), "word").limit(WORDS)
    # The beginning of a term would carry its weight past the penalty.
    beginnings = {t[:n] + b"-" for group in terms for t in group for n in STEMS}
    listed = [w for w in (bytes(r["word"]) for r in telling.collect()) if w not in beginnings]
    listed += [t for group in terms for t in group if t not in set(listed)]
    place = {word: i for i, word in enumerate(listed)}

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "row": [[place[w] for w in words if w in place] for words in batch["words"]],
            })

    rows = read.mapInPandas(used, "doc_id bigint, label int, row array<int>").toPandas()
    rows = rows.sort_values(["doc_id", "label"]).reset_index(drop=True)
    weights = rows["label"].map({c: sizes[c] / drawn[c] for c in (0, 1)}).to_numpy(float)
    intercept, beta = fit(
        [list(r) for r in rows["row"]], rows["label"].to_numpy(float), weights, len(listed),
        [[place[t] for t in group] for group in terms], same,
    )
    return Model(intercept, {w: float(b) for w, b in zip(listed, beta, strict=True) if b})


def rated(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Other columns are not read.

    Null and empty texts have the score of a text without any known word. Repeated rows are scored
    alike. A null id was never learnt from and is not held out (false).
    """

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype(float)

    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return own.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        scores(F.coalesce("text", F.lit(""))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
