"""Quality of texts by compression: which of two dictionaries describes a text in fewer bytes.

One zstandard dictionary is built from lines of good labelled texts, one from lines of bad ones. A
text is compressed block by block with either; the difference of the sizes by the text's length
becomes a probability on other labelled texts (logistic calibration). Dividing by the length, not by
the compressed sizes, leaves texts that repeat themselves near 0, between the good and the bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.llm.common import as_bytes, held_out, training_sample
from dayledger.session import kept

#: Labelled texts per class that training reads, half for the dictionaries, half for calibration;
#: blocks per class that make a dictionary; bytes of a block and of a dictionary.
TEXTS = 6000
BLOCKS = 16_000
BLOCK = 512
DICTIONARY = 112_640
LEVEL = 3
#: Bytes of typical good text that every text is taken to hold besides its own: a text of a few
#: words gives little evidence against the share of good texts.
SHORT = 48
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good texts, the bytes that the latter saves on each byte of a typical
    good text, calibration and the share of good texts."""

    bad: bytes
    good: bytes
    typical: float
    slope: float
    intercept: float
    share: float


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@lru_cache(maxsize=4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)


def difference(text: bytes, bad: bytes, good: bytes, typical: float = 0.0) -> float:
    """Bytes that the dictionary of good texts saves against the other, by the text's length."""
    sizes = [
        sum(len(compressor(d).compress(block)) for block in blocks_of(text)) for d in (bad, good)
    ]
    return (sizes[0] - sizes[1] + SHORT * typical) / (len(text) + SHORT)


def differences(model: Model):
    @F.pandas_udf("double")
    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: difference(t, model.bad, model.good, model.typical)
        ).astype(float)

    return of_texts


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary trained from blocks; the blocks themselves where there are too few to train."""
    if len(blocks) >= 100:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    return b"".join(blocks)[-DICTIONARY:]


def calibration(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a small ridge."""
    scale = values.std() or 1.0
    x = np.column_stack([values / scale, np.ones(len(values))])
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-6]) * weights.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - ridge @ beta
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on a bounded sample of the labelled rows that may be learnt from.

    With one class alone, or none, scores are the share of good texts, smoothed by one of each.
    """
    sample, sizes = training_sample(labels, label, TEXTS, id_col)
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    flat = Model(b"", b"", 0.0, 0.0, float(np.log(share / (1 - share))), share)
    if len(sizes) < 2:
        return flat
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text")
    ).join(sample, "doc_id").withColumn("fit", F.xxhash64("doc_id", F.lit("fit")) % 2 == 0)
    texts = kept(texts, "training")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (label, block)
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for line in text.as_py().splitlines(keepends=True)
                for block in blocks_of(line)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                ["label", "block"],
            )

    blocks = texts.where("fit").select("label", "text").mapInArrow(split, "label int, block binary")
    # A line that many texts share counts once, and tells nothing if both classes have it.
    blocks = kept(
        blocks.groupBy("block").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").withColumn("place", F.xxhash64("block")),
        "blocks",
    )
    made = [
        dictionary([
            bytes(r["block"]) for r in
            blocks.where(F.col("label") == c).orderBy("place", "block").limit(BLOCKS).collect()
        ])
        for c in (0, 1)
    ]
    model = Model(made[0], made[1], 0.0, 0.0, flat.intercept, share)
    scored = texts.where(~F.col("fit") & (F.octet_length("text") > 0)).select(
        "label", F.octet_length("text").alias("length"), differences(model)("text").alias("value")
    ).toPandas()
    if scored["label"].nunique() < 2:
        return flat
    typical = float(scored.loc[scored["label"] == 1, "value"].median())
    values = scored["value"] + SHORT * typical / (scored["length"] + SHORT)
    drawn = scored["label"].value_counts()
    weights = scored["label"].map({c: sizes[c] / drawn[c] for c in (0, 1)}).to_numpy(float)
    slope, intercept = calibration(
        values.to_numpy(), scored["label"].to_numpy(float), weights
    )
    return Model(made[0], made[1], typical, slope, intercept, share)


def score(text: Column, model: Model) -> Column:
    """The probability that a text is good; for null and empty texts the share of good ones."""
    value = differences(model)(as_bytes(text))
    return F.when(F.octet_length(as_bytes(text)) == 0, F.lit(model.share)).otherwise(
        1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * value)))
    )


def rated(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Other columns are not read.

    Repeated rows are scored alike. A null id was never learnt from and is not held out (false).
    """
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    return own.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_ones(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return docs.where(score(F.col(text_col), train(docs, labels)) >= threshold)
