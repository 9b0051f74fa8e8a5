"""Which vectors take part in a search, and their arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(vec_id: Column, vec: Column) -> Column:
    """Whether a vector can be compared, never null.

    Not if it is null, empty or zero, or holds null or non-finite components, or has no id.
    """
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vec, lambda x: x != 0)
    return vec_id.isNotNull() & F.coalesce(finite & some, F.lit(False))


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and x, the whole numbers floor(scale * component); components as doubles.

    Rows whose vector is null or holds null or non-finite components are left out. What goes beyond
    64 bits becomes the nearest 64-bit number.
    """
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(vec, lambda v: F.floor(v * F.lit(float(scale)))).alias("x"),
    )


def with_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (array of double) and whether it can be compared."""
    return df.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")
    ).withColumn("usable", comparable(F.col("vec_id"), F.col("vec")))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec and dim (its length) of the vectors that can be compared."""
    own = with_vectors(df, id_col, vector_col).where("usable")
    return own.select("vec_id", "vec", F.size("vec").alias("dim"))


def stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, dim))
    return np.stack([np.asarray(v, float) for v in vectors])


def stacked_whole(vectors: pd.Series, dim: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, dim), np.int64)
    return np.stack([np.asarray(v, np.int64) for v in vectors]).reshape(len(vectors), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
