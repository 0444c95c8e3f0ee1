"""Shared by the two embedding operators: usable vectors, matrices of them, and a sample to fit on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: A rotation, centres and codebooks are fitted on about so many vectors, those whose id has a hash in one residue class.
FIT = 20_000


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: rows with an id and a vector of finite numbers, not all zero, of the most common length; of several vectors of one id the least. v is float if the input is, else double. Staged."""
    if not isinstance(df.schema[id_col].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be an integer column, not {df.schema[id_col].dataType.simpleString()}")
    kind = df.schema[vec_col].dataType
    number = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return staged(rows.where(F.size("v") == (size["n"] if size else 0)).groupBy("id").agg(F.min("v").alias("v")), "vectors")


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dims) of a list column of one length, in double, every row of length 1."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(n, -1)) if n else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # by the largest entry first, so that no square overflows or vanishes
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sample(vectors: DataFrame, n: int, most: int = FIT) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of about `most` of the n vectors (all, if there are fewer), chosen by the hash of their id and in order of it."""
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(n // most + 1)) == 0).toPandas().sort_values("id")
    return some["id"].to_numpy(), unit(np.array(some["v"].tolist())) if len(some) else np.empty((0, 0))
