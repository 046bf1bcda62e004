"""What the vector operators share: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Neither null nor zero nor empty, and no component null or not finite."""
    x = vector
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def equal_keys(vec: Column, fit: Column) -> list[Column]:
    """Two 64-bit hashes of a vector, null unless it is fit: vectors are equal if both are."""
    return [F.when(fit, F.xxhash64(vec)).alias("k1"), F.when(fit, F.xxhash64(F.lit(1), vec)).alias("k2")]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def hyperplanes(seed: int, dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def smallest_ids(rows: DataFrame, by: list[str], key: str, most: int, salts: int = 10) -> DataFrame:
    """For each group its `most` smallest ids, cut before the shuffle, then by salt, then whole."""
    salted = rows.select(*by, key, F.pmod(F.xxhash64(key), F.lit(salts)).alias("__salt"))
    first = Window.partitionBy(*by, "__salt").orderBy(key)
    cut = salted.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most)
    whole = Window.partitionBy(*by).orderBy(key)
    cut = cut.withColumn("__n", F.row_number().over(whole)).where(F.col("__n") <= most)
    return cut.groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("ids"))
