"""Hashes and differences of fixed-size numeric grids held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference_hash(grid: Column, side: int) -> Column:
    """Bits "right neighbour is larger" of a row-major square grid, as hex (4 bits per digit).

    A side of n gives n - 1 bits per row; rows are padded on the left to whole digits.
    """
    bits = [
        F.when(F.element_at(grid, r * side + c + 2) > F.element_at(grid, r * side + c + 1), "1").otherwise("0")
        for r in range(side)
        for c in range(side - 1)
    ]
    return F.lpad(F.lower(F.conv(F.concat(*bits), 2, 16)), side * side // 4, "0")


def dct_basis(size: int) -> np.ndarray:
    """Orthonormal DCT-II basis."""
    at = np.arange(size)
    basis = np.cos(np.pi * np.outer(at, 2 * at + 1) / (2 * size)) * np.sqrt(2.0 / size)
    basis[0] /= np.sqrt(2.0)
    return basis


def dct_hashes(images: np.ndarray, low: int = 8) -> list[str]:
    """Perceptual hash of a stack of square images: low-frequency block against its median."""
    basis = dct_basis(images.shape[1])
    block = np.einsum("fi,nij,gj->nfg", basis[:low], images, basis[:low]).reshape(len(images), -1)
    bits = block > np.median(block[:, 1:], axis=1)[:, None]
    return [np.packbits(row).tobytes().hex() for row in bits]


def perceptual_hash(grid: Column, side: int) -> Column:
    """DCT hash of a row-major square grid, in Arrow batches; grids are resized to 32 x 32."""
    times = max(1, 32 // side)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=str)
        stack = np.stack(values.to_numpy()).astype(float).reshape(-1, side, side)
        return pd.Series(dct_hashes(stack.repeat(times, axis=1).repeat(times, axis=2)))

    return run(grid)


def motion(df: DataFrame, clip, order: str, grid: str, name: str) -> DataFrame:
    """Absolute change from the previous grid of the clip; zeros for its first one."""
    before = F.lag(grid).over(Window.partitionBy(*clip).orderBy(order))
    change = F.zip_with(F.col(grid), F.coalesce("_before", F.col(grid)), lambda a, b: F.abs(a - b))
    return df.withColumn("_before", before).withColumn(name, change).drop("_before")
