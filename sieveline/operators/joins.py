"""Joins by distance: all pairs within a radius, and the nearest few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.vectors import minkowski
from sieveline.operators import kernels as K
from sieveline.operators.blocks import block_reduce


def radius_join(left: DataFrame, right: DataFrame, radius: float, *, id: str = "id", vec: str = "features", p: float = 2.0, axes: int = 2) -> DataFrame:
    """(i, j, distance): the rows of left and right within radius of each other, that at radius included.

    Rows meet by cells of that width along the first axes features; each row of left looks into its
    own cell and those beside it, so only neighbours are compared.
    """
    if radius <= 0:
        raise ValueError("radius must be above 0")
    cell = lambda v, k: F.floor(F.coalesce(F.get(v, F.lit(k)), F.lit(0.0)) / radius)
    a = left.select(F.col(id).alias("i"), F.col(vec).cast("array<double>").alias("x"))
    b = right.select(F.col(id).alias("j"), F.col(vec).cast("array<double>").alias("y"))
    for k in range(axes):
        beside = F.explode(F.sequence(cell(F.col("x"), k) - 1, cell(F.col("x"), k) + 1))
        a, b = a.withColumn(f"c{k}", beside), b.withColumn(f"c{k}", cell(F.col("y"), k))
    near = a.join(b, [f"c{k}" for k in range(axes)]).withColumn("distance", minkowski(F.col("x"), F.col("y"), p))
    return near.where(F.col("distance") <= radius).select("i", "j", "distance")


def knn_join(left: DataFrame, right: DataFrame, k: int, *, by: str | None = None, within: float | None = None, id: str = "id", vec: str = "features", p: float = 2.0, block: int = 2048) -> DataFrame:
    """(label, i, rank, j, distance): for each row of left the k nearest of right in the same group, closer than within if that is given; ties go to the smaller id.

    Blocks of left meet blocks of right; each gives k rows for each row of left.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")

    def nearest(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        d = K.between(a, b, p)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]  # j ascends
        return pd.DataFrame({"i": np.repeat(i, order.shape[1]), "j": j[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()})

    parts = block_reduce(left, nearest, "i long, j long, distance double", other=right, by=by, id=id, vec=vec, block=block)
    if within is not None:
        parts = parts.where(F.col("distance") < within)
    rank = F.row_number().over(Window.partitionBy("label", "i").orderBy("distance", "j"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("label", "i", "rank", "j", "distance")
