"""Selecting a diverse subset of each group of a feature frame (id, features, label)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators import kernels as K
from sieveline.operators.blocks import block_reduce
from sieveline.operators.quota import allocate, census
from sieveline.operators.tables import settled
from sieveline.sources.frames import check_pairs


@dataclass(frozen=True)
class MaxMin:
    """Always adds the row whose nearest pick is farthest."""

    start: int | list[int] | None = None
    p: float = 2.0
    metric: Callable | None = None

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.max_min(x, size, self.start, self.p, self.metric)

    def pick_from(self, matrix: np.ndarray, size: int) -> list[int]:
        return K.max_min(None, size, self.start, matrix=matrix)


@dataclass(frozen=True)
class MaxSum:
    """Always adds the row with the largest sum of distances from the picks."""

    start: int | list[int] | None = None
    p: float = 2.0
    metric: Callable | None = None

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.max_sum(x, size, self.start, self.p, self.metric)

    def pick_from(self, matrix: np.ndarray, size: int) -> list[int]:
        return K.max_sum(None, size, self.start, matrix=matrix)


@dataclass(frozen=True)
class OptiSim:
    r0: float | None = None
    k: int = 10
    tol: float = 0.01
    n_iter: int = 10
    p: float = 2.0
    seed: int = 42
    start: int | list[int] | None = 0
    metric: Callable | None = None

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.opti_sim(x, size, self.start, self.r0, self.k, self.tol, self.n_iter, self.p, self.seed, self.metric)[0]


@dataclass(frozen=True)
class DISE:
    r0: float | None = None
    start: int | list[int] | None = None
    tol: float = 0.05
    n_iter: int = 10
    p: float = 2.0
    metric: Callable | None = None

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.dise(x, size, self.start, self.r0, self.tol, self.n_iter, self.p, self.metric)[0]


@dataclass(frozen=True)
class GridPartition:
    bins: int
    method: str = "equisized_independent"
    seed: int = 42
    measure: str = "hypersphere_overlap"
    cs: float | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.bins, int) or not isinstance(self.method, str):
            raise TypeError("bins is an int and method a string")

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.grid_select(x, int(size), self.bins, self.method, self.seed, self.measure, self.cs)


@dataclass(frozen=True)
class FurthestCentroid:
    start: int = 0
    scaling: float = 10.0
    exact: bool = False
    metric: Callable | None = None

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.furthest_centroid(x, size, self.start, self.scaling, self.exact, self.metric)


@dataclass(frozen=True)
class NSimilarity:
    key: str = "RR"
    method: str = "isim"
    order: int = 1
    threshold: str | int | None = None
    weight: str = "fraction"
    scale: bool = True
    start: str | list[int] = "medoid"

    def pick(self, x: np.ndarray, size: int) -> list[int]:
        return K.n_similarity(x, size, self.start, self.scale, key=self.key, method=self.method, order=self.order, threshold=self.threshold, weight=self.weight)


def select(frame: DataFrame, strategy, size: int, *, by: str | None = None, allocation: str = "proportional", id: str = "id", vec: str = "features", ordered: bool = False) -> DataFrame:
    """(label, rank, id): size rows of frame, shared among the groups of column by.

    Every group is one task's, which holds its features; a group of more rows than a task can
    hold is for ``operators.large``.  A null label is a group.  Equal ids, null ids and null
    vectors raise.  ordered adds group_no: the place of the group in the whole result, groups that
    give all their rows first, then by label.
    """
    if size < 1:
        raise ValueError("size must be 1 at least")
    label = F.col(by) if by else F.lit(0)
    rows = frame.select(label.alias("label"), F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("features"))
    quota = allocate(rows, "label", size, allocation)

    def one(pdf: pd.DataFrame, n: int) -> tuple[list[int], np.ndarray]:
        pdf = pdf.sort_values("id", kind="stable")
        if pdf["id"].isna().any() or pdf["id"].duplicated().any() or pdf["features"].isna().any():
            raise ValueError("ids must be distinct, and ids and features not null")
        x = np.vstack(pdf["features"].to_numpy())
        whole = n >= len(x) and allocation == "equal" and by
        return (list(range(len(x))) if whole else strategy.pick(x, n)), pdf["id"].to_numpy()

    return _chosen(rows, one, quota, ordered)


def _chosen(rows: DataFrame, pick, quota: dict, ordered: bool) -> DataFrame:
    """(label, rank, id) of what pick(group, quota) gives for each group of rows."""
    kind = rows.schema["label"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label = None if pd.isna(key[0]) else key[0]
        n = quota.get(label, 0)
        picks, ids = pick(pdf, n) if n else ([], np.zeros(0, dtype="int64"))
        return pd.DataFrame({"label": pd.Series([label] * len(picks), dtype="object"), "rank": np.arange(len(picks), dtype="int32"), "id": ids[picks]})

    out = rows.groupBy("label").applyInPandas(one, f"label {kind}, rank int, id long")
    if not ordered:
        return out
    counts = {r[0]: r[1] for r in census(rows.select("label", "id").distinct(), "label").collect()}
    places = sorted(counts, key=lambda g: (quota.get(g, 0) < counts[g], g is not None, g))
    number = rows.sparkSession.createDataFrame([(g, i) for i, g in enumerate(places)], f"_g {kind}, group_no int")
    return out.join(F.broadcast(number), out["label"].eqNullSafe(number["_g"])).drop("_g")  # one row a group


def select_pairs(pairs: DataFrame, strategy, size: int, *, by: str | None = None, allocation: str = "proportional", tolerance: float = 1e-8, ordered: bool = False) -> DataFrame:
    """(label, rank, id): as select, from the pair frame (by, i, j, value) of distances; MaxMin and MaxSum can.

    Each group's pairs must be square and symmetric; its matrix is one task's.
    """
    if size < 1:
        raise ValueError("size must be 1 at least")
    if not hasattr(strategy, "pick_from"):
        raise TypeError(f"{type(strategy).__name__} needs features")
    check_pairs(pairs, tolerance, by)
    rows = pairs.select((F.col(by) if by else F.lit(0)).alias("label"), F.col("i").cast("long").alias("id"), "j", F.col("value").cast("double").alias("value"))
    quota = allocate(rows.select("label", "id").distinct(), "label", size, allocation)

    def one(pdf: pd.DataFrame, n: int) -> tuple[list[int], np.ndarray]:
        matrix = pdf.pivot(index="id", columns="j", values="value").to_numpy()
        return strategy.pick_from(matrix, n), np.sort(pdf["id"].unique())

    return _chosen(rows, one, quota, ordered)


def complement(frame: DataFrame, chosen: DataFrame, id: str = "id") -> DataFrame:
    """The rows that were not chosen."""
    return frame.join(chosen.select(F.col("id").alias(id)), id, "left_anti")


def medoids(frame: DataFrame, *, by: str | None = None, id: str = "id", vec: str = "features", p: float = 2.0, block: int = 2048) -> DataFrame:
    """(label, id) of each group's row with the least sum of distances from the others; ties go to the smaller id.

    Blocks of rows meet blocks of rows; only sums leave a task.
    """

    def sums(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"i": i, "s": K.between(a, b, p).sum(axis=1)})

    parts = block_reduce(frame, sums, "i long, s double", by=by, id=id, vec=vec, block=block)
    total = parts.groupBy("label", "i").agg(F.sum("s").alias("s"))
    # sums are rounded so that ties do not hang on the order of adding
    return total.groupBy("label").agg(F.min(F.struct(F.round("s", 9), "i")).alias("m")).select("label", F.col("m.i").alias("id"))


def random_rows(frame: DataFrame, size: int, seed: int = 42, *, id: str = "id") -> DataFrame:
    """A simple random sample of size rows: those of the least hashes of seed and id, however frame is partitioned."""
    return frame.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id))), id).limit(size)


def width_binned(frame: DataFrame, column: str, bins: int, *within: str) -> DataFrame:
    """frame with bin, the equal-width bin of column (in each group of within); the largest value has a bin of its own."""
    w = Window.partitionBy(*within) if within else None
    if w is None:
        ends = frame.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        frame = frame.crossJoin(F.broadcast(ends))  # one row
    else:
        frame = frame.withColumn("_lo", F.min(column).over(w)).withColumn("_hi", F.max(column).over(w))
    value = F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    return frame.withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), value).otherwise(0).cast("int")).drop("_lo", "_hi")


def frequency_binned(frame: DataFrame, column: str, bins: int, *within: str) -> DataFrame:
    """frame with bin, the equal-frequency bin of column in each group of within.

    Edges are order statistics: the values' counts, one row a distinct value, are sorted by range,
    and each range adds what lies before it, so that no task has all of a group.
    """
    counts = frame.where(F.col(column).isNotNull()).groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    group = [f"_g{i}" for i in range(len(within))]
    ranged = counts.repartitionByRange(*group, "_v").sortWithinPartitions(*group, "_v")
    ranged = settled(ranged.withColumn("_part", F.spark_partition_id()))
    # what lies before each range of a group: a row for each range and group
    sizes = ranged.groupBy(*group, "_part").agg(F.sum("_c").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_size").over(Window.partitionBy(*group)))
    a, b = ranged.alias("a"), sizes.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_part")])
    spans = a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in (*group, "_part", "_v", "_c")], "_before", "_n")
    inside = F.sum("_c").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = spans.withColumn("_end", F.col("_before") + inside).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda m: F.least(F.lit(m) * F.col("_n") / bins, F.col("_n") - 1)
    part = lambda m, f: F.max(F.when((F.col("_start") <= f(at(m))) & (f(at(m)) < F.col("_end")), F.col("_v")))
    ends = spans.groupBy(*group).agg(*[part(m, F.floor).alias(f"_l{m}") for m in range(bins + 1)], *[part(m, F.ceil).alias(f"_h{m}") for m in range(bins + 1)], F.max("_n").alias("_n"))
    edge = [F.col(f"_l{m}") + (F.col(f"_h{m}") - F.col(f"_l{m}")) * (at(m) - F.floor(at(m))) for m in range(bins + 1)]
    edges = ends.select(*group, F.array(*edge).alias("_edges"))
    if within:
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(within, group, strict=True)])
        joined = frame.join(edges, on, "left").drop(*group)
    else:
        joined = frame.crossJoin(F.broadcast(edges))  # one row
    top = F.array_max(F.filter("_edges", lambda e: e < F.col(column)))
    value = F.when(F.col(column).isNotNull(), F.when(top.isNull(), 0).otherwise(F.array_position("_edges", top) - 1))
    return joined.withColumn("bin", value.cast("int")).drop("_edges")


def grid_binned(frame: DataFrame, columns: list[str], bins: int, method: str = "equisized_independent") -> DataFrame:
    """frame with cell, an array of the bins of several columns; dependent methods bin each column within the cells of those before it."""
    kind, _, mode = method.rpartition("_")
    cut = {"equisized": width_binned, "equifrequent": frequency_binned}.get(kind)
    if cut is None or mode not in ("independent", "dependent"):
        raise ValueError(f"unknown bin method {method!r}")
    names = [f"_bin{i}" for i in range(len(columns))]
    for i, c in enumerate(columns):
        frame = cut(frame, c, bins, *(names[:i] if mode == "dependent" else ())).withColumnRenamed("bin", names[i])
    return frame.withColumn("cell", F.array(*names)).drop(*names)
