"""Selection from one group of any size.

Rows stay where they are.  A pass over them gives the driver at most FETCH rows, from which it
makes as many picks as those rows settle; a task holds an Arrow batch and the picks so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import similarity
from sieveline.operators import kernels as K

FETCH = 2048


def _rows(frame: DataFrame, id: str, vec: str) -> DataFrame:
    return frame.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("features"))


def _best(rows: DataFrame, key: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> list[tuple[float, int, np.ndarray]]:
    """The most rows of largest key(ids, features), smaller ids first; a key of -inf leaves a row out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"key": pd.Series(dtype="float64"), "id": pd.Series(dtype="int64"), "features": pd.Series(dtype="object")})
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.assign(key=key(pdf["id"].to_numpy(), np.vstack(pdf["features"].to_numpy())))
            pdf = pdf[pdf["key"] > -np.inf]
            held = pd.concat([held, pdf[["key", "id", "features"]]]) if len(held) else pdf[["key", "id", "features"]]
            held = held.sort_values(["key", "id"], ascending=[False, True]).head(most)
        yield held

    top = rows.mapInPandas(run, "key double, id long, features array<double>").orderBy(F.desc("key"), "id").limit(most)
    return [(r["key"], r["id"], np.array(r["features"])) for r in top.collect()]


def _fetch(rows: DataFrame, ids: list[int]) -> list[np.ndarray]:
    got = {r["id"]: np.array(r["features"]) for r in rows.where(F.col("id").isin(ids)).collect()}
    if set(got) != set(ids):
        raise ValueError("start must be ids of the frame")
    return [got[i] for i in ids]


def _as_list(start: int | list[int]) -> list[int]:
    return [start] if isinstance(start, int) else list(start)


def _result(frame: DataFrame, ids: list[int]) -> DataFrame:
    return frame.sparkSession.createDataFrame(list(enumerate(ids)), "rank int, id long")


def _nearest(x: np.ndarray, picks: np.ndarray, p: float) -> np.ndarray:
    return K.between(x, picks, p).min(axis=1)


def max_min_large(frame: DataFrame, size: int, start: int | list[int], *, id: str = "id", vec: str = "features", p: float = 2.0, fetch: int = FETCH) -> DataFrame:
    """(rank, id): the max-min rule, from given ids.

    A row's distance from the nearest pick only falls, so the farthest of the fetched rows is the
    next pick as long as it is no nearer than the last row fetched was.
    """
    rows = _rows(frame, id, vec)
    ids = _as_list(start)[:size]
    picks = np.array(_fetch(rows, ids))
    while len(ids) < size:
        chosen, taken = picks, set(ids)
        got = _best(rows, lambda i, x: np.where(np.isin(i, list(taken)), -np.inf, _nearest(x, chosen, p)), fetch)
        if not got:
            break
        near, own, x = np.array([g[0] for g in got]), np.array([g[1] for g in got]), np.array([g[2] for g in got])
        bar = (near[-1], -own[-1]) if len(got) == fetch else (-np.inf, 0)
        while len(ids) < size and len(own):
            best = np.lexsort((own, -near))[0]
            if (near[best], -own[best]) < bar:
                break
            ids.append(int(own[best]))
            picks = np.vstack([picks, x[best]])
            near = np.minimum(near, _nearest(x, x[best : best + 1], p))
            keep = np.arange(len(own)) != best
            near, own, x = near[keep], own[keep], x[keep]
    return _result(frame, ids)


def max_sum_large(frame: DataFrame, size: int, start: int | list[int], *, id: str = "id", vec: str = "features", p: float = 2.0) -> DataFrame:
    """(rank, id): the max-sum rule, from given ids; a pass for each pick."""
    rows = _rows(frame, id, vec)
    ids = _as_list(start)[:size]
    picks = np.array(_fetch(rows, ids))
    while len(ids) < size:
        chosen, taken = picks, list(ids)
        got = _best(rows, lambda i, x: np.where(np.isin(i, taken), -np.inf, K.between(x, chosen, p).sum(axis=1)), 1)
        if not got:
            break
        ids.append(got[0][1])
        picks = np.vstack([picks, got[0][2]])
    return _result(frame, ids)


def dise_large(frame: DataFrame, radius: float, start: int, *, most: int | None = None, id: str = "id", vec: str = "features", p: float = 2.0, fetch: int = FETCH) -> DataFrame:
    """(rank, id): directed sphere exclusion with a radius; rows by their distance from the row start, each but those within radius of a pick.

    The rows that are first among those left are settled together.
    """
    rows = _rows(frame, id, vec)
    centre = np.array(_fetch(rows, [start]))
    ids: list[int] = []
    picks = np.zeros((0, centre.shape[1]))
    last = (-1.0, 0)
    while most is None or len(ids) < most:
        chosen, (far, before) = picks, last

        def key(i: np.ndarray, x: np.ndarray, chosen=chosen, far=far, before=before) -> np.ndarray:
            d = K.between(x, centre, p)[:, 0]
            gone = (d < far) | ((d == far) & (i <= before))
            if len(chosen):
                gone |= _nearest(x, chosen, p) <= radius
            return np.where(gone, -np.inf, -d)

        got = _best(rows, key, fetch)
        if not got:
            break
        for _, own, x in got:
            if (most is None or len(ids) < most) and (not len(picks) or _nearest(x[None], picks, p)[0] > radius):
                ids.append(own)
                picks = np.vstack([picks, x])
        last = (-got[-1][0], got[-1][1])
    return _result(frame, ids)


def opti_sim_large(frame: DataFrame, radius: float, start: int, size: int, *, k: int = 10, seed: int = 42, id: str = "id", vec: str = "features", p: float = 2.0) -> DataFrame:
    """(rank, id): of k random rows outside the picks' spheres always the one farthest from the picks; a pass for each pick.

    Random are the rows of least hash of seed, step and id, however the frame is partitioned.
    """
    rows = _rows(frame, id, vec)
    ids = [start]
    picks = np.array(_fetch(rows, ids))
    while len(ids) < size:
        chosen = picks
        step = F.xxhash64(F.lit(seed), F.lit(len(ids)), "id")
        numbered = rows.select("id", F.concat(F.array(F.shiftright(step, 11).cast("double")), "features").alias("features"))
        got = _best(numbered, lambda i, x: np.where(_nearest(x[:, 1:], chosen, p) <= radius, -np.inf, x[:, 0]), k)
        if not got:
            break
        some = np.array([g[2][1:] for g in got])
        near = _nearest(some, picks, p)
        best = np.lexsort((np.array([g[1] for g in got]), -near))[0]
        ids.append(got[best][1])
        picks = np.vstack([picks, some[best]])
    return _result(frame, ids)


def _apart(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((x - q) ** 2).sum(axis=1)


def furthest_centroid_large(frame: DataFrame, size: int, start: int, *, scaling: float = 10.0, id: str = "id", vec: str = "features") -> DataFrame:
    """(rank, id): rows far from the picks' centre, each of which drops its near neighbours, as FurthestCentroid(exact=True) does; two passes for each pick.

    What is dropped is known by a point and the last neighbour that goes with it, so no rows are gathered.
    """
    rows = _rows(frame, id, vec)
    n = rows.count()
    ids, picks, far = [start], np.array(_fetch(rows, [start])), []
    zones: list[tuple[np.ndarray, float, int]] = []
    spare, share = n - size, -(-(n - size) // size)

    def near(point: np.ndarray, reach: float) -> tuple[int, tuple[float, int] | None]:
        """How many of the nearest rows are below reach, and the last of them."""
        told = lambda batches: (pd.DataFrame({"d": _apart(np.vstack(b["features"].to_numpy()), point), "id": b["id"]}) for b in batches if not b.empty)
        some = rows.mapInPandas(told, "d double, id long").where(F.col("d") < reach).orderBy("d", "id").limit(share)
        got = some.agg(F.count("*").alias("n"), F.max(F.struct("d", "id")).alias("last")).first()
        return got["n"], (got["last"]["d"], got["last"]["id"]) if got["n"] else None

    while len(ids) < size:
        centre, taken, gone = picks.mean(axis=0), list(ids), list(zones)

        def key(i: np.ndarray, x: np.ndarray, centre=centre, taken=taken, gone=gone) -> np.ndarray:
            dead = np.isin(i, taken)
            for point, d, last in gone:
                away = _apart(x, point)
                dead |= (away < d) | ((away == d) & (i <= last))
            return np.where(dead, -np.inf, _apart(x, centre))

        got = _best(rows, key, 1)
        if not got:
            break
        far.append(got[0][0])
        ids.append(got[0][1])
        picks = np.vstack([picks, got[0][2]])
        reach = scaling / 100 * (far[0] + sum(far)) / (len(far) + 1)
        for point in picks if len(far) == 1 else picks[-1:]:
            if spare > 0 and scaling and share:
                count, last = near(point, reach)
                if last:
                    zones.append((point, *last))
                    spare -= count
    return _result(frame, ids)


def n_similarity_large(frame: DataFrame, size: int, start: int | list[int], *, id: str = "id", vec: str = "features", **index) -> DataFrame:
    """(rank, id): always the row that makes the picks' n-ary similarity least; a pass for each pick, whose state is the picks' column sums."""
    rows = _rows(frame, id, vec)
    ids = _as_list(start)[:size]
    total = np.sum(_fetch(rows, ids), axis=0)
    while len(ids) < size:
        sums, taken = total, list(ids)

        def key(i: np.ndarray, x: np.ndarray, sums=sums, taken=taken) -> np.ndarray:
            v = K.set_index(sums + x, len(taken) + 1, **index)
            return np.where(np.isin(i, taken) | np.isnan(v), -np.inf, -v)

        got = _best(rows, key, 1)
        if not got:
            break
        ids.append(got[0][1])
        total = total + got[0][2]
    return _result(frame, ids)


def grid_select_large(frame: DataFrame, columns: list[str], size: int, bins: int, *, method: str = "equisized_independent", measure: str = "hypersphere_overlap", seed: int = 42, id: str = "id", **options) -> DataFrame:
    """(rank, id): rounds of one random row of every cell; of a round that is too large, the cells whose rows left are most diverse.

    Random is the order of a hash of seed and id.  Cells are counted, numbered and scored as groups.
    """
    from pyspark.sql import Window

    from sieveline.functions import diversity
    from sieveline.operators.select import grid_binned

    rows = frame.select(F.col(id).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns])
    binned = grid_binned(rows, columns, bins, method).withColumn("features", F.array(*columns)).select("id", "features", "cell")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "id"), "id")) - 1
    placed = binned.withColumn("round", place)
    # how many rounds are whole follows from how many cells have how many rows: one number a size
    sizes = binned.groupBy("cell").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("cells")).orderBy("n").collect()
    whole = taken = 0
    live = sum(r["cells"] for r in sizes)
    for r in sizes:
        more = min(r["n"] - whole, (size - taken) // live)
        whole, taken = whole + more, taken + more * live
        if whole < r["n"]:
            break
        live -= r["cells"]
    chosen = placed.where(F.col("round") < whole).select("round", "cell", F.lit(0.0).alias("score"), "id")
    need = min(size - taken, live)
    if need:
        left = placed.where(F.col("round") >= whole)
        if measure == "hypersphere_overlap":
            options = {**options, "library": binned}
        rated = diversity.diversity(left, measure, "cell", **options).select("cell", F.coalesce("diversity", F.lit(-np.inf)).alias("score"))
        first = left.where(F.col("round") == whole).join(rated, "cell").orderBy(F.desc("score"), F.desc("cell")).limit(need)
        chosen = chosen.unionByName(first.select("round", "cell", "score", "id"))
    order = Window.orderBy("round", F.when(F.col("round") < whole, F.col("cell")), F.desc("score"), F.desc("cell"))
    return chosen.select((F.row_number().over(order) - 1).alias("rank"), "id")


def _indexed(frame: DataFrame, shift, objects, key: str, method: str, index: dict, by: tuple[str, ...], id: str, vec: str) -> DataFrame:
    """(by..., id, value): the n-ary index of the set that shift(sums, features) stands for, row by row."""
    sums = similarity.column_sums(frame, *by, vec=vec).withColumnsRenamed({b: f"_{b}" for b in by})
    joined = frame.join(sums, [frame[b].eqNullSafe(sums[f"_{b}"]) for b in by]) if by else frame.crossJoin(F.broadcast(sums))  # one row
    moved, n = F.zip_with("sums", F.col(vec), shift), objects(F.col("n"))
    value = similarity.isim(key, moved, n, index.get("order", 1)) if method == "isim" else similarity.esim(key, moved, n, index.get("threshold"), index.get("weight", "fraction"), index.get("order", 1))
    return joined.select(*by, F.col(id).alias("id"), value.alias("value"))


def nary_medoid(frame: DataFrame, *by: str, key: str = "RR", method: str = "isim", id: str = "id", vec: str = "features", **index) -> DataFrame:
    """(by..., id): the row without which the others' n-ary similarity is least; ties go to the smaller id; a set of fewer than three rows raises."""
    value = _indexed(frame, lambda s, x: s - x, lambda n: F.when(n < 3, F.raise_error(F.lit("a medoid needs three rows at least")).cast("long")).otherwise(n - 1), key, method, {**index, "order": 1}, by, id, vec)
    return value.groupBy(*by).agg(F.min(F.struct(F.coalesce("value", F.lit(np.inf)).alias("v"), "id")).alias("m")).select(*by, F.col("m.id").alias("id"))


def nary_outlier(frame: DataFrame, *by: str, key: str = "RR", method: str = "isim", id: str = "id", vec: str = "features", **index) -> DataFrame:
    """(by..., id): the row without which the others' n-ary similarity is largest; ties go to the smaller id."""
    value = _indexed(frame, lambda s, x: s - x, lambda n: n - 1, key, method, index, by, id, vec)
    return value.groupBy(*by).agg(F.min(F.struct((-F.coalesce("value", F.lit(-np.inf))).alias("v"), "id")).alias("m")).select(*by, F.col("m.id").alias("id"))


def nary_next(frame: DataFrame, picks: DataFrame, *by: str, key: str = "RR", method: str = "isim", id: str = "id", vec: str = "features", **index) -> DataFrame:
    """(by..., id): the row that makes the n-ary similarity of the picks (by..., id) and itself least; picks are no candidates."""
    chosen = picks.select(*by, F.col(id).alias("_pick")).distinct()
    same = [F.col(f"r.{id}") == F.col("c._pick"), *[F.col(f"r.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by]]
    held = frame.alias("r").join(chosen.alias("c"), same, "left_semi")
    rest = frame.alias("r").join(chosen.alias("c"), same, "left_anti")
    sums = similarity.column_sums(held, *by, vec=vec).withColumnsRenamed({b: f"_{b}" for b in by})
    joined = rest.join(sums, [rest[b].eqNullSafe(sums[f"_{b}"]) for b in by]) if by else rest.crossJoin(F.broadcast(sums))  # one row
    moved, n = F.zip_with("sums", F.col(vec), lambda s, x: s + x), F.col("n") + 1
    value = similarity.isim(key, moved, n, index.get("order", 1)) if method == "isim" else similarity.esim(key, moved, n, index.get("threshold"), index.get("weight", "fraction"), index.get("order", 1))
    scored = joined.select(*by, F.col(id).alias("id"), F.coalesce(value, F.lit(np.inf)).alias("v"))
    return scored.groupBy(*by).agg(F.min(F.struct("v", "id")).alias("m")).select(*by, F.col("m.id").alias("id"))
