"""Approximate nearest neighbours by a hash-prefix forest whose prefix space is partitioned.

A tree knows each vector by a hash string: the signs of its products with 64 random directions.
Its strings are sorted and cut into leaves by prefix: a first cut by as many bits as make leaves
of about ``leaf`` strings, a second one, by further bits, where one prefix holds more.  So a task
holds one leaf of one tree, and a query goes to the leaves of its own prefixes only.

Search.  1. Descent: in its leaf of each tree a query counts how many strings share each longer
prefix with it; leaf sizes, rolled up, give the counts of the shorter ones.  2. Synchronous
ascent: all trees go up together, one bit at a time, to the longest prefix that at least
``candidates`` strings share with the query in all trees together.  3. The strings under that
prefix, in every leaf that it covers, are compared by the Hamming distance of sketches (the
strings of up to sixteen trees); the ``exact`` least of a query have their vectors fetched and scored.

``candidates`` is calibrated if not given: for a bounded sample of queries the true neighbours
are found by brute force over all rows, and with them how many strings the ascent must take to
reach each; it is set so that ``reach`` of them are reached.  So few strings are compared where
vectors have neighbours that stand out, and many where they are like random ones.

Cosines are defined between vectors of one length: vectors of other lengths are no neighbours,
and are searched among themselves.  Equal vectors are one entry, with the smallest ids as many as
can be asked for, so copies never crowd a leaf.  Strings that no bit tells apart are dealt to
leaves of their own by a hash.

Defined results: vectors that are null, zero or have a null or non-finite component take no
part, nor do null ids.  Ties go to the smaller id.  Repeated ids with different vectors are rows
of their own, as queries too; repeated rows are one.  Without rows or queries there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.scratch import written

TREES, BITS, LEAF = 16, 64, 16384
#: Trees whose strings are the sketch; vectors of a query that are scored.
SKETCH, EXACT = 16, 160
#: Queries of the calibration, and the share of their neighbours that the ascent must reach.
SAMPLE, REACH = 64, 0.96
#: Bits that a leaf's prefix has at most.
DEEPEST = 40


def planes(dim: int, trees: int, seed: int = 17) -> np.ndarray:
    """The random directions, dim x (trees * BITS), the same in every task."""
    return np.random.default_rng([seed, dim]).normal(size=(trees * BITS, dim)).T.astype(np.float32)


def strings(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The hash strings, rows x trees; a string's first bit is the highest."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    bits = (rows / length).astype(np.float32) @ directions > 0
    return np.packbits(bits, axis=1, bitorder="big").view(">u8").astype(np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the longest common prefixes."""
    differ = a ^ b
    high = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1] + 11  # exact: 53 bits are left
    low = np.frexp((differ & np.uint64(0x7FF)).astype(np.float64))[1]
    return BITS - np.where(differ >> np.uint64(11), high, low)


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors of a column."""
    column = batch.column(name)
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values, dtype=np.float64)
    size = np.diff(offsets)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        for i in range(0, len(at), 2048):
            some = at[i : i + 2048]
            yield some, flat[offsets[some][:, None] + np.arange(dim)]


def _hashed(trees: int):
    """From (key, vec), rows (dim, tree, h, key, sketch) for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            key = np.asarray(batch.column("key"))
            for at, rows in by_length(batch, "vec"):
                dim = rows.shape[1]
                h = strings(rows, known.setdefault(dim, planes(dim, trees)))
                sketch = np.ascontiguousarray(h[:, :SKETCH])
                width = sketch.shape[1] * 8
                offsets = pa.py_buffer((np.arange(len(at) + 1) * width).astype(np.int32))
                marks = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(sketch)])
                for t in range(trees):
                    head = [pa.array(np.full(len(at), v, dtype=np.int32)) for v in (dim, t)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(h[:, t].view(np.int64)), pa.array(key[at]), marks], names=["dim", "tree", "h", "key", "sketch"])

    return run


HASHED = "dim int, tree int, h long, key long, sketch binary"


def _calibration(asked: list, k: int, trees: int):
    """From (key, vec), for each sampled query the k nearest of the batches with how far their strings agree, and how many strings agree so far."""
    names = ["query", "key", "score", "agree", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        best: list[list[tuple[float, int, int]]] = [[] for _ in asked]
        counts = np.zeros((len(asked), BITS + 1), dtype=np.int64)
        for batch in batches:
            key = np.asarray(batch.column("key"))
            for at, rows in by_length(batch, "vec"):
                dim = rows.shape[1]
                if dim not in known:
                    mine = [i for i, (_, v) in enumerate(asked) if len(v) == dim]
                    x = np.array([asked[i][1] for i in mine], dtype=np.float64).reshape(-1, dim)
                    p = planes(dim, trees)
                    known[dim] = (p, mine, x / np.sqrt((x * x).sum(1, keepdims=True)), strings(x, p) if len(x) else None)
                p, mine, x, hx = known[dim]
                if not mine:
                    continue
                h = strings(rows, p)
                score = x @ (rows / np.sqrt((rows * rows).sum(1, keepdims=True))).T
                for n, i in enumerate(mine):
                    agree = shared(h, hx[n])
                    other = key[at] != asked[i][0]
                    counts[i] += np.bincount(agree[other].ravel(), minlength=BITS + 1)
                    s = np.where(other, score[n], -np.inf)
                    top = np.argpartition(-s, min(k, len(s) - 1))[:k]
                    best[i] = sorted([*best[i], *((-float(s[r]), int(key[at[r]]), int(agree[r].max())) for r in top if np.isfinite(s[r]))])[:k]
        rows_ = [(i, b[1], -b[0], b[2], counts[i].tolist() if n == 0 else None) for i in range(len(asked)) for n, b in enumerate(best[i])]
        cols = list(zip(*rows_, strict=True)) if rows_ else [[] for _ in names]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def calibrate(classes: DataFrame, asked: DataFrame, k: int, trees: int, sample: int = SAMPLE, reach: float = REACH) -> int:
    """How many strings the ascent must take so that reach of the sampled queries' k true neighbours are among them."""
    some = [(r["own"], r["vec"]) for r in asked.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(sample).select(F.xxhash64("vec").alias("own"), "vec").collect()]
    found = classes.select("key", "vec").mapInArrow(_calibration(some, k, trees), "query int, key long, score double, agree int, counts array<long>")
    # partitions give k rows a query each; the counts are summed, the rows ranked
    total = found.where("counts is not null").select("query", F.posexplode("counts").alias("agree", "c")).groupBy("query", "agree").agg(F.sum("c").alias("c"))
    at_least = total.withColumn("n", F.sum("c").over(Window.partitionBy("query").orderBy(F.desc("agree")))).select("query", "agree", "n")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    need = found.withColumn("r", rank).where(F.col("r") <= k).join(at_least, ["query", "agree"])
    most = need.agg(F.percentile("n", reach)).first()[0]
    return int(most) + 1 if most is not None else 1


def _prefix(h: str, bits: str | int) -> Column:
    """The first bits of a string, as a number; bits may be a column."""
    return F.expr(f"if(({bits}) = 0, 0L, shiftrightunsigned({h}, cast(64 - ({bits}) as int)))")


def _leaf() -> Column:
    """The number of a leaf's part: one column to meet by.  Leaves that share one by chance add strings to compare, no more."""
    return F.xxhash64("dim", "tree", "depth", "prefix", "part").alias("leaf")


def _ranges(h: np.ndarray, q: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted strings that share the first bits with each of q begin and end."""
    bits = np.broadcast_to(np.asarray(bits, dtype=np.int64), q.shape)
    free = np.where(bits >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(bits, BITS - 1).astype(np.uint64))
    return np.searchsorted(h, q & ~free, side="left"), np.searchsorted(h, q | free, side="right")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _descend(entries: pa.Table, queries: pa.Table) -> pa.Table:
    """(query, bits, n) for each query of a leaf: how many of its strings share so many first bits."""
    out: list[list] = [[], [], []]
    if entries.num_rows and queries.num_rows:
        h = np.sort(_column(entries, "h").view(np.uint64))
        q, key = _column(queries, "h").view(np.uint64), _column(queries, "key")
        for bits in range(int(queries.column("depth")[0].as_py()), BITS + 1):
            lo, hi = _ranges(h, q, bits)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                break
            for col, v in zip(out, (key[some], np.full(len(some), bits), (hi - lo)[some]), strict=True):
                col.append(v)
    cols = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
    return pa.table({"query": pa.array(cols[0], pa.int64()), "bits": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int64())})


def _compare(exact: int):
    """(query, key, apart): of a leaf's strings under each query's prefix, those whose sketches differ least."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if entries.num_rows and queries.num_rows:
            h = _column(entries, "h").view(np.uint64)
            order = np.argsort(h, kind="stable")
            h, key = h[order], _column(entries, "key")[order]
            marks = np.frombuffer(b"".join(entries.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(h), -1)[order]
            asked = np.frombuffer(b"".join(queries.column("sketch").to_pylist()), dtype=np.uint64).reshape(queries.num_rows, -1)
            lo, hi = _ranges(h, _column(queries, "h").view(np.uint64), _column(queries, "bits"))
            for query, x, a, b in zip(_column(queries, "key"), asked, lo, hi, strict=True):
                if a == b:
                    continue
                apart = np.bitwise_count(marks[a:b] ^ x).sum(axis=1, dtype=np.int32)
                near = np.arange(len(apart))
                if len(near) > exact:
                    near = np.flatnonzero(apart <= np.partition(apart, exact - 1)[exact - 1])
                    near = near[np.lexsort((key[a:b][near], apart[near]))[:exact]]
                for col, v in zip(out, (np.full(len(near), query), key[a:b][near], apart[near]), strict=True):
                    col.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.int64()), "apart": pa.array(cols[2], pa.int32())})

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, ids, score) of pairs of vectors of one length."""
    for batch in batches:
        query, ids, a, b = (batch.column(c) for c in ("query", "ids", "vec", "other"))
        x, y = np.asarray(a.flatten(), dtype=np.float64), np.asarray(b.flatten(), dtype=np.float64)
        begin = np.concatenate([[0], np.cumsum(np.diff(np.asarray(a.offsets)))])[:-1]
        sums = lambda v: np.add.reduceat(v, begin) if len(v) else v
        score = sums(x * y) / (np.sqrt(sums(x * x)) * np.sqrt(sums(y * y)))
        yield pa.RecordBatch.from_arrays([query, ids, pa.array(score)], names=["query", "ids", "score"])


def usable(vec):
    """Whether a vector takes part."""
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def candidates_of(classes: DataFrame, asked: DataFrame, n: int, *, k: int, trees: int, candidates: int, leaf: int, exact: int) -> DataFrame:
    """(query, key): what the forest finds for each query, its exact least sketches apart."""
    first = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    hashed = lambda rows: rows.select("key", "vec").mapInArrow(_hashed(trees), HASHED).withColumn("first", _prefix("h", first))
    entries, queries = hashed(classes), hashed(asked)
    # the cut: further bits where one first prefix holds more than a leaf, then a hash where bits tell nothing apart
    cut = entries.groupBy("dim", "tree", "first").agg(F.least(F.lit(first) + F.greatest(F.ceil(F.log2(F.count("*") / leaf)), F.lit(0)), F.lit(DEEPEST)).cast("int").alias("depth"))
    deep = entries.drop("sketch").join(cut, ["dim", "tree", "first"]).withColumn("prefix", _prefix("h", "depth"))
    leaves = written(deep.groupBy("dim", "tree", "first", "depth", "prefix").agg(F.count("*").alias("c"), F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts")), "leaves")
    cut = leaves.select("dim", "tree", "first", "depth").distinct()
    places = leaves.select("dim", "tree", "first", "depth", "prefix", "parts")
    own = entries.join(cut, ["dim", "tree", "first"]).withColumn("prefix", _prefix("h", "depth")).join(places, ["dim", "tree", "first", "depth", "prefix"])
    own = own.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select(_leaf(), "h", "key", "sketch")
    # descent, in leaves for longer prefixes and by their sizes for shorter ones
    lost = F.coalesce("depth", F.lit(first))  # a query may begin as no entry does
    at_home = queries.join(cut, ["dim", "tree", "first"], "left").withColumn("depth", lost).withColumn("prefix", _prefix("h", "depth"))
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    inside = at_home.join(places, ["dim", "tree", "first", "depth", "prefix"]).withColumn("part", every_part).select(_leaf(), "depth", "h", "key")
    deeper = own.select("leaf", "h").groupBy("leaf").cogroup(inside.groupBy("leaf")).applyInArrow(_descend, "query long, bits int, n long")
    up = leaves.select("dim", "tree", "depth", "prefix", "c", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("bits"))
    sizes = up.groupBy("dim", "tree", "bits", F.expr("if(bits = 0, 0L, shiftrightunsigned(prefix, depth - bits))").alias("above")).agg(F.sum("c").alias("n"))
    # depth itself was counted inside, unless the query's leaf has no entry: then there is nothing at depth
    levels = at_home.select("dim", "tree", "h", F.col("key").alias("query"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("depth") - 1, F.lit(0)))).alias("bits"), "depth").where("bits < depth")
    shorter = levels.withColumn("above", _prefix("h", "bits")).join(sizes, ["dim", "tree", "bits", "above"]).select("query", "bits", "n")
    # ascent: the longest prefix with enough strings in all trees; all there is, if there are fewer
    met = deeper.unionAll(shorter).groupBy("query", "bits").agg(F.sum("n").alias("n"))
    stop = met.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("n") >= candidates, F.col("bits"))), F.lit(0)).alias("bits"))
    # the leaves under it
    wide = queries.join(stop.withColumnRenamed("query", "key"), "key").drop("first")
    up_to = f"least(bits, {first})"
    begin = f"if({up_to} = 0, 0L, shiftrightunsigned(h, 64 - {up_to}))"
    firsts = F.expr(f"sequence(shiftleft({begin}, {first} - {up_to}), shiftleft({begin} + 1L, {first} - {up_to}) - 1L)")
    wide = wide.withColumn("first", F.explode(firsts))
    under = wide.join(places, ["dim", "tree", "first"]).where(F.expr("if(least(bits, depth) = 0, true, shiftrightunsigned(prefix, depth - least(bits, depth)) = shiftrightunsigned(h, 64 - least(bits, depth)))"))
    under = under.withColumn("part", every_part).select(_leaf(), "h", "key", "sketch", "bits")
    near = own.groupBy("leaf").cogroup(under.groupBy("leaf")).applyInArrow(_compare(exact), "query long, key long, apart int")
    near = near.groupBy("query", "key").agg(F.min("apart").alias("apart"))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("apart", "key"))).where(F.col("r") <= exact).select("query", "key")


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding", trees: int = TREES, candidates: int | None = None, leaf: int = LEAF, exact: int = EXACT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of rows found for each of queries, itself left out."""
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    # -0.0 is 0.0 as far as equal vectors go
    rows, queries = (pick(d).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))) for d in (rows, queries))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    classes = rows.distinct().withColumn("r", place).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = written(classes.withColumn("key", F.xxhash64("vec")), "vectors")
    asked = written(queries.distinct().select(F.col("id").alias("query_id"), "vec", F.xxhash64("id", "vec").alias("key")), "queries")
    n = classes.count()
    if candidates is None:
        candidates = calibrate(classes, asked, k, trees) + trees  # a query's own strings come first
    candidates = max(candidates, trees * (k + 1))  # so many strings belong to k others at least
    pairs = candidates_of(classes, asked, n, k=k, trees=trees, candidates=candidates, leaf=leaf, exact=max(exact, 8 * k))
    both = pairs.join(classes.select("key", "ids", "vec"), "key").join(asked.select(F.col("key").alias("query"), F.col("vec").alias("other")), "query")
    scored = both.select("query", "ids", "vec", "other").mapInArrow(_scored, "query long, ids array<long>, score double")
    # a query's own class has the query's id among its first ones
    found = scored.join(asked.select(F.col("key").alias("query"), "query_id"), "query").select("query", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
