"""The hash-prefix forest against a plain forest and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sieveline.llm import ann as A

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k=5):
    """(query_id, vec_id, score) of the k nearest of distinct rows for each distinct query, by rank."""
    rows = {(i, tuple(v)) for i, v in rows}
    out = []
    for q, x in {(i, tuple(v)) for i, v in queries}:
        x_ = np.array(x)
        near = sorted((-float(np.array(v) @ x_ / (np.linalg.norm(v) * np.linalg.norm(x_))), i) for i, v in rows if i != q and len(v) == len(x))
        near = [(round(s, 9), i) for s, i in near]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def results(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_with_shipped_parameters(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = results(A.op9_ann(spark, f"/root/testdata/{sf}"))
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    ids = np.array(sorted(v))
    unit = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    found = {(q, i) for q, _, i, _ in got}
    hits = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[n]
        s[n] = -9
        want = ids[np.lexsort((ids, -s))[:5]]
        hits, total = hits + sum((ids[n], i) in found for i in want), total + 5
    assert len(got) == total and hits / total >= 0.9


@pytest.mark.parametrize("leaf", [40, 10_000])
def test_whole_ascent_is_brute_force(spark, leaf):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # copies, ties by id
    rows += [(2000 + i, [1.0, 2.0 + i, 0.5]) for i in range(30)]  # another length
    asked = [r for r in rows if r[0] % 50 == 0] + [rows[8], rows[7], (8, rows[20][1]), (3000, [1.0] * 9)]
    got = results(A.nearest(*frames(spark, rows + rows[:50], asked + asked[:2]), candidates=10**9, leaf=leaf, exact=400))
    assert got == brute(rows, asked)
    assert sum(q == 8 for q, *_ in got) == 10 and not any(q == 3000 for q, *_ in got)  # rows of their own; nothing of its length


@pytest.mark.parametrize("most", [1, 60, 700])
def test_ascent_equals_a_plain_forest(spark, most):
    rng = np.random.default_rng(5)
    # half of the vectors are near one direction, so that some prefixes need further bits
    x = rng.normal(size=(400, 8))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 8))
    q = np.concatenate([x[:10] + 0.01, rng.normal(size=(10, 8))])
    trees = 4
    frame = lambda m, first: spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "key long, vec array<double>")
    found = A.candidates_of(frame(x, 0), frame(q, 1000), len(x), k=5, trees=trees, candidates=most, leaf=16, exact=10_000)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r.key)
    hx, hq = A.strings(x, A.planes(8, trees)), A.strings(q, A.planes(8, trees))
    for i in range(len(q)):
        agree = A.shared(hx, hq[i])
        bits = max([b for b in range(65) if (agree >= b).sum() >= most], default=0)
        assert got[1000 + i] == set(np.flatnonzero((agree >= bits).any(axis=1)))


def test_calibration_follows_the_data(spark):
    """Where neighbours stand out, few strings are compared, and fewer for each row as there are more rows."""
    rng = np.random.default_rng(6)
    share = []
    for n in (1000, 8000):
        centre = rng.normal(size=(n // 10, 32))
        x = np.repeat(centre, 10, axis=0) + 0.15 * rng.normal(size=(n, 32))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").withColumn("key", F.xxhash64("vec"))
        share.append(A.calibrate(rows, rows.where("id % 50 = 0"), 5, A.TREES) / (n * A.TREES))
    assert share[0] < 0.05 and share[1] < share[0] / 3
    got = results(A.nearest(rows.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding")), rows.where("id % 50 = 0").select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding")), leaf=500))
    same = [(q // 10) == (i // 10) for q, _, i, _ in got]
    assert len(got) == 800 and np.mean(same) > 0.95


def test_shared_bits():
    a = np.array([0, 0, 0, (1 << 64) - 1, 1 << 63, 5, 1 << 40], dtype=np.uint64)
    b = np.array([0, 1, 1 << 63, 0, (1 << 63) + 1, 4, (1 << 40) + (1 << 11)], dtype=np.uint64)
    assert A.shared(a, b).tolist() == [64, 63, 0, 0, 63, 63, 52]


def test_odd_vectors_and_empty_tables(spark):
    rows = [(50, None), (100, [0.0, 0.0]), (150, [float("nan"), 1.0]), (200, [1.0, None]), (None, [1.0, 2.0]), (250, [float("inf"), 1.0]), (300, []), (1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [-0.0, 1.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).withColumn("key", F.lit("x"))
    assert results(A.nearest(df, df)) == brute(rows[7:], rows[7:])
    assert A.nearest(df.limit(0), df).count() == 0 and A.nearest(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 1")
    assert A.nearest(one, one).count() == 0
