"""A sample of the catalogue against DuckDB, at the smallest scale."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sieveline.functions import convert, diversity, similarity
from sieveline.functions.vectors import minkowski
from sieveline.operators import joins, kernels, large, scores, select
from sieveline.plans import catalogue
from sieveline.sources import frames

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["census", "quota_equal", "maxmin_per_label", "maxsum_per_label", "complement", "bins_frequency", "bins_frequency_all", "grid_equifrequent_dependent", "pair_scaled", "distance_covariance", "quota_proportional", "furthest_centroid_exact", "nsim_select_JT", "dise_fixed_radius", "radius_join", "knn_join", "nary_medoid", "nary_next", "diversity_hypersphere", "random_rows", "pair_BUB", "pair_modified_tanimoto", "distance_gravity", "isim_CT2", "esim_JT_dissimilar_power_3", "diversity_wdud", "diversity_edi"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {os.path.splitext(p.name)[0]} as select * from '{p}'")
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = db.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, features array<double>")


#: Published diversities.
def test_published_diversities(spark):
    import math

    one = lambda df: df.first()["diversity"]
    assert abs(one(diversity.logdet(frame(spark, [[1, 4], [3, 2]]))) - math.log(131)) < 1e-9
    assert round(one(diversity.shannon_entropy(frame(spark, [[1, 0, 1, 0], [0, 1, 1, 0], [1, 0, 1, 0], [0, 0, 1, 0]]))), 2) == 1.81
    assert abs(one(diversity.explicit_diversity_index(frame(spark, [[0, 1, 2], [1, 2, 0], [2, 0, 1]]), 1)) - 56.395512045413) < 1e-8


def test_select_rejects_bad_input(spark):
    rows = frame(spark, [[0, 0], [1, 1]])
    with pytest.raises(ValueError):
        select.select(rows, select.MaxMin(), 3)
    with pytest.raises(TypeError):
        select.GridPartition(bins="4")


@pytest.mark.parametrize("fetch", [1, 3, 2048])
def test_large_equals_grouped(spark, fetch):
    rows = catalogue.vectors(spark, str(DATA)).repartition(3)
    order = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert order(large.max_min_large(rows, 8, 0, fetch=fetch)) == order(select.select(rows, select.MaxMin(start=0), 8))
    assert order(large.max_min_large(rows, 5, [3, 0], fetch=fetch)) == order(select.select(rows, select.MaxMin(start=[3, 0]), 5))
    x = np.vstack([r.features for r in rows.orderBy("id").collect()])
    picks, _ = kernels.dise(x, 5, 0, 1.3, 1e9, 0)
    assert order(large.dise_large(rows, 1.3, 0, fetch=fetch)) == picks and order(large.dise_large(rows, 1.3, 0, most=4, fetch=fetch)) == picks[:4]


def test_large_sum_and_similarity_equal_kernels(spark):
    rows = catalogue.vectors(spark, str(DATA)).repartition(3)
    order = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    x = np.vstack([r.features for r in rows.orderBy("id").collect()])
    assert order(large.max_sum_large(rows, 5, 0)) == kernels.max_sum(x, 5, 0)
    bits = catalogue.prints(spark, str(DATA))
    for index in ({"key": "RR"}, {"key": "JT", "method": "esim"}):
        assert order(large.n_similarity_large(bits, 5, [0, 2], **index)) == kernels.n_similarity((x > 0).astype(float), 5, [0, 2], scale=False, **index)
    got = order(large.opti_sim_large(rows, 1.2, 0, 6))
    d = kernels.between(x[got], x[got])
    assert got[0] == 0 and len(set(got)) == len(got) and d[np.triu_indices(len(got), 1)].min() > 1.2
    assert order(large.opti_sim_large(rows.repartition(7), 1.2, 0, 6)) == got


@pytest.mark.parametrize("scaling", [0.0, 10.0, 60.0])
def test_large_centroid_equals_the_kernel(spark, scaling):
    rows = catalogue.vectors(spark, str(DATA)).repartition(3)
    x = np.vstack([r.features for r in rows.orderBy("id").collect()])
    got = [r["id"] for r in large.furthest_centroid_large(rows, 6, 4, scaling=scaling).orderBy("rank").collect()]
    assert got == kernels.furthest_centroid(x, 6, 4, scaling, exact=True)


def test_grid_in_rounds(spark):
    g = np.random.default_rng(2)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(g.normal(size=(90, 2)))]
    rows = spark.createDataFrame(points, "id long, a double, b double")
    cells = {r.id: tuple(r.cell) for r in select.grid_binned(rows, ["a", "b"], 3).collect()}
    n = len(set(cells.values()))
    got = [r.id for r in large.grid_select_large(rows, ["a", "b"], n + 4, 3).orderBy("rank").collect()]
    assert len(set(got)) == n + 4 and [cells[i] for i in got[:n]] == sorted(set(cells.values()))
    assert len({cells[i] for i in got[n:]}) == 4
    assert large.grid_select_large(rows, ["a", "b"], 200, 3).count() == 90
    with pytest.raises(ValueError):
        select.grid_binned(rows, ["a"], 3, "other")


@pytest.mark.parametrize("method", ["equisized_independent", "equisized_dependent", "equifrequent_independent", "equifrequent_dependent"])
def test_bins_equal_kernels(spark, method):
    g = np.random.default_rng(7)
    x = np.round(g.normal(size=(200, 2)), 1)  # many ties
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(5)
    got = {r.id: list(r.cell) for r in select.grid_binned(rows, ["a", "b"], 5, method).collect()}
    assert [got[i] for i in range(200)] == kernels.grid_bins(x, 5, method).tolist()


def test_bins_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, 1.0), (3, 5.0)], "id long, a double")
    assert {r.id: r.bin for r in select.frequency_binned(rows, "a", 2).collect()} == {1: None, 2: 0, 3: 0}
    assert select.frequency_binned(rows.limit(0), "a", 2).count() == 0


def test_pairs_stand_for_rows(spark):
    rows = catalogue.vectors(spark, str(DATA))
    pairs = similarity.pair_frame(rows, minkowski, by="label")
    for strategy in (select.MaxMin(), select.MaxSum()):
        want = select.select(rows, strategy, 30, by="label")
        assert sorted(map(tuple, select.select_pairs(pairs, strategy, 30, by="label").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(TypeError):
        select.select_pairs(pairs, select.DISE(), 5)
    one = pairs.where("label = 0").drop("label")
    first = one.first()["i"]
    for bad in (one.where(f"i <> {first} or j <> {first}"), one.withColumn("value", F.when(F.col("i") < F.col("j"), 0.5).otherwise(F.col("value"))), one.unionAll(one.limit(1))):
        with pytest.raises(ValueError):
            select.select_pairs(bad, select.MaxMin(), 3)


def test_groups_with_nulls_and_order(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)], None if i < 2 else "a" if i < 9 else "b") for i in range(14)], "id long, features array<double>, g string")
    got = select.select(rows, select.MaxMin(), 9, by="g", allocation="equal", ordered=True).collect()
    assert {r.group_no: r.label for r in got} == {0: None, 1: "a", 2: "b"} and len(got) == 8
    assert {r.label for r in select.select(rows, select.MaxMin(), 9, by="g").collect()} == {None, "a", "b"}
    assert {r.label: r.id for r in select.medoids(rows, by="g", block=3).collect()} == {r.label: r.id for r in select.medoids(rows, by="g").collect()}


def test_joins_equal_loops(spark):
    g = np.random.default_rng(3)
    a, b = g.normal(size=(40, 3)), np.vstack([g.normal(size=(30, 3)), np.zeros((2, 3))])
    b[0] = a[0] + np.array([0.5, 0, 0])
    both = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, features array<double>") for m in (a, b)]
    d = kernels.between(a, b)
    got = {(r.i, r.j) for r in joins.radius_join(*both, 0.5 + 1e-12).collect()}
    assert got == {(i, j) for i in range(40) for j in range(32) if d[i, j] <= 0.5 + 1e-12} and (0, 0) in got
    near = {(r.i, r["rank"]): r.j for r in joins.knn_join(*both, 4, block=7).collect()}
    assert near == {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert joins.knn_join(*both, 4, within=0.3).count() == sum(min(4, (row < 0.3).sum()) for row in d)
    assert joins.knn_join(both[0], both[1].limit(0), 2).count() == 0 == joins.radius_join(both[0].limit(0), both[1], 1.0).count()


def test_domains_are_checked(spark):
    values = spark.createDataFrame([(0, 0.5), (1, -0.2)], "id long, value double")
    for metric in ("reciprocal", "gaussian", "exponential", "transition", "probability", "membership"):
        with pytest.raises(Exception, match="outside the domain"):
            convert.to_distance(values, metric).collect()
    assert [round(r.value, 6) for r in convert.to_distance(values, "reverse").orderBy("id").collect()] == [-0.2, 0.5]
    for metric in ("gravity", "covariance", "other"):
        with pytest.raises(ValueError):
            convert.to_distance(values, metric)
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.4), (1, 1, 1.0)], "i long, j long, value double")
    with pytest.raises(ValueError):
        convert.to_distance(pairs, "reverse", check=True)
    with pytest.raises(Exception, match="outside the domain"):
        convert.to_distance(pairs.withColumn("value", F.col("value") - 0.45), "gravity").collect()
    with pytest.raises(Exception, match="diagonal"):
        similarity.scaled(pairs.withColumn("value", F.col("value") - 1.0)).collect()
    counts = frame(spark, [[2, 0], [1, 1]])
    for measure in ("shannon_entropy", "gini_coefficient"):
        with pytest.raises(Exception, match="0 or 1"):
            diversity.diversity(counts, measure).collect()
    with pytest.raises(Exception, match="binary"):
        diversity.hypersphere_overlap(frame(spark, [[0, 1], [1, 1]])).collect()
    assert diversity.hypersphere_overlap(frame(spark, [[3, 4], [3, 4], [3, 4]])).first()["diversity"] == 0.0
    assert diversity.nearest_average_tanimoto(frame(spark, [[0, 0], [0, 0], [1, 1]])).first()["diversity"] is None
    with pytest.raises(Exception, match="integer threshold"):
        sums = similarity.column_sums(frame(spark, [[0, 1], [1, 1]]))
        sums.select(similarity.esim("RR", F.col("sums"), F.col("n"), 2)).collect()


def test_measures_equal_scores(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(25, 4))
    bits = np.hstack([np.ones((25, 1)), x > 0]).astype(float)
    one = lambda df: df.first()["diversity"]
    for measure, rows in (("logdet", x), ("wdud", x), ("hypersphere_overlap", x), ("shannon_entropy", bits), ("gini_coefficient", bits)):
        assert one(diversity.diversity(frame(spark, rows), measure)) == pytest.approx(scores.score(measure, rows, library=rows), abs=1e-9)
    assert one(diversity.diversity(frame(spark, bits), "explicit_diversity_index", cs=3)) == pytest.approx(scores.score("explicit_diversity_index", bits, library=bits, cs=3), abs=1e-9)
    assert one(diversity.hypersphere_overlap(frame(spark, x), block=4)) == pytest.approx(scores.overlap(x, x), abs=1e-9)


def test_text_and_tables_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2.5\n3,4\n")
    rows = frames.read_text(spark, str(tmp_path / "x.csv"))
    assert [r.features for r in rows.orderBy("id").collect()] == [[1.0, 2.5], [3.0, 4.0]]
    frames.write(rows.withColumn("part", F.lit("p")), str(tmp_path / "out"), "parquet", "part")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and (tmp_path / "out" / "part=p").is_dir()


@pytest.mark.parametrize("name", ["pair_AC", "pair_modified_tanimoto", "pair_scaled", "distance_covariance", "distance_gravity", "distance_reverse", "distance_probability"])
def test_pairs_are_made_of_words_and_not_shuffled(spark, name):
    plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    # by cell; or sums of rows with sums of columns
    assert shuffled and all("_a#" in line and "_b#" in line or ", k#" in line for line in shuffled)
    assert "zip_with" not in plan


def test_fingerprint_pairs_equal_loops(spark):
    g = np.random.default_rng(5)
    for width in (1, 63, 64, 65, 130):
        x = (g.random((23, width)) > 0.5).astype(float)
        rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(90, [1.0] * (width + 1), 0), (91, None, 0), (92, [1.0], None)]
        rows = spark.createDataFrame(rows, "id long, features array<double>, g int")
        code = lambda a, d, x: a * 1e6 + d * 1e3 + x
        for by in ("g", None):
            got = {(r.i, r.j): (r.value, r._di, r._dj) for r in similarity.fingerprint_pairs(rows, code, by=by, diagonal=True, block=4).collect()}
            ids = [*range(23), 90, 91] + [92] * (by is None)
            assert set(got) == {(i, j) for i in ids for j in ids if not by or {90: 0, 91: 0}.get(i, i % 3) == {90: 0, 91: 0}.get(j, j % 3)}
            for (i, j), (value, di, dj) in got.items():
                if i < 23 and j < 23:
                    a, d = (x[i] * x[j]).sum(), ((1 - x[i]) * (1 - x[j])).sum()
                    assert value == a * 1e6 + d * 1e3 + width - a - d
                    assert di == got[i, i][0] and dj == got[j, j][0]
                elif 91 in (i, j) or {i, j} & {90} and i != j:
                    assert value is None


@pytest.mark.parametrize("name, costly", [("pair_CT2", "rint"), ("pair_modified_tanimoto", "CASE WHEN"), ("pair_RR", "rint"), ("pair_SM", "rint")])
def test_values_are_looked_up_not_computed_for_each_pair(spark, name, costly):
    df = catalogue.QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert costly.lower() not in plan.lower()[: plan.lower().index("join")]


def test_looked_up_values_equal_computed_ones(spark, monkeypatch):
    g = np.random.default_rng(6)
    for width in (1, 64, 70):
        fingerprints = [[0.0] * width, [1.0] * width, None, *(g.random((9, width)) > 0.5).astype(float).tolist()]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(fingerprints)], "id long, features array<double>")
        for key in similarity.PAIR_KEYS:
            value = lambda a, d, x, k=key: F.when(a == d, float("inf")).otherwise(similarity.index_of(k, a, d, x))
            found = []
            for most in (128, -1):
                monkeypatch.setattr(similarity, "PAIR_TABLE", most)
                found.append(sorted(map(tuple, similarity.fingerprint_pairs(rows, value, block=4).select("i", "j", "value").collect()), key=lambda r: r[:2]))
            assert found[0] == found[1] and len(found[0]) == 144
            assert all(v is None for i, j, v in found[0] if 2 in (i, j))


def test_pairs_with_nothing_in_common(spark, tmp_path):
    """Fingerprints of one label without a common 1: similarity 0, as SQL converts it."""
    rows = [(i, [1.0 if k % 4 in on else -1.0 for k in range(8)], i % 2) for i, on in enumerate([{0}, {0, 1}, {1}, {1, 2}, {2, 3}, {0, 1, 2}, {3}, {2, 3}])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for metric in ("probability", "reciprocal", "transition", "gravity", "co_occurrence", "exponential", "gaussian", "reverse", "covariance"):
        name = f"distance_{metric}"
        got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select("label", "i", "j", "value").collect()))
        assert got == sorted(db.execute(f"select label, i, j, value from ({catalogue.ORACLES[name]})").fetchall())
        assert metric not in ("probability", "gravity", "gaussian") or any(np.isinf(r[3]) for r in got)


def test_diagonals_of_given_pairs(spark):
    pairs = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 9.0)], "i long, j long, value double")
    values = lambda df: {(r.i, r.j): round(r.value, 9) for r in df.collect()}
    assert values(similarity.scaled(pairs)) == {(0, 0): 1.0, (0, 1): round(2 / 6, 9), (1, 0): round(2 / 6, 9), (1, 1): 1.0}
    assert values(convert.to_distance(pairs, "covariance", scale=2.0)) == {(0, 0): 0.0, (0, 1): round(18**0.5, 9), (1, 0): round(18**0.5, 9), (1, 1): 0.0}
    there = pairs.withColumns({"_di": F.when(F.col("i") == 0, 4.0).otherwise(9.0), "_dj": F.when(F.col("j") == 0, 4.0).otherwise(9.0)})
    assert values(similarity.scaled(there)) == values(similarity.scaled(pairs))
    got = convert.to_distance(there, "covariance", scale=2.0)
    assert values(got) == values(convert.to_distance(pairs, "covariance", scale=2.0)) and got.columns == ["i", "j", "value"]
