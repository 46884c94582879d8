"""Named queries over the driver's tables, with SQL for an independent check."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import convert, diversity, similarity
from sieveline.functions.vectors import bits, minkowski
from sieveline.operators import joins, large, quota, select
from sieveline.sources.frames import features

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return features(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "label")


def prints(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("features", bits(F.col("features")))


def _r(c, n: int = 9):
    return F.round(c, n) + 0.0


_SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda z: {f}))"
_DOT = lambda a, b: _SUM.format(a=a, b=b, f="z[1] * z[2]")
_OFF = lambda a, b: _SUM.format(a=a, b=b, f="(1 - z[1]) * (1 - z[2])")
_DIST = lambda a, b: "sqrt(" + _SUM.format(a=a, b=b, f="(z[1] - z[2]) * (z[1] - z[2])") + ")"
_VEC = "p AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_BITS = "p AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM embeddings)"

# --- groups and quotas


@query("census", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def census(spark, d):
    return quota.census(vectors(spark, d), "label")


def _quotas(how: str):
    def run(spark, d):
        q = quota.allocate(vectors(spark, d), "label", 100, how)
        return spark.createDataFrame(sorted(q.items()), "label int, quota long")

    return run


query(
    "quota_proportional",
    """
WITH RECURSIVE c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
r(step, label, n, q) AS (
  SELECT 0, label, n, greatest(1, CAST(round_even(100 * n / (SELECT sum(n) FROM c), 0) AS BIGINT)) FROM c
  UNION ALL
  SELECT r.step + 1, r.label, r.n, r.q + CASE WHEN t.total > 100 AND r.label = t.top THEN -1 WHEN t.total < 100 AND r.label = t.low THEN 1 ELSE 0 END
  FROM r, (SELECT sum(q) AS total, arg_max(label, struct_pack(q := q, k := -label)) AS top, arg_min(label, struct_pack(q := q, k := label)) FILTER (q < n) AS low FROM r) t
  WHERE t.total <> 100
)
SELECT label, least(q, n) AS quota FROM r WHERE step = (SELECT max(step) FROM r)
""",
)(_quotas("proportional"))
query("quota_equal", "SELECT label, 100 // (SELECT count(DISTINCT label) FROM embeddings) AS quota FROM embeddings GROUP BY label")(_quotas("equal"))

# --- selection


def _greedy_sql(merge: str, k: int = 5) -> str:
    return f"""
WITH RECURSIVE {_VEC},
d AS MATERIALIZED (SELECT a.label, a.id AS i, b.id AS j, {_DIST("a.e", "b.e")} AS d FROM p a JOIN p b ON a.label = b.label),
s AS (SELECT label, arg_min(i, struct_pack(s := s, i := i)) AS pick FROM (SELECT label, i, sum(d) AS s FROM d GROUP BY 1, 2) GROUP BY 1),
r(rk, label, id, v, used, pick) AS (
  SELECT 0, d.label, d.j, d.d, d.j = s.pick, s.pick FROM d JOIN s ON s.label = d.label AND d.i = s.pick
  UNION ALL
  SELECT r.rk + 1, r.label, r.id, {merge}, r.used OR r.id = b.pick, b.pick
  FROM r JOIN (SELECT label, arg_max(id, struct_pack(v := v, k := -id)) FILTER (NOT used) AS pick FROM r GROUP BY label) b ON b.label = r.label
  JOIN d ON d.label = r.label AND d.i = b.pick AND d.j = r.id
  WHERE r.rk < {k - 1}
)
SELECT DISTINCT label, rk AS rank, pick AS id FROM r
"""


def _each(strategy):
    def run(spark, d):
        rows = vectors(spark, d)
        return select.select(rows, strategy, 5 * rows.select("label").distinct().count(), by="label", allocation="equal")

    return run


query("maxmin_per_label", _greedy_sql("least(r.v, d.d)"))(_each(select.MaxMin()))
query("maxsum_per_label", _greedy_sql("r.v + d.d"))(_each(select.MaxSum()))
query("optisim_per_label")(_each(select.OptiSim()))
query("dise_per_label")(_each(select.DISE()))
query("furthest_centroid_per_label")(_each(select.FurthestCentroid()))
query(
    "furthest_centroid_exact",
    f"""
WITH RECURSIVE {_VEC},
f AS (SELECT label, min(id) AS pick FROM p GROUP BY 1),
r(rk, label, id, e, used, total, pick) AS (
  SELECT 0, p.label, p.id, p.e, p.id = f.pick, s.e, f.pick FROM p JOIN f ON f.label = p.label JOIN p s ON s.id = f.pick
  UNION ALL
  SELECT r.rk + 1, r.label, r.id, r.e, r.used OR r.id = b.pick, list_transform(list_zip(r.total, s.e), lambda z: z[1] + z[2]), b.pick
  FROM r JOIN (SELECT label, arg_max(id, struct_pack(d := {_SUM.format(a="e", b="total", f="(z[1] - z[2] / (rk + 1)) * (z[1] - z[2] / (rk + 1))")}, k := -id)) FILTER (NOT used) AS pick FROM r GROUP BY label) b ON b.label = r.label
  JOIN p s ON s.id = b.pick WHERE r.rk < 4
)
SELECT DISTINCT label, rk AS rank, pick AS id FROM r
""",
)(_each(select.FurthestCentroid(exact=True, scaling=0)))
# each label's values scaled by its least and largest one, as distances from the column's mean
_SCALED = f"""{_VEC},
u AS (SELECT label, id, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM p),
g AS (SELECT label, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1),
w AS (SELECT u.label, id, pos, (v - lo) / (hi - lo) AS v FROM u JOIN g ON g.label = u.label),
m AS (SELECT label, pos, avg(v) AS mean FROM w GROUP BY 1, 2),
x AS MATERIALIZED (SELECT w.label, id, list(1 - abs(v - mean) ORDER BY w.pos) AS e FROM w JOIN m ON m.label = w.label AND m.pos = w.pos GROUP BY 1, 2)"""
_COUNTS = {"RR": "a / (a + d + x)", "JT": "a / (a + x)", "SM": "(a + d) / (a + d + x)"}


def _index_sql(key: str, sums: str, n: str) -> str:
    """The isim index of a list of column sums."""
    part = lambda f: f"list_sum(list_transform({sums}, lambda c: {f}))"
    a, d, x = part("c * (c - 1) / 2"), part(f"({n} - c) * ({n} - c - 1) / 2"), part(f"({n} - c) * c")
    return _COUNTS[key].replace("a", "{A}").replace("d", "{D}").replace("x", "{X}").format(A=f"({a})", D=f"({d})", X=f"({x})")


_ADD = "list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
_LESS = "list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"
_TOTALS = "n AS MATERIALIZED (SELECT label, list(s ORDER BY pos) AS total, max(k) AS k FROM (SELECT label, pos, sum(v) AS s, count(*) AS k FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM x) GROUP BY 1, 2) GROUP BY 1)"
_LEAVE_ONE = "SELECT x.label, id, {index} AS v FROM x JOIN n ON n.label = x.label"


def _nary_sql(key: str) -> str:
    return f"""
WITH RECURSIVE {_SCALED}, {_TOTALS},
o AS ({_LEAVE_ONE.format(index=_index_sql(key, _LESS.format(a="n.total", b="x.e"), "(k - 1)"))}),
f AS (SELECT label, arg_min(id, struct_pack(v := v, i := id)) AS pick FROM o GROUP BY 1),
r(rk, label, id, e, used, total, pick) AS (
  SELECT 0, x.label, x.id, x.e, x.id = f.pick, s.e, f.pick FROM x JOIN f ON f.label = x.label JOIN x s ON s.id = f.pick
  UNION ALL
  SELECT r.rk + 1, r.label, r.id, r.e, r.used OR r.id = b.pick, {_ADD.format(a="r.total", b="s.e")}, b.pick
  FROM r JOIN (SELECT label, arg_min(id, struct_pack(v := {_index_sql(key, _ADD.format(a="total", b="e"), "(rk + 2)")}, i := id)) FILTER (NOT used) AS pick FROM r GROUP BY label) b ON b.label = r.label
  JOIN x s ON s.id = b.pick WHERE r.rk < 4
)
SELECT DISTINCT label, rk AS rank, pick AS id FROM r
"""


for _key in ("RR", "JT", "SM"):
    query(f"nsim_select_{_key}", _nary_sql(_key))(_each(select.NSimilarity(key=_key)))

_BITX = f"{_BITS}, x AS (SELECT * FROM p), {_TOTALS}"
query("nary_medoid", f"WITH {_BITX}, o AS ({_LEAVE_ONE.format(index=_index_sql('JT', _LESS.format(a='n.total', b='x.e'), '(k - 1)'))}) SELECT label, arg_min(id, struct_pack(v := v, i := id)) AS id FROM o GROUP BY 1")(lambda spark, d: large.nary_medoid(prints(spark, d), "label", key="JT"))
query("nary_outlier", f"WITH {_BITX}, o AS ({_LEAVE_ONE.format(index=_index_sql('RR', _LESS.format(a='n.total', b='x.e'), '(k - 1)'))}) SELECT label, arg_min(id, struct_pack(v := -v, i := id)) AS id FROM o GROUP BY 1")(lambda spark, d: large.nary_outlier(prints(spark, d), "label", key="RR"))


@query(
    "nary_next",
    f"""WITH {_BITS}, c AS (SELECT label, id, e FROM p WHERE id IN (SELECT min(id) FROM p GROUP BY label)), o AS (
  SELECT p.label, p.id, {_index_sql("SM", _ADD.format(a="c.e", b="p.e"), "2")} AS v FROM p JOIN c ON c.label = p.label WHERE p.id <> c.id)
SELECT label, arg_min(id, struct_pack(v := v, i := id)) AS id FROM o GROUP BY 1""",
)
def nary_next(spark, d):
    rows = prints(spark, d)
    return large.nary_next(rows, rows.groupBy("label").agg(F.min("id").alias("id")), "label", key="SM")


@query("grid_select")
def grid_select(spark, d):
    part = features(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", ["p_size", "p_retailprice"])
    return select.select(part, select.GridPartition(bins=4), 20)


@query("medoid_per_label", f"WITH {_VEC}, s AS (SELECT a.label, a.id AS i, sum({_DIST('a.e', 'b.e')}) AS s FROM p a JOIN p b ON a.label = b.label GROUP BY 1, 2) SELECT label, arg_min(i, struct_pack(s := s, i := i)) AS id FROM s GROUP BY label")
def medoid_per_label(spark, d):
    return select.medoids(vectors(spark, d), by="label")


@query("complement", "WITH " + _greedy_sql("least(r.v, d.d)").strip().removeprefix("WITH ").replace("SELECT DISTINCT label, rk AS rank, pick AS id FROM r", "SELECT id, label FROM p WHERE id NOT IN (SELECT pick FROM r)"))
def complement(spark, d):
    return select.complement(vectors(spark, d), QUERIES["maxmin_per_label"](spark, d)).select("id", "label")


def _large_sql(merge: str) -> str:
    return f"""
WITH RECURSIVE {_VEC},
r(rk, id, e, v, used, pick) AS (
  SELECT 0, p.id, p.e, {_DIST("p.e", "s.e")}, p.id = 0, 0 FROM p JOIN p s ON s.id = 0
  UNION ALL
  SELECT r.rk + 1, r.id, r.e, {merge.format(d=_DIST("r.e", "s.e"))}, r.used OR r.id = b.pick, b.pick
  FROM r, (SELECT arg_max(id, struct_pack(v := v, k := -id)) FILTER (NOT used) AS pick FROM r) b JOIN p s ON s.id = b.pick WHERE r.rk < 19
)
SELECT DISTINCT CAST(rk AS INT) AS rank, CAST(pick AS BIGINT) AS id FROM r
"""


query("maxmin_large", _large_sql("least(r.v, {d})"))(lambda spark, d: large.max_min_large(vectors(spark, d), 20, 0))
query("maxsum_large", _large_sql("r.v + {d}"))(lambda spark, d: large.max_sum_large(vectors(spark, d), 20, 0))


@query(
    "dise_fixed_radius",
    f"""
WITH RECURSIVE {_VEC}, o AS MATERIALIZED (SELECT p.id, p.e, row_number() OVER (ORDER BY {_DIST("p.e", "s.e")}, p.id) AS rk FROM p JOIN p s ON s.id = 0),
r(rk, picks, ids) AS (
  SELECT 1, [e], [id] FROM o WHERE rk = 1
  UNION ALL
  SELECT r.rk + 1, CASE WHEN t.free THEN list_append(picks, t.e) ELSE picks END, CASE WHEN t.free THEN list_append(ids, t.id) ELSE ids END
  FROM r JOIN (SELECT o.rk, o.e, o.id, len(list_filter(r.picks, lambda y: {_DIST("o.e", "y")} <= 1.3)) = 0 AS free FROM o JOIN r ON o.rk = r.rk + 1) t ON t.rk = r.rk + 1
)
SELECT CAST(unnest(range(len(ids))) AS INT) AS rank, unnest(ids) AS id FROM (SELECT ids FROM r ORDER BY rk DESC LIMIT 1)
""",
)
def dise_fixed_radius(spark, d):
    return large.dise_large(vectors(spark, d), 1.3, 0)


@query(
    "furthest_centroid_large",
    f"""
WITH RECURSIVE {_VEC},
r(rk, id, e, used, total, pick) AS (
  SELECT 0, p.id, p.e, p.id = 0, s.e, 0 FROM p JOIN p s ON s.id = 0
  UNION ALL
  SELECT r.rk + 1, r.id, r.e, r.used OR r.id = b.pick, {_ADD.format(a="r.total", b="s.e")}, b.pick
  FROM r, (SELECT arg_max(id, struct_pack(d := {_SUM.format(a="e", b="total", f="(z[1] - z[2] / (rk + 1)) * (z[1] - z[2] / (rk + 1))")}, k := -id)) FILTER (NOT used) AS pick FROM r) b JOIN p s ON s.id = b.pick WHERE r.rk < 9
)
SELECT DISTINCT CAST(rk AS INT) AS rank, CAST(pick AS BIGINT) AS id FROM r
""",
)
def furthest_centroid_large(spark, d):
    return large.furthest_centroid_large(vectors(spark, d), 10, 0, scaling=0)


@query("opti_sim_large")
def opti_sim_large(spark, d):
    return large.opti_sim_large(vectors(spark, d), 1.2, 0, 10)


@query("n_similarity_large", f"""
WITH RECURSIVE {_BITS}, r(rk, id, e, used, total, pick) AS (
  SELECT 0, p.id, p.e, p.id = 0, s.e, 0 FROM p JOIN p s ON s.id = 0
  UNION ALL
  SELECT r.rk + 1, r.id, r.e, r.used OR r.id = b.pick, {_ADD.format(a="r.total", b="s.e")}, b.pick
  FROM r, (SELECT arg_min(id, struct_pack(v := {_index_sql("RR", _ADD.format(a="total", b="e"), "(rk + 2)")}, i := id)) FILTER (NOT used) AS pick FROM r) b JOIN p s ON s.id = b.pick WHERE r.rk < 9
)
SELECT DISTINCT CAST(rk AS INT) AS rank, CAST(pick AS BIGINT) AS id FROM r
""")
def n_similarity_large(spark, d):
    return large.n_similarity_large(prints(spark, d), 10, 0, key="RR")


@query("grid_select_large")
def grid_select_large(spark, d):
    return large.grid_select_large(spark.read.parquet(f"{d}/part.parquet"), ["p_size", "p_retailprice"], 40, 4, id="p_partkey")


@query("maxmin_from_pairs", _greedy_sql("least(r.v, d.d)"))
def maxmin_from_pairs(spark, d):
    rows = vectors(spark, d)
    pairs = similarity.pair_frame(rows, minkowski, by="label")
    return select.select_pairs(pairs, select.MaxMin(), 5 * rows.select("label").distinct().count(), by="label", allocation="equal")


# --- joins by distance


@query("radius_join", f"WITH {_VEC} SELECT a.id AS i, b.id AS j, round({_DIST('a.e', 'b.e')}, 9) + 0.0 AS distance FROM p a JOIN p b ON {_DIST('a.e', 'b.e')} <= 1.2")
def radius_join(spark, d):
    rows = vectors(spark, d)
    return joins.radius_join(rows, rows, 1.2).withColumn("distance", _r(F.col("distance")))


@query("knn_join", f"WITH {_VEC}, q AS (SELECT a.label, a.id AS i, b.id AS j, {_DIST('a.e', 'b.e')} AS v FROM p a JOIN p b ON a.label = b.label), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v, j) AS rank FROM q) SELECT label, i, CAST(rank AS INT) AS rank, j, round(v, 9) + 0.0 AS distance FROM r WHERE rank <= 3")
def knn_join(spark, d):
    rows = vectors(spark, d)
    return joins.knn_join(rows, rows, 3, by="label").withColumn("distance", _r(F.col("distance")))


@query("random_rows", "SELECT vec_id AS id, label FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 50")
def random_rows(spark, d):
    return select.random_rows(vectors(spark, d).select("id", "label"), 50)


# --- binning


@query("bins_width", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, CAST(floor((p_retailprice - lo) / ((hi - lo) / 4)) AS INT) AS bin FROM part, e")
def bins_width(spark, d):
    return select.width_binned(spark.read.parquet(f"{d}/part.parquet"), "p_retailprice", 4).select("p_partkey", "bin")


@query("bins_width_dependent", "WITH e AS (SELECT p_partkey, p_retailprice AS x, min(p_retailprice) OVER (PARTITION BY p_size) AS lo, max(p_retailprice) OVER (PARTITION BY p_size) AS hi FROM part) SELECT p_partkey, CASE WHEN hi > lo THEN CAST(floor((x - lo) / ((hi - lo) / 4)) AS INT) ELSE 0 END AS bin FROM e")
def bins_width_dependent(spark, d):
    return select.width_binned(spark.read.parquet(f"{d}/part.parquet"), "p_retailprice", 4, "p_size").select("p_partkey", "bin")


def _frequency_sql(table: str, group: str, value: str, bins: int) -> str:
    """(g, x, bin): of each value of each group, by the edges' values joined on integer ranks."""
    return f"""s AS MATERIALIZED (SELECT {group} AS g, {value} AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {group}) AS n FROM {table}),
t AS (SELECT g, m, least(m * n / {bins}.0::DOUBLE, n - 1) AS at FROM (SELECT DISTINCT g, n FROM s), (SELECT unnest(range({bins + 1})) AS m)),
lo AS (SELECT t.g, t.m, t.at, s.x FROM t JOIN s ON s.g = t.g AND s.r = CAST(floor(t.at) AS BIGINT)),
e AS MATERIALIZED (SELECT lo.g, lo.m, lo.x + (s.x - lo.x) * (lo.at - floor(lo.at)) AS v FROM lo JOIN s ON s.g = lo.g AND s.r = CAST(ceil(lo.at) AS BIGINT)),
l AS (SELECT g, list(v ORDER BY m) AS v FROM e GROUP BY g),
b AS MATERIALIZED (SELECT u.g, u.x, CAST(coalesce(list_position(l.v, list_max(list_filter(l.v, lambda k: k < u.x))) - 1, 0) AS INT) AS bin FROM (SELECT DISTINCT g, x FROM s) u JOIN l ON l.g = u.g)"""


@query("bins_frequency", f"WITH {_frequency_sql('lineitem', 'l_returnflag', 'l_quantity', 5)} SELECT l_returnflag, bin, count(*) AS n FROM lineitem JOIN b ON b.g = l_returnflag AND b.x = l_quantity GROUP BY 1, 2")
def bins_frequency(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return select.frequency_binned(rows, "l_quantity", 5, "l_returnflag").groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"))


@query("bins_frequency_all", f"WITH {_frequency_sql('part', '0', 'p_retailprice', 7)} SELECT p_partkey, bin FROM part JOIN b ON b.x = p_retailprice")
def bins_frequency_all(spark, d):
    return select.frequency_binned(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice"), "p_retailprice", 7).select("p_partkey", "bin")


_WIDE = "CASE WHEN {hi} > {lo} THEN CAST(floor(({x} - {lo}) / (({hi} - {lo}) / 4)) AS INT) ELSE 0 END"


def _grid(method: str):
    def run(spark, d):
        part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
        cells = select.grid_binned(part, ["p_size", "p_retailprice"], 4, method)
        return cells.select("p_partkey", F.col("cell")[0].alias("a"), F.col("cell")[1].alias("b"))

    return run


_FIRST = f"w AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS x, min(p_size::DOUBLE) OVER () AS l1, max(p_size::DOUBLE) OVER () AS h1, min(p_retailprice) OVER () AS l2, max(p_retailprice) OVER () AS h2 FROM part), v AS MATERIALIZED (SELECT *, {_WIDE.format(x='s', lo='l1', hi='h1')} AS a FROM w)"
query("grid_equisized_independent", f"WITH {_FIRST} SELECT p_partkey, a, {_WIDE.format(x='x', lo='l2', hi='h2')} AS b FROM v")(_grid("equisized_independent"))
query("grid_equisized_dependent", f"WITH {_FIRST}, y AS (SELECT p_partkey, a, x, min(x) OVER (PARTITION BY a) AS lo, max(x) OVER (PARTITION BY a) AS hi FROM v) SELECT p_partkey, a, {_WIDE.format(x='x', lo='lo', hi='hi')} AS b FROM y")(_grid("equisized_dependent"))
_TWO = lambda group, sub: _frequency_sql(sub, group, "p_retailprice", 4).replace("s AS MAT", "s2 AS MAT").replace("FROM s)", "FROM s2)").replace("JOIN s ON", "JOIN s2 s ON").replace("t AS (", "t2 AS (").replace("FROM t JOIN", "FROM t2 t JOIN").replace("lo AS (", "lo2 AS (").replace("FROM lo JOIN", "FROM lo2 lo JOIN").replace("e AS MAT", "e2 AS MAT").replace("FROM e GROUP", "FROM e2 GROUP").replace("l AS (", "l2 AS (").replace("JOIN l ON", "JOIN l2 l ON").replace("b AS MAT", "b2 AS MAT")
_A = f"z AS MATERIALIZED (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice FROM part), {_frequency_sql('z', '0', 's', 4)}, k AS MATERIALIZED (SELECT p_partkey, p_retailprice, b.bin AS a FROM z JOIN b ON b.x = z.s)"
query("grid_equifrequent_independent", f"WITH {_A}, {_TWO('0', 'k')} SELECT p_partkey, a, b2.bin AS b FROM k JOIN b2 ON b2.x = p_retailprice")(_grid("equifrequent_independent"))
query("grid_equifrequent_dependent", f"WITH {_A}, {_TWO('a', 'k')} SELECT p_partkey, a, b2.bin AS b FROM k JOIN b2 ON b2.g = a AND b2.x = p_retailprice")(_grid("equifrequent_dependent"))


# --- pairwise similarity and its conversions, of all pairs of fingerprints within every label

#: The indices from a, d, x and their weighted counts wa, wd, wx.
_FORMULA = {
    "AC": "2 / pi() * asin(sqrt((wa + wd) / (a + d + x)))",
    "BUB": "(sqrt(wa * wd) + wa) / (sqrt(a * d) + a + x)",
    "CT1": "ln(1 + wa + wd) / ln(1 + a + d + x)",
    "CT2": "(ln(1 + wa + wd + wx) - ln(1 + wx)) / ln(1 + a + d + x)",
    "CT3": "ln(1 + wa) / ln(1 + a + d + x)",
    "CT4": "ln(1 + wa) / ln(1 + a + x)",
    "Fai": "(wa + wd / 2) / (a + d + x)",
    "Gle": "2 * wa / (2 * a + x)",
    "Ja": "3 * wa / (3 * a + x)",
    "Ja0": "3 * (wa + wd) / (3 * (a + d) + x)",
    "JT": "wa / (a + x)",
    "RT": "(wa + wd) / (a + d + 2 * x)",
    "RR": "wa / (a + d + x)",
    "SM": "(wa + wd) / (a + d + x)",
    "SS1": "wa / (a + 2 * x)",
    "SS2": "2 * (wa + wd) / (a + d + x + a + d)",
}


def _plain(key: str) -> str:
    return _FORMULA[key].replace("wa", "a").replace("wd", "d").replace("wx", "x")


_MT = "(2 - (p - d + a) / (2 * p)) / 3 * (CASE WHEN d = p THEN 1 ELSE a / (p - d) END) + (1 + (p - d + a) / (2 * p)) / 3 * (CASE WHEN a = p THEN 1 ELSE d / (p - a) END)"

_CONVERT = {
    "reverse": "hi + lo - v",
    "reciprocal": "1 / v",
    "exponential": "-ln(v / hi)",
    "gaussian": "sqrt(abs(-ln(v / hi)))",
    "correlation": "sqrt(1 - v)",
    "transition": "1 / sqrt(v)",
    "co_occurrence": "1 / (1 + v * s / b)",
    "gravity": "sqrt(b / (v * s))",
    "probability": "1 / sqrt(asin(v))",
    "membership": "1 - v",
    "confusion": "1 - v",
}
_PL = f"WITH {_BITS}, q AS MATERIALIZED (SELECT x.label AS label, x.id AS i, y.id AS j, {_DOT('x.e', 'y.e')} AS a, {_OFF('x.e', 'y.e')} AS d, len(x.e)::DOUBLE AS p FROM p x JOIN p y ON x.label = y.label)"
_AXDL = _PL + ", c AS MATERIALIZED (SELECT label, i, j, a, d, p - a - d AS x, p FROM q)"
_TL = f"{_AXDL}, t0 AS MATERIALIZED (SELECT label, i, j, a / (a + x) AS v FROM c)"
_TL += ", rw AS (SELECT label, i AS k, sum(v) AS r FROM t0 GROUP BY 1, 2), cl AS (SELECT label, j AS k, sum(v) AS c FROM t0 GROUP BY 1, 2), b AS (SELECT label, sum(r * c) AS b, sum(r) AS s FROM rw JOIN cl USING (label, k) GROUP BY 1)"
_TL += ", e AS (SELECT label, max(v) AS hi, min(v) AS lo FROM t0 GROUP BY 1), t AS (SELECT t0.*, b, s, hi, lo FROM t0 JOIN b USING (label) JOIN e USING (label))"
_DIAGONAL = "JOIN g u ON u.i = q.i JOIN g v ON v.i = q.j"
_PD = _PL + ", g AS MATERIALIZED (SELECT i, a FROM q WHERE i = j)"


def _r9(c):
    """Nine decimals, halves away from 0, by arithmetic on doubles; F.round makes a decimal of each value."""
    y = c * 1e9
    near = F.rint(y)
    return F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near) / 1e9 + 0.0


def _each_label(value, after=None, diagonal=False):
    def run(spark, d):
        if after is None:
            return similarity.fingerprint_pairs(prints(spark, d), lambda a, d, x: _r9(value(a, d, x)), by="label")
        return after(similarity.fingerprint_pairs(prints(spark, d), value, by="label", diagonal=diagonal, table=False)).withColumn("value", _r9(F.col("value")))

    return run


_TANIMOTO = lambda a, d, x: similarity.ratio(a, a + x)
_ONES = lambda a, d, x: a


for _key in similarity.PAIR_KEYS:
    query(f"pair_{_key}", f"{_AXDL} SELECT label, i, j, round({_plain(_key)}, 9) + 0.0 AS value FROM c")(_each_label(lambda a, d, x, k=_key: similarity.index_of(k, a, d, x)))
query("pair_tanimoto", f"{_AXDL} SELECT label, i, j, round(a / (a + x), 9) + 0.0 AS value FROM c")(_each_label(_TANIMOTO))
query("pair_modified_tanimoto", f"{_PL} SELECT label, i, j, round({_MT}, 9) + 0.0 AS value FROM q")(_each_label(lambda a, d, x: similarity.modified_of(a, d, a + d + x)))
query("pair_scaled", f"{_PD} SELECT q.label, q.i, q.j, round(q.a / sqrt(u.a * v.a), 9) + 0.0 AS value FROM q {_DIAGONAL}")(_each_label(_ONES, lambda pairs: similarity.scaled(pairs, "label"), diagonal=True))
for _metric, _sql in _CONVERT.items():
    query(f"distance_{_metric}", f"{_TL} SELECT label, i, j, round({_sql}, 9) + 0.0 AS value FROM t")(_each_label(_TANIMOTO, lambda pairs, m=_metric: convert.to_distance(pairs, m, "label", zeros=True)))
query("distance_covariance", f"{_PD} SELECT q.label, q.i, q.j, round(sqrt(u.a + v.a - 2 * q.a), 9) + 0.0 AS value FROM q {_DIAGONAL}")(_each_label(_ONES, lambda pairs: convert.to_distance(pairs, "covariance", "label"), diagonal=True))


# --- n-ary similarity of each label's fingerprints

_SETS = f"WITH {_BITS}, k AS (SELECT label, pos, sum(v) AS c, count(*)::DOUBLE AS n FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM p) GROUP BY 1, 2)"
_ISIM = _SETS + ", c AS (SELECT label, sum(c * (c - 1) / 2) AS a, sum((n - c) * (n - c - 1) / 2) AS d, sum((n - c) * c) AS x FROM k GROUP BY 1)"
_ESIM = _SETS + """, g AS (SELECT *, abs(2 * c - n) AS gap, CASE WHEN 2 * c - n > {bar} THEN 1 WHEN n - 2 * c > {bar} THEN 2 ELSE 3 END AS kind FROM k),
c AS (SELECT label, count(*) FILTER (kind = 1)::DOUBLE AS a, count(*) FILTER (kind = 2)::DOUBLE AS d, count(*) FILTER (kind = 3)::DOUBLE AS x,
  coalesce(sum({alike}) FILTER (kind = 1), 0) AS wa, coalesce(sum({alike}) FILTER (kind = 2), 0) AS wd, coalesce(sum({unlike}) FILTER (kind = 3), 0) AS wx FROM g GROUP BY 1)"""


def _sets(value):
    def run(spark, d):
        sums = similarity.column_sums(prints(spark, d), "label")
        return sums.select("label", _r(value(F.col("sums"), F.col("n"))).alias("value"))

    return run


for _key in similarity.INDEX_KEYS:
    query(f"isim_{_key}", f"{_ISIM} SELECT label, round({_plain(_key)}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key: similarity.isim(k, s, n)))
    for _name, _bar, _thr in (("none", "n % 2", None), ("dissimilar", "ceil(n / 2)", "dissimilar")):
        for _w, _alike, _unlike in (("fraction", "gap / n", "1 - (gap - n % 2) / n"), ("power_3", "pow(3, -(n - gap))", "pow(3, -(gap - n % 2))")):
            _sql = _ESIM.format(bar=_bar, alike=_alike, unlike=_unlike)
            query(f"esim_{_key}_{_name}_{_w}", f"{_sql} SELECT label, round({_FORMULA[_key]}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key, t=_thr, w=_w: similarity.esim(k, s, n, t, w)))

# roots of the counts, thresholds in numbers, no weights
_ROOTS = _SETS + ", c AS (SELECT label, sum(pow(c * (c - 1) / 2, 1 / {o}.0)) AS a, sum(pow((n - c) * (n - c - 1) / 2, 1 / {o}.0)) AS d, sum(pow((n - c) * c, 1 / {o}.0)) AS x FROM k GROUP BY 1)"
for _o in (2, 5, 10):
    for _key in ("RR", "JT", "CT1"):
        query(f"isim_{_key}_order_{_o}", f"{_ROOTS.format(o=_o)} SELECT label, round({_plain(_key)}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key, o=_o: similarity.isim(k, s, n, o)))
        _sql = _ESIM.format(bar="n % 2", alike=f"pow(gap / n, 1 / {_o}.0)", unlike=f"pow(1 - (gap - n % 2) / n, 1 / {_o}.0)")
        query(f"esim_{_key}_order_{_o}", f"{_sql} SELECT label, round({_FORMULA[_key]}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key, o=_o: similarity.esim(k, s, n, order=o)))
for _key in ("RR", "SM", "BUB"):
    _sql = _ESIM.format(bar="2", alike="gap / n", unlike="1 - (gap - n % 2) / n")
    query(f"esim_{_key}_threshold_2", f"{_sql} SELECT label, round({_FORMULA[_key]}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key: similarity.esim(k, s, n, 2)))
    _sql = _ESIM.format(bar="n % 2", alike="1", unlike="1")
    query(f"esim_{_key}_unweighted", f"{_sql.replace('coalesce(sum(1) FILTER (kind = 1), 0)', '1.0').replace('coalesce(sum(1) FILTER (kind = 2), 0)', '1.0').replace('coalesce(sum(1) FILTER (kind = 3), 0)', '1.0')} SELECT label, round({_FORMULA[_key]}, 9) + 0.0 AS value FROM c")(_sets(lambda s, n, k=_key: similarity.esim(k, s, n, weight="none")))

# --- diversity

_SHARE = f"WITH {_BITS}, k AS (SELECT label, pos, avg(v) AS p, sum(v) AS b FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM p) GROUP BY 1, 2)"


def _diverse(frame, measure: str, **options):
    def run(spark, d):
        return diversity.diversity(frame(spark, d), measure, "label", **options).withColumn("diversity", _r(F.col("diversity")))

    return run


query("diversity_shannon", _SHARE + " SELECT label, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END), 9) + 0.0 AS diversity FROM k GROUP BY 1")(_diverse(prints, "shannon_entropy"))
query("diversity_gini", _SHARE + ", r AS (SELECT label, b, row_number() OVER (PARTITION BY label ORDER BY b, pos) AS r FROM k) SELECT label, round(2 * sum(r * b) / (count(*) * sum(b)) - (count(*) + 1) / count(*), 9) + 0.0 AS diversity FROM r GROUP BY 1")(_diverse(prints, "gini_coefficient"))
query(
    "diversity_wdud",
    f"""WITH {_VEC}, x AS (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM p),
m AS (SELECT label, pos, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY 1, 2 HAVING max(v) > min(v)),
u AS (SELECT label, pos, round((v - lo) / (hi - lo), 6) AS y, count(*) AS c, max(n) AS n FROM x JOIN m USING (label, pos) GROUP BY 1, 2, 3),
s AS (SELECT label, pos, y AS l, lead(y) OVER w AS u, (sum(c) OVER w) / n AS f FROM u WINDOW w AS (PARTITION BY label, pos ORDER BY y)),
a AS (SELECT label, pos, CASE WHEN f <= l OR f >= u THEN abs((l + u) / 2 - f) * (u - l)
  ELSE ((f - l) * (f - l) + (u - f) * (u - f)) / 2 + ((f - l) - floor((f - l) / ((u - l) / 999)) * ((u - l) / 999)) * ((u - l) / 999 - ((f - l) - floor((f - l) / ((u - l) / 999)) * ((u - l) / 999))) END AS d FROM s WHERE u IS NOT NULL),
c AS (SELECT label, pos, sum(d) AS d FROM a GROUP BY 1, 2) SELECT label, round(avg(d), 9) + 0.0 AS diversity FROM c GROUP BY 1""",
)(_diverse(vectors, "wdud"))
_NAT = f"WITH {_BITS}, q AS (SELECT x.label, x.id AS i, y.id AS j, {_DIST('x.e', 'y.e')} AS dist, {_DOT('x.e', 'y.e')} / ({_DOT('x.e', 'x.e')} + {_DOT('y.e', 'y.e')} - {_DOT('x.e', 'y.e')}) AS t FROM p x JOIN p y ON x.label = y.label AND x.id <> y.id), m AS (SELECT label, i, arg_min(t, struct_pack(d := dist, j := j)) AS t FROM q GROUP BY 1, 2), nat AS (SELECT label, avg(t) AS nat, count(*) AS n FROM m GROUP BY 1)"


@query("nearest_average_tanimoto", _NAT + " SELECT label, round(nat, 9) + 0.0 AS diversity FROM nat")
def nearest_average_tanimoto(spark, d):
    return diversity.nearest_average_tanimoto(prints(spark, d), "label").withColumn("diversity", _r(F.col("diversity")))


query("diversity_edi", _NAT + f", e AS (SELECT label, ((1 - nat) / (0.8047 - 0.065 * ln(n)) - log10(n / 25.0)) * {math.sqrt(0.5)!r} AS e FROM nat) SELECT label, round((tanh(e / 3) + 1) / 2 * 100, 9) + 0.0 AS diversity FROM e")(_diverse(prints, "explicit_diversity_index", cs=5.0))
query(
    "diversity_hypersphere",
    f"""WITH {_VEC}, x AS (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM p), r AS (SELECT list(struct_pack(lo := lo, hi := hi) ORDER BY pos) AS r FROM (SELECT pos, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1)),
u AS MATERIALIZED (SELECT label, id, list_transform(list_zip(e, r.r), lambda z: (z[1] - z[2].lo) / (z[2].hi - z[2].lo)) AS u, len(e)::DOUBLE AS d, len(e) / sqrt(count(*) OVER (PARTITION BY label)) AS r0, id = max(id) OVER (PARTITION BY label) AS last FROM p, r),
g AS (SELECT label, sum(CASE WHEN last THEN 0 ELSE (d - 1) / d * (1 - list_sum(list_transform(u, lambda k: least(k, abs(1 - k), r0))) / (d * r0)) END) AS edges FROM u GROUP BY 1),
q AS (SELECT a.label, {_DIST("a.u", "b.u")} AS dist, a.r0 FROM u a JOIN u b ON a.label = b.label AND a.id < b.id),
o AS (SELECT label, sum(CASE WHEN dist = 0 THEN 100 WHEN dist <= 2 * r0 THEN least(100, 2 * r0 / dist - 1) ELSE 0 END) AS shared FROM q GROUP BY 1)
SELECT g.label, round(edges + shared, 9) + 0.0 AS diversity FROM g JOIN o ON o.label = g.label""",
)(_diverse(vectors, "hypersphere_overlap"))
query("diversity_logdet")(_diverse(vectors, "logdet"))
