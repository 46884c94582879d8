"""Pairwise and n-ary similarity as Column expressions."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vectors import _fold, dot, ratio


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over joint weight; null for two zero vectors."""
    both = dot(a, b)
    return ratio(both, dot(a, a) + dot(b, b) - both)


def modified_tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto of ones and of zeros, weighted by how common ones are."""
    return modified_of(dot(a, b), _fold(F.zip_with(a, b, lambda x, y: (1 - x) * (1 - y))), F.size(a).cast("double"))


def modified_of(ones: Column, zeros: Column, size: Column) -> Column:
    """Modified Tanimoto from counts of coincidences of ones and of zeros among size features."""
    t1 = F.when(zeros == size, 1.0).otherwise(ratio(ones, size - zeros))
    t0 = F.when(ones == size, 1.0).otherwise(ratio(zeros, size - ones))
    share = (size - zeros + ones) / (2 * size)
    return (2 - share) / 3 * t1 + (1 + share) / 3 * t0


def index_of(key: str, a: Column, d: Column, x: Column, wa: Column | None = None, wd: Column | None = None, wx: Column | None = None) -> Column:
    """A similarity index from counts of coincidences of ones (a), of zeros (d) and of differences (x); weighted counts stand in numerators."""
    wa, wd, wx = (wa if wa is not None else a), (wd if wd is not None else d), (wx if wx is not None else x)
    p, s, sw = a + d + x, a + d, wa + wd
    wp = sw + wx
    table = {
        "AC": lambda: F.lit(2 / math.pi) * F.asin(F.sqrt(ratio(sw, p))),
        "BUB": lambda: ratio(F.sqrt(wa * wd) + wa, F.sqrt(a * d) + a + x),
        "CT1": lambda: ratio(F.log(1 + wa + wd), F.log(1 + p)),
        "CT2": lambda: ratio(F.log(1 + wp) - F.log(1 + wx), F.log(1 + p)),
        "CT3": lambda: ratio(F.log(1 + wa), F.log(1 + p)),
        "CT4": lambda: ratio(F.log(1 + wa), F.log(1 + a + x)),
        "Fai": lambda: ratio(wa + wd / 2, p),
        "Gle": lambda: ratio(2 * wa, 2 * a + x),
        "Ja": lambda: ratio(3 * wa, 3 * a + x),
        "Ja0": lambda: ratio(3 * sw, 3 * s + x),
        "JT": lambda: ratio(wa, a + x),
        "RT": lambda: ratio(sw, p + x),
        "RR": lambda: ratio(wa, p),
        "SM": lambda: ratio(sw, p),
        "SS1": lambda: ratio(wa, a + 2 * x),
        "SS2": lambda: ratio(2 * sw, p + s),
    }
    if key not in table:
        raise ValueError(f"unknown similarity index {key!r}; one of {', '.join(table)}")
    return table[key]()


#: The names of the indices.
INDEX_KEYS = ("AC", "BUB", "CT1", "CT2", "CT3", "CT4", "Fai", "Gle", "Ja", "Ja0", "JT", "RT", "RR", "SM", "SS1", "SS2")
PAIR_KEYS = tuple(k for k in INDEX_KEYS if k not in ("CT3", "CT4", "Ja0"))


def pair_index(key: str, a: Column, b: Column) -> Column:
    """A binary index of two fingerprints."""
    if key not in PAIR_KEYS:
        raise ValueError(f"{key!r} is no pairwise index; one of {', '.join(PAIR_KEYS)}")
    ones = dot(a, b)
    zeros = _fold(F.zip_with(a, b, lambda x, y: (1 - x) * (1 - y)))
    return index_of(key, ones, zeros, F.size(a) - ones - zeros)


def column_sums(frame: DataFrame, *by: str, vec: str = "features") -> DataFrame:
    """(by..., n, sums): the sufficient statistic of each set for n-ary indices; partial sums before the shuffle."""
    cells = frame.select(*by, F.posexplode(vec).alias("_pos", "_x")).groupBy(*by, "_pos").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda e: e["_s"])
    return cells.groupBy(*by).agg(F.max("_n").alias("n"), ordered.alias("sums"))


def isim(key: str, sums: Column, n: Column, order: int = 1) -> Column:
    """The index of a set from its column sums; order roots each column's share."""
    root = (lambda e: e) if order == 1 else (lambda e: F.pow(e, F.lit(1.0 / order)))
    a = _fold(F.transform(sums, lambda c: root(c * (c - 1) / 2)))
    d = _fold(F.transform(sums, lambda c: root((n - c) * (n - c - 1) / 2)))
    x = _fold(F.transform(sums, lambda c: root((n - c) * c)))
    return index_of(key, a, d, x)


def esim(key: str, sums: Column, n: Column, threshold: str | int | None = None, weight: str = "fraction", order: int = 1) -> Column:
    """The extended index: columns count as agreeing on ones, on zeros, or not, by a coincidence threshold."""
    if threshold is None:
        bar = n % 2
    elif threshold == "dissimilar":
        bar = F.ceil(n / 2)
    elif isinstance(threshold, int):
        bar = F.when(n > threshold, F.lit(threshold)).otherwise(F.raise_error(F.lit("an integer threshold must be below the number of objects")).cast("int"))
    else:
        raise ValueError("threshold is None, 'dissimilar' or an integer below the number of objects")
    root = (lambda e: e) if order == 1 else (lambda e: F.pow(e, F.lit(1.0 / order)))
    if weight == "fraction":
        alike, unlike = (lambda g: g / n), (lambda g: 1 - (g - n % 2) / n)
    elif weight.startswith("power_"):
        base = float(weight.removeprefix("power_"))
        alike, unlike = (lambda g: F.pow(F.lit(base), -(n - g))), (lambda g: F.pow(F.lit(base), -(g - n % 2)))
    elif weight == "none":
        alike = unlike = None
    else:
        raise ValueError("weight is fraction, power_<base> or none")
    on, off = (lambda c: 2 * c - n > bar), (lambda c: n - 2 * c > bar)
    mid = lambda c: ~on(c) & ~off(c)
    count = lambda test: F.size(F.filter(sums, test)).cast("double")
    total = lambda test, f: F.lit(1.0) if f is None else _fold(F.transform(F.filter(sums, test), lambda c: root(f(F.abs(2 * c - n)))))
    return index_of(key, count(on), count(off), count(mid), total(on, alike), total(off, alike), total(mid, unlike))


def pair_frame(frame: DataFrame, value, *, by: str | None = None, id: str = "id", vec: str = "features") -> DataFrame:
    """(by, i, j, value(features_i, features_j)) of all pairs within each group: a result of n squared rows by definition."""
    keep = [by] if by else []
    left = frame.select(*keep, F.col(id).alias("i"), F.col(vec).alias("_a"))
    right = frame.select(*keep, F.col(id).alias("j"), F.col(vec).alias("_b"))
    joined = left.join(right, by) if by else left.crossJoin(right)
    return joined.select(*keep, "i", "j", value(F.col("_a"), F.col("_b")).alias("value"))


#: Rows of a block of a group: a cell of pairs has two blocks. Partitions of pairs at most. Features of vectors whose values are looked up, at most.
PAIR_BLOCK, PAIR_PARTS, PAIR_TABLE = 1024, 4096, 128


def value_table(spark, value, size: int) -> Column:
    """The values of all counts among size features as a constant array: that of ones and of either is at either * (size + 1) + ones."""
    ones, either = (F.col("id") % (size + 1)).cast("double"), F.floor(F.col("id") / (size + 1)).cast("double")
    cells = spark.range(0, (size + 1) ** 2, 1, 1).select(F.when(ones <= either, value(ones, size - either, either - ones)).cast("double"))
    return F.from_json(F.lit(json.dumps([r[0] for r in cells.collect()])), "array<double>")


def fingerprint_pairs(frame: DataFrame, value, *, by: str | None = None, id: str = "id", vec: str = "features", diagonal: bool = False, block: int = PAIR_BLOCK, table: bool = True) -> DataFrame:
    """(by, i, j, value(a, d, x)) of all pairs of fingerprints (vectors of 0 and 1) within each group, from counts of coincidences of ones, of zeros and of differences.

    Vectors are packed, 64 features to a word, so a pair takes a few operations on integers.  A
    group is dealt to blocks, and every block meets every block: a task holds two blocks at a time,
    and many tasks share a large group.  With table, if all vectors have one length of up to PAIR_TABLE, values
    are computed once for each outcome of the counts and looked up.  The value of vectors of unequal
    length, or null ones, is null.  With diagonal, each pair also has the values of its rows with
    themselves, _di and _dj, and values are computed pair by pair.
    """
    label = F.col(by) if by else F.lit(0)
    rows = frame.select(label.alias("_g"), F.col(id).alias("_id"), F.col(vec).alias("_v")).where("_g is not null")
    blocks = rows.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"), F.max(F.size("_v")).alias("_size"), F.min(F.size("_v")).alias("_least"))
    cells, size, least = blocks.agg(F.sum(F.col("_n").cast("long") * F.col("_n")), F.max("_size"), F.min("_least")).first()
    looked_up = table and not diagonal and size is not None and size == least and 0 <= size <= PAIR_TABLE
    words = range(max(1, -(-(size or 0) // 64)))
    # past the end of a shorter vector there are no bits, in place of nulls
    word = lambda k: F.aggregate(F.slice("_v", 64 * k + 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long")))
    dealt = rows.join(blocks.select("_g", "_n"), "_g").withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    packed = lambda end, own, other: dealt.select(F.col("_g"), F.col("_own").alias(own), every.alias(other), F.col("_id").alias(end), F.when(F.col("_v").isNotNull(), F.size("_v")).alias(f"_p{end}"), *[word(k).alias(f"_{end}{k}") for k in words])
    parts, cell = max(1, min(cells or 1, PAIR_PARTS)), ["_g", "_a", "_b"]
    left, right = packed("i", "_a", "_b").repartition(parts, *cell), packed("j", "_b", "_a").repartition(parts, *cell)
    bits = lambda f: reduce(lambda s, c: s + c, [F.bit_count(f(F.col(f"_i{k}"), F.col(f"_j{k}"))) for k in words])
    ones, any_ = bits(lambda x, y: x.bitwiseAND(y)).cast("double"), bits(lambda x, y: x.bitwiseOR(y)).cast("double")
    alike = lambda v: F.when(F.col("_pi") == F.col("_pj"), v)
    if looked_up:
        own_ones = lambda end: (reduce(lambda s, c: s + c, [F.bit_count(f"_{end}{k}") for k in words]) * F.lit(size + 1)).alias(f"_c{end}")
        left, right = left.select("*", own_ones("i")), right.select("*", own_ones("j"))
        # ones of either are those of both rows less common ones
        result = value_table(frame.sparkSession, value, size)[F.col("_ci") + F.col("_cj") - F.lit(size) * bits(lambda x, y: x.bitwiseAND(y))]
    else:
        result = alike(value(ones, F.col("_pi") - any_, any_ - ones))
    joined = left.hint("merge").join(right, cell)
    pairs = joined.select(F.col("_g"), "i", "j", "_pi", "_pj", *[f"_{end}{k}" for end in "ij" for k in words], result.alias("value"))
    own = []
    if diagonal:
        for end in "ij":
            count = reduce(lambda s, c: s + c, [F.bit_count(f"_{end}{k}") for k in words]).cast("double")
            own.append(value(count, F.col(f"_p{end}") - count, F.lit(0.0)).alias(f"_d{end}"))
    return pairs.select(*([F.col("_g").alias(by)] if by else []), "i", "j", "value", *own)


def diagonals(pairs: DataFrame, *keep: str) -> DataFrame:
    """Pairs with the values of their rows with themselves, _di and _dj: those that are there, or looked up."""
    if {"_di", "_dj"} <= set(pairs.columns):
        return pairs
    diag = pairs.where("i = j").select(*keep, F.col("i").alias("k"), F.col("value").alias("v"))
    d1, d2 = diag.withColumnsRenamed({"k": "i", "v": "_di"}), diag.withColumnsRenamed({"k": "j", "v": "_dj"})
    # a row of the matrix is as nothing beside the matrix
    return pairs.join(F.broadcast(d1), [*keep, "i"]).join(F.broadcast(d2), [*keep, "j"])


def scaled(pairs: DataFrame, *keep: str) -> DataFrame:
    """Pairs divided by the geometric mean of the two diagonal values; values must not be below 0, nor diagonal ones 0."""
    fine = (F.col("value") >= 0) & (F.col("_di") > 0) & (F.col("_dj") > 0)
    value = F.when(fine, F.col("value") / F.sqrt(F.col("_di") * F.col("_dj"))).otherwise(F.raise_error(F.lit("values must not be below 0, nor diagonal ones 0")).cast("double"))
    return diagonals(pairs, *keep).select(*keep, "i", "j", value.alias("value"))
