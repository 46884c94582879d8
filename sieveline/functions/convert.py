"""Similarities to distances, over pair frames (keep..., i, j, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.similarity import diagonals
from sieveline.sources.frames import check_pairs

#: Metrics of each value alone: the distance, and the values for which it is defined.
SIMPLE = {
    "reciprocal": (lambda x: 1 / x, lambda x: x > 0),
    "correlation": (lambda x: F.sqrt(1 - x), lambda x: (x >= -1) & (x <= 1)),
    "transition": (lambda x: 1 / F.sqrt(x), lambda x: x > 0),
    "probability": (lambda x: 1 / F.sqrt(F.asin(x)), lambda x: (x > 0) & (x <= 1)),
    "membership": (lambda x: 1 - x, lambda x: (x >= 0) & (x <= 1)),
    "confusion": (lambda x: 1 - x, lambda x: (x >= 0) & (x <= 1)),
}
#: Metrics that look at all values; those of MATRIX need pairs.
MATRIX = ("co_occurrence", "gravity", "covariance")
WHOLE = ("reverse", "exponential", "gaussian", *MATRIX)
METRICS = (*SIMPLE, *WHOLE)
#: Metrics of each value alone that are infinite at 0.
POLES = ("reciprocal", "transition", "probability")


def _inside(test, value, metric: str):
    """value where test holds; an error elsewhere."""
    return F.when(test, value).otherwise(F.raise_error(F.lit(f"a value is outside the domain of {metric}")).cast("double"))


def _limit(x, value, metric: str):
    """value where x is above 0, and where x is 0 the limit: infinitely far, for co_occurrence 1; an error elsewhere."""
    return F.when(x == 0, F.lit(1.0 if metric == "co_occurrence" else float("inf"))).otherwise(_inside(x > 0, value, metric))


def to_distance(values: DataFrame, metric: str, *keep: str, scale: float = 1.0, check: bool = False, zeros: bool = False) -> DataFrame:
    """The frame with distances for similarities in value: a pair frame (keep..., i, j, value), or single values with any other columns.

    A value outside the metric's domain raises when it is reached; with check, so do pairs that
    are not square and symmetric.  With zeros, a value of 0 is no error where the metric has a
    limit there, which is the distance then.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    paired = {"i", "j"} <= set(values.columns)
    if metric in MATRIX and not paired:
        raise ValueError(f"{metric} needs pairs (i, j, value)")
    if check and paired:
        check_pairs(values, by=keep[0] if keep else None)
    values = values.withColumns({c: F.col(c) * scale for c in ("value", "_di", "_dj") if c in values.columns})
    x = F.col("value")
    if metric in SIMPLE:
        f, domain = SIMPLE[metric]
        value = _inside(domain(x), f(x), metric)
        return values.withColumn("value", _limit(x, value, metric) if zeros and metric in POLES else value)
    names = values.columns
    if metric == "covariance":
        joined = diagonals(values, *keep)
        gap = F.col("_di") + F.col("_dj") - 2 * x
        return joined.withColumn("value", _inside((F.col("_di") >= 0) & (F.col("_dj") >= 0) & (gap >= 0), F.sqrt(gap), metric)).select(*[c for c in names if c not in ("_di", "_dj")])
    if metric in ("co_occurrence", "gravity"):
        rows = values.groupBy(*keep, F.col("i").alias("k")).agg(F.sum("value").alias("r"))
        cols = values.groupBy(*keep, F.col("j").alias("k")).agg(F.sum("value").alias("c"))
        both = rows.join(cols, [*keep, "k"]).groupBy(*keep).agg(F.sum(F.col("r") * F.col("c")).alias("_b"), F.sum("r").alias("_s"))
        joined = values.join(F.broadcast(both), list(keep)) if keep else values.crossJoin(F.broadcast(both))  # a row a group
        value = 1 / (1 + x * F.col("_s") / F.col("_b")) if metric == "co_occurrence" else F.sqrt(F.col("_b") / (x * F.col("_s")))
        return joined.withColumn("value", _limit(x, value, metric) if zeros else _inside(x > 0, value, metric)).select(*names)
    ends = values.groupBy(*keep).agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    joined = values.join(F.broadcast(ends), list(keep)) if keep else values.crossJoin(F.broadcast(ends))  # a row a group
    if metric == "reverse":
        return joined.withColumn("value", F.col("_hi") + F.col("_lo") - x).select(*names)
    log = -F.log(F.try_divide(x, F.col("_hi")))
    value = log if metric == "exponential" else F.sqrt(log)
    share = F.try_divide(x, F.col("_hi"))
    return joined.withColumn("value", _limit(share, value, metric) if zeros else _inside(share > 0, value, metric)).select(*names)
