"""How many rows each group may give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def census(frame: DataFrame, by: str) -> DataFrame:
    return frame.groupBy(by).agg(F.count("*").alias("n"))


def _known(label) -> tuple:
    """Labels in order, the null one first."""
    return (label is not None, label)


def proportional(counts: dict, size: int) -> dict:
    """Shares of size by group size, rounded half to even, one at least; what is too much is taken from the
    largest share, what is missing is given to the smallest that has rows left, the first label first."""
    total = sum(counts.values())
    if size > total:
        raise ValueError(f"{size} rows asked of {total}")
    labels = sorted(counts, key=_known)
    quota = {g: max(1, round(size * counts[g] / total)) for g in labels}
    while sum(quota.values()) > size:
        top = max(labels, key=lambda g: (quota[g], -labels.index(g)))
        quota[top] -= 1
    while sum(quota.values()) < size:
        free = [g for g in labels if quota[g] < counts[g]]
        quota[min(free, key=lambda g: (quota[g], labels.index(g)))] += 1
    return {g: min(q, counts[g]) for g, q in quota.items()}


def equal(counts: dict, size: int) -> dict:
    """The same share for all; groups with no more rows than their share give all, and the rest is shared anew.  A remainder is dropped."""
    if size > sum(counts.values()):
        raise ValueError(f"{size} rows asked of {sum(counts.values())}")
    open_, quota, left = sorted(counts, key=_known), {}, size
    while open_:
        share = left // len(open_)
        small = [g for g in open_ if counts[g] <= share]
        if not small:
            return {**quota, **{g: share for g in open_}}
        for g in small:
            quota[g] = counts[g]
            left -= counts[g]
            open_.remove(g)
    return quota


def allocate(frame: DataFrame, by: str, size: int, how: str = "proportional") -> dict:
    """Quotas by label; only the census, one row a label, comes to the driver."""
    counts = {r[0]: r[1] for r in census(frame, by).collect()}
    if how not in ("proportional", "equal"):
        raise ValueError("allocation is proportional or equal")
    return (proportional if how == "proportional" else equal)(counts, size)
