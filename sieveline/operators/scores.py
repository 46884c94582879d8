"""Diversity of one small set, in numpy: what scores the cells of a grid."""

from __future__ import annotations

import math

import numpy as np


def _binary(x: np.ndarray) -> np.ndarray:
    if not np.isin(x, (0, 1)).all():
        raise ValueError("the features must be 0 or 1")
    return x


def overlap(library: np.ndarray, subset: np.ndarray) -> float:
    """Hypersphere overlap of a subset, in the library's ranges; 0 where no column varies."""
    lo, hi = library.min(0), library.max(0)
    keep = hi - lo > 1e-30
    u = (subset[:, keep] - lo[keep]) / (hi - lo)[keep]
    k, d = u.shape
    if not d:
        return 0.0
    r0 = d / math.sqrt(k)
    apart = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))[np.triu_indices(k, 1)]
    with np.errstate(divide="ignore"):
        shared = np.where(apart == 0, 100.0, np.minimum(100.0, 2 * r0 / apart - 1))
    edges = (d - 1) / d * (1 - np.minimum(np.minimum(u, np.abs(1 - u)), r0).sum(1) / (d * r0))
    # the last row has no penalty
    return float(shared[apart <= 2 * r0].sum() + edges[:-1].sum())


def logdet(x: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(x @ x.T + np.eye(len(x)))
    return float(sign * value)


def entropy(x: np.ndarray) -> float:
    p = _binary(x).mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    return float(np.nansum(np.where((p > 0) & (p < 1), h, 0.0)))


def gini(x: np.ndarray) -> float:
    ones = np.sort(_binary(x).sum(0))
    n = len(ones)
    return float(2 * (np.arange(1, n + 1) * ones).sum() / (n * ones.sum()) - (n + 1) / n) if ones.sum() else math.nan


def wdud(x: np.ndarray) -> float:
    """Mean over varying columns of the area between the distribution function and the diagonal."""
    areas = []
    for v in x.T:
        if v.max() > v.min():
            y, count = np.unique(np.round((v - v.min()) / (v.max() - v.min()), 6), return_counts=True)
            f = np.cumsum(count)[:-1] / len(v)
            areas.append(sum(np.trapezoid(np.abs(t - c), t) for t, c in ((np.linspace(a, b, 1000), c) for a, b, c in zip(y[:-1], y[1:], f, strict=True))))
    return float(np.mean(areas)) if areas else math.nan


def edi(x: np.ndarray, cs: float | None) -> float:
    """The explicit diversity index of at least two rows."""
    if not cs:
        raise ValueError("cs, the number of centres, must be given and not 0")
    if len(x) < 2:
        return math.nan
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(apart, np.inf)
    near = x[apart.argmin(1)]
    both = (x * near).sum(1)
    with np.errstate(invalid="ignore"):
        nat = (both / ((x * x).sum(1) + (near * near).sum(1) - both)).mean()
    if math.isnan(nat):
        return nat
    value = ((1 - nat) / (0.8047 - 0.065 * math.log(len(x))) - math.log10(len(x) / cs**2)) * 0.7071067811865476
    return float((math.tanh(value / 3) + 1) / 2 * 100)


def score(measure: str, x: np.ndarray, *, library: np.ndarray, cs: float | None = None) -> float:
    """The diversity of x by a measure's name; what is not defined counts as least."""
    known = {"hypersphere_overlap": lambda: overlap(library, x), "logdet": lambda: logdet(x), "shannon_entropy": lambda: entropy(x), "gini_coefficient": lambda: gini(x), "wdud": lambda: wdud(x), "explicit_diversity_index": lambda: edi(x, cs)}
    if measure not in known:
        raise ValueError(f"unknown measure {measure!r}; one of {', '.join(known)}")
    value = known[measure]()
    return -math.inf if math.isnan(value) else value
