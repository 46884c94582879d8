"""Array kernels over Arrow text columns, shared by the operators.

A text column arrives as one byte buffer with offsets, so that whole batches are
tokenised and hashed by a handful of array operations, without a Python object per
word.  Texts are taken in blocks of about ``BLOCK`` bytes (one text at least), which
keeps the working set of a task independent of the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20


def without(frame, *names: str):
    """frame without columns of these names, in any case: results take the place of clashing columns."""
    gone = {n.lower() for n in names}
    return frame.select(*[frame[f"`{c}`"] for c in frame.columns if c.lower() not in gone])


def unused(frame, name: str) -> str:
    """A column name made of name that frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_MULT = np.uint64(0x9E3779B97F4A7C15)
#: True for the bytes of [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, BLOCK + 1)
        inv = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("_powers", _MULT), ("_inverse", inv)):
            arr = np.full(n, base, dtype=np.uint64)
            arr[0] = 1
            globals()[name] = np.multiply.accumulate(arr)
    return _powers, _inverse


def blocks(column, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; a null text counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text its first word's place (one more at the end)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, read off prefix sums."""
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, and each text's first one; a text of fewer words is one shingle, none without words."""
    counts = np.diff(firsts)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += mix(hashes[j:] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(firsts), dtype=np.int64)
    np.cumsum(per, out=out_first[1:])
    take = np.arange(out_first[-1]) + np.repeat(firsts[:-1] - out_first[:-1], per)
    out = mix(rolled[take]) if len(take) else np.zeros(0, dtype=np.uint64)
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        short = hashes[firsts[t] : firsts[t + 1]]
        acc = np.uint64(len(short))
        for h in short:
            acc = mix(np.array([h], dtype=np.uint64) + np.uint64((int(acc) * int(_MULT)) % (1 << 64)))[0]
        out[out_first[t]] = acc
    return out, out_first


def distinct_sets(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct values, and where each text's begin."""
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(firsts)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        begin = 0
        for at in np.flatnonzero(change):
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
