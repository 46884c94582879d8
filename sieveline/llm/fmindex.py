"""A compressed FM-index over sequences of words: backward search on a wavelet matrix.

All searches of a batch go forward together, one array operation for a step of all of them.
"""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth symbols at least, by prefix doubling."""
    n = len(seq)
    rank = seq.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    span = 1
    while span < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * np.int64(max(n, int(rank.max(initial=0))) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        span *= 2
        if rank.max(initial=0) == n - 1:
            break
    return order


class Bits:
    """A bit vector with counts of the ones before any place, compressed.

    Words of 64 equal bits, of which the transform of repetitive text is full, are not stored.
    Eight words share a count of the ones and of the stored words before them; each adds its own
    ones, in two bytes.
    """

    def __init__(self, bit: np.ndarray) -> None:
        pad = np.zeros(512 + (-len(bit)) % 512, dtype=bool)
        words = np.packbits(np.concatenate([bit.astype(bool), pad]), bitorder="little").view("<u8").astype(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
        mixed = (ones > 0) & (ones < 64)
        self.words = words[mixed.ravel()]
        self.mixed = np.packbits(mixed, axis=1, bitorder="little")[:, 0]
        before = np.cumsum(ones, axis=1)
        self.inside = np.concatenate([np.zeros((len(ones), 1), dtype=np.int64), before], axis=1).astype(np.uint16)
        kind = np.int32 if len(bit) < 1 << 31 else np.int64
        self.ones = np.concatenate([[0], np.cumsum(before[:, -1])])[:-1].astype(kind)
        self.stored = np.concatenate([[0], np.cumsum(mixed.sum(axis=1))])[:-1].astype(kind)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.words, self.mixed, self.inside, self.ones, self.stored))

    def before(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word = at >> 9, (at >> 6) & 7
        first = self.inside[block, word].astype(np.int64)
        own = self.inside[block, word + 1] - first
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        some = self.mixed[block]
        place = self.stored[block] + np.bitwise_count(some & ((1 << word) - 1).astype(np.uint8))
        held = self.words[np.minimum(place, max(len(self.words) - 1, 0))] if len(self.words) else np.zeros(len(at), dtype=np.uint64)
        part = np.where((some >> word.astype(np.uint8)) & 1, np.bitwise_count(held & mask), np.where(own == 64, at & 63, 0))
        return self.ones[block] + first + part


class FMIndex:
    """Counts occurrences of patterns of up to depth words in a collection of sequences.

    words: the sequences' word hashes, one after the other; lengths: their lengths.  Each
    sequence is followed by a separator, which no pattern has.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.alphabet, ids = np.unique(words, return_inverse=True)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        seq = np.zeros(len(words) + len(lengths), dtype=np.int64)
        seq[np.arange(len(words)) + owner] = ids + 1
        order = suffix_order(seq, depth)
        last = seq[order - 1]
        self.size = len(seq)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=len(self.alphabet) + 1))])
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.starts = self._level_starts()

    def _level_starts(self) -> np.ndarray:
        """Where each symbol's run begins below the last level."""
        pos = np.zeros(len(self.alphabet) + 1, dtype=np.int64)
        return self._descend(np.arange(len(self.alphabet) + 1), pos)

    def _descend(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            ones = self.bits[k].before(pos)
            pos = np.where(one == 1, self.zeros[k] + ones, pos - ones)
        return pos

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of symbol + pattern, from the ranges of pattern."""
        base = self.begin[symbol] - self.starts[symbol]
        return base + self._descend(symbol, lo), base + self._descend(symbol, hi)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words that the index has."""
        return np.searchsorted(self.alphabet, words) + 1

    def repeated_windows(self, words: np.ndarray, first: np.ndarray, length: int) -> list[np.ndarray]:
        """For each indexed sequence words[first[i]:first[i + 1]], the starts of its windows of
        length words that the index has at least twice.

        Matching statistics from the right: a match is extended to the left until fewer than two
        occurrences are left; all windows inside it are repeated.  The place f that ended it is in
        every window left that begins there or before and is long enough; a short probe from it tells
        whether those that reach the probe's end can be repeated.
        """
        n = len(first) - 1
        symbol = self.symbols(words)
        size = np.diff(first)
        marks = np.zeros(len(words) + 1, dtype=np.int64)
        lane = np.flatnonzero(size >= length)
        end = size[lane] - 1
        at = end.copy()
        probe = np.zeros(len(lane), dtype=bool)
        stop = np.zeros(len(lane), dtype=np.int64)
        reach = stop.copy()
        lo, hi = np.zeros(len(lane), dtype=np.int64), np.full(len(lane), self.size, dtype=np.int64)
        deep = np.zeros(len(lane), dtype=np.int64)
        while len(lane):
            nlo, nhi = self.step(symbol[first[lane] + at], lo, hi)
            fail = (nhi - nlo < 2) | (deep >= self.depth)
            over = np.zeros(len(lane), dtype=bool)
            lo, hi, deep = nlo, nhi, deep + 1
            # a match ends at `at` (which is not in it), or reaches the sequence's start
            ended = ~probe & fail
            whole = ~probe & ~fail & (at == 0)
            left = np.where(whole, 0, at + 1)
            done = (ended | whole) & (end - left + 1 >= length)
            np.add.at(marks, first[lane[done]] + left[done], 1)
            np.add.at(marks, first[lane[done]] + end[done] - length + 2, -1)
            over |= whole
            lost = probe & fail  # windows left and reaching the probe's end are not repeated
            again = probe & ~fail & (at == stop)
            cut = ended & (deep > self.depth)  # ended by the depth alone
            # next: a probe from a little right of the place that ended the match
            go = ended & ~cut
            stop = np.where(go, at, stop)
            span = np.minimum(at + 7, end)
            new_end = np.where(again | cut, np.minimum(end - 1, np.where(again, stop, at) + length - 1), np.where(lost, reach - 1, end))
            retry = again | cut | lost
            over |= retry & (new_end < length - 1)
            reset = go | retry
            reach = np.where(go, span, reach)
            at = np.where(go, span, np.where(retry, new_end, at - 1))
            end = new_end
            probe = np.where(reset, go, probe)
            lo, hi, deep = np.where(reset, 0, lo), np.where(reset, self.size, hi), np.where(reset, 0, deep)
            live = ~over
            lane, end, at, probe, stop, reach, lo, hi, deep = (v[live] for v in (lane, end, at, probe, stop, reach, lo, hi, deep))
        flags = np.cumsum(marks[:-1]) > 0
        return [np.flatnonzero(flags[first[i] : first[i + 1]]) for i in range(n)]
