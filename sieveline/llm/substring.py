"""Substring deduplication: words in windows that the corpus repeats, by compressed FM-indexes.

A window of ``length`` words belongs to the shard of its minimiser, the least hash among its
k-word grams, so equal windows meet in one shard whatever surrounds them.  Consecutive windows
of a text with one minimiser occurrence form a segment; only (minimiser, segment hash, text,
place) is shuffled, and of equal segments at most two from a task.  A minimiser that occurs once
has no repeated window; segments that are equal as wholes are one entry, all of whose windows are
repeated.  The different segments of a minimiser have their words fetched; each shard's are put
into a compressed FM-index, and backward search streams them through it, which gives the windows
that occur again.

A minimiser of very many segments, such as the edges of a passage that a third of the corpus has,
would make one shard of them all.  HEAVY in a task, or more than HOT in all, take its windows
apart: each is known by its own hash, so that no shard holds more than HOT segments of a
minimiser, and no task many rows of one.

Texts are known by a 64-bit hash; equal texts share their segments' rows within a task.

Defined results: null texts have no words; texts shorter than a window lose none.  Repeated
rows and ids, null ids too, are rows of their own.  Any length of 1 or more will do; grams are
as long as the window if that is shorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.fmindex import FMIndex
from sieveline.llm.scratch import written
from sieveline.llm.textkit import blocks, mix, runs, signed, word_hashes, word_spans, _tables

GRAM = 8
SHARD_WORDS = 600_000
#: Segments of one minimiser in a task, and in all, from which on its windows are judged one by one.
HEAVY, HOT = 64, 8192
#: Numbers that are broadcast at most.
SMALL = 100_000
#: Words whose segments are cut at a time.
STRETCH = 1 << 22
#: Places of the table by which a task knows equal segments, a power of two.
REMEMBERED = 1 << 19
#: Rows: a segment to be judged; windows known to be repeated; a text seen before; a heavy minimiser.
SEGMENT, CUT, TWIN, WEIGHT = range(4)
#: Verdicts: one of a kind among others of its minimiser; one of several equal ones, likewise; windows to be judged one by one.
ALONE, EQUAL, APART = 4, 5, 6
ROWS = "kind int, m long, seg long, h long, start long, n long"
NAMES = ["kind", "m", "seg", "h", "start", "n"]


def segments(hashes: np.ndarray, firsts: np.ndarray, length: int, gram: int):
    """(text, first window, number of windows, minimiser, segment hash) of all segments."""
    parts = []
    n = len(hashes)
    for base in range(0, n, STRETCH):
        if n - base < length:
            break
        # windows that begin in this stretch; what a stretch cuts in two is compared as different segments
        parts.append(_stretch(hashes[base : base + STRETCH + length - 1], firsts, base, length, min(gram, length)))
    none = np.zeros(0, dtype=np.int64)
    if not parts:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _stretch(hashes: np.ndarray, firsts: np.ndarray, base: int, length: int, gram: int):
    n = len(hashes)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    pos = (best & low).astype(np.int64)
    owner = np.searchsorted(firsts, np.arange(len(pos)) + base, side="right") - 1
    at = np.flatnonzero(np.arange(len(pos)) + base + length <= firsts[owner + 1])
    new = np.ones(len(at), dtype=bool)
    new[1:] = (pos[at[1:]] != pos[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    heads = np.flatnonzero(new)
    start = at[heads]
    count = np.diff(np.append(heads, len(at)))
    stop = start + count + length - 1
    content = (sums[stop] - sums[start]) * inverse[start]
    place = pos[start] - start
    whole = mix(content + mix(mix(count.astype(np.uint64)) + place.astype(np.uint64)))
    text = owner[start]
    return text, start + base - firsts[text], count, grams[pos[start]], whole


def _rows(kind: int, h, m=None, seg=None, start=None, n=None) -> pa.RecordBatch:
    size = len(h)
    long = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(signed(x) if x.dtype == np.uint64 else x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), *map(long, (m, seg, h, start, n))], names=NAMES)


class Once:
    """Lets the first two of equal values through, of those that it remembers: a table of fixed size, where a newer value takes an older one's place."""

    def __init__(self, least: int = 2) -> None:
        self.least = least
        self.value = np.zeros(REMEMBERED, dtype=np.uint64)
        self.count = np.zeros(REMEMBERED, dtype=np.uint8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        values, first, size = np.unique(x[order], return_index=True, return_counts=True)
        slot = (values & np.uint64(REMEMBERED - 1)).astype(np.int64)
        before = np.where(self.value[slot] == values, self.count[slot], 0).astype(np.int64)
        self.value[slot], self.count[slot] = values, np.minimum(before + size, self.least)
        number = np.arange(len(x)) - np.repeat(first, size) + np.repeat(before, size)
        out = np.zeros(len(x), dtype=bool)
        out[order] = number < self.least
        return out


def cut_up(length: int, gram: int):
    """From batches of (h, text), rows of kinds SEGMENT, CUT, TWIN and WEIGHT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, once, told = Once(1), Once(), Once(1)
        weight = np.zeros(2 * REMEMBERED, dtype=np.int32)
        for batch in batches:
            key = np.asarray(batch.column(0))
            for i, j, data, offs in blocks(batch.column(1)):
                new = fresh(key[i:j].view(np.uint64))
                if not new.all():
                    yield _rows(TWIN, key[i:j][~new])
                starts, ends, firsts = word_spans(data, offs)
                text, start, count, m, seg = segments(word_hashes(data, starts, ends), firsts, length, gram)
                use = new[text]
                h, start, count, m, seg = key[i:j][text[use]], start[use], count[use], m[use], seg[use]
                send = once(seg)
                if not send.all():
                    yield _rows(CUT, h[~send], m[~send], seg[~send], start[~send], count[~send])
                m = m[send]
                yield _rows(SEGMENT, h[send], m, seg[send], start[send], count[send])
                slot = (m & np.uint64(len(weight) - 1)).astype(np.int64)
                weight += np.bincount(slot, minlength=len(weight)).astype(np.int32)
                # minimisers that share a slot may be heavy sooner, which is right as well
                heavy = np.unique(m[weight[slot] >= HEAVY])
                heavy = heavy[told(heavy)]
                if len(heavy):
                    yield _rows(WEIGHT, np.zeros(len(heavy), dtype=np.int64), heavy)

    return run


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by (m, seg), verdicts CUT on those with equals; ALONE, EQUAL and APART on what needs its words."""
    held = np.zeros((0, 5), dtype=np.int64)
    hot = None  # the minimiser whose segments are sent on as they come

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return _rows(kind, rows[:, 2], rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 4])

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Verdicts on all rows of some minimisers."""
        if not len(rows):
            return
        new_m = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        new = new_m | np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(rows)))
        of = np.cumsum(new_m)[heads] - 1  # each head's minimiser
        total = np.bincount(of, size).astype(np.int64)[of]
        apart = np.repeat(total > HOT, size)
        if apart.any():
            yield out(APART, rows[apart])
        twin = np.repeat(size > 1, size) & ~apart
        if twin.any():
            yield out(CUT, rows[twin])
        several = (np.bincount(of)[of] > 1) & (total <= HOT)
        for kind, pick in ((ALONE, size == 1), (EQUAL, size > 1)):
            if (several & pick).any():
                yield out(kind, rows[heads[several & pick]])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(c)) for c in NAMES[1:]], axis=1)
        if not len(rows):
            continue
        if hot is not None:
            end = int(np.searchsorted(rows[:, 0] != hot, True))
            if end:
                yield out(APART, rows[:end])
            rows = rows[end:]
            if not len(rows):
                continue
            hot = None
        rows = np.concatenate([held, rows])
        cut = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True))
        yield from settle(rows[:cut])
        held = rows[cut:]
        if len(held) > HOT:
            yield out(APART, held)
            hot, held = held[0, 0], held[:0]
    yield from settle(held)


def fetch(length: int):
    """From (text, list of segments), the words' hashes of each; of kind APART, the hash of each window, and CUT for what the task has twice."""
    names = [*NAMES, "words"]

    def out(rows: pa.RecordBatch, words=None) -> pa.RecordBatch:
        words = pa.nulls(rows.num_rows, pa.binary()) if words is None else pa.array(words, pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns, words], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            want = batch.column("want")
            for i, j, data, offs in blocks(batch.column("text")):
                starts, ends, firsts = word_spans(data, offs)
                hashes = word_hashes(data, starts, ends)
                for r in range(j - i):
                    part = want[i + r].values
                    kind, m, seg, h, start, n = (np.asarray(part.field(c)) for c in NAMES)
                    begin = firsts[r] + start
                    some = np.flatnonzero(kind != APART)
                    if len(some):
                        words = [hashes[b : b + c].tobytes() for b, c in zip(begin[some], n[some] + length - 1, strict=True)]
                        plain = pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (kind, m, seg, h, start, n)], names=NAMES)
                        yield out(plain, words)
                    some = np.flatnonzero(kind == APART)
                    if len(some):
                        each = np.repeat(start[some], n[some]) + np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                        each = np.unique(each)
                        power, inverse = _tables(firsts[r + 1] - firsts[r] + 1)
                        text = hashes[firsts[r] : firsts[r + 1]]
                        sums = np.zeros(len(text) + 1, dtype=np.uint64)
                        np.cumsum(text * power[: len(text)], out=sums[1:])
                        value = mix((sums[each + length] - sums[each]) * inverse[each])
                        send, one = once(value), np.ones(len(each), dtype=np.int64)
                        who = np.full(len(each), h[some[0]])
                        for k, take in ((SEGMENT, send), (CUT, ~send)):
                            # what is known already need not meet its equals
                            place = value[take] if k == SEGMENT else mix(value[take] + each[take].astype(np.uint64))
                            yield out(_rows(k, who[take], place, value[take], each[take], one[take]))

    return run


def search(length: int, shard_words: int):
    """From segments sorted by m, CUT for the runs of windows of ALONE segments that their shard has twice."""

    def shard(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        raw = table.column("words").to_pylist()
        size = np.array([len(w) // 8 for w in raw])
        first = np.concatenate([[0], np.cumsum(size)])
        words = np.frombuffer(b"".join(raw), dtype=np.uint64)
        index = FMIndex(words, size, depth=2 * length)
        found = index.repeated_windows(words, first, length)
        h, start, n = [], [], []
        kinds, texts, places = (np.asarray(table.column(c)) for c in ("kind", "h", "start"))
        for r in np.flatnonzero(kinds == ALONE):
            f = found[r]
            if len(f):
                begins = f[np.concatenate([[True], np.diff(f) > 1])]
                ends = f[np.concatenate([np.diff(f) > 1, [True]])]
                h += [texts[r]] * len(begins)
                start += (places[r] + begins).tolist()
                n += (ends - begins + 1).tolist()
        cols = [np.array(c, dtype=np.int64) for c in (h, start, n)]
        return _rows(CUT, cols[0], start=cols[1], n=cols[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        total = 0
        for table in runs(batches, ["m"]):
            n = sum(len(w) for w in table.column("words").combine_chunks().to_pylist()) // 8
            if held and total + n > shard_words:
                yield shard(held)
                held, total = [], 0
            held.append(table)
            total += n
        if held:
            yield shard(held)

    return run


def decide(length: int, shard_words: int):
    """From what fetch gives, sorted by (whether it has words, m, seg), CUT for all windows that occur again."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            group = np.where(kinds == CUT, 0, np.where(kinds == SEGMENT, 1, 2))
            for g in range(3):
                at = np.flatnonzero(group == g)
                if len(at):
                    yield g, batch.take(pa.array(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, some in groupby(parts(batches), key=lambda part: part[0]):
            rest = (part.select(NAMES) if g < 2 else part for _, part in some)
            if g == 0:
                yield from rest
            elif g == 1:
                # equal windows are repeated, however many: there is no other verdict on those with others of their hash
                for ruled in judge(rest):
                    yield ruled.set_column(0, "kind", pa.array(np.full(ruled.num_rows, CUT), pa.int32()))
            else:
                yield from search(length, shard_words)(rest)

    return run


def finish(length: int, names: list[str]):
    """From (columns, text, cuts), the columns with n_words, n_removed and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept_text = [], [], [], []
            for text, all_, cuts in zip(batch.column("text").to_pylist(), batch.column("all_gone").to_pylist(), batch.column("cuts"), strict=True):
                words = text.encode().split()
                n = len(words)
                kept, lost = words, 0
                if all_ and n >= length:
                    kept, lost = [], n
                elif cuts.is_valid:
                    start, count = (np.asarray(cuts.values.field(c)) for c in ("start", "n"))
                    gone = np.bincount(start, minlength=n + 1) - np.bincount(start + count + length - 1, minlength=n + 1)
                    keep = np.cumsum(gone[:n]) <= 0
                    kept, lost = [w for w, k in zip(words, keep.tolist(), strict=True) if k], int(n - keep.sum())
                body = b" ".join(kept)
                total.append(n)
                removed.append(lost)
                digest.append(hashlib.sha256(body).hexdigest())
                kept_text.append(body.decode())
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _judged(rows: DataFrame) -> DataFrame:
    return rows.select(*NAMES).repartition("m").sortWithinPartitions("m", "seg").mapInArrow(judge, ROWS)


def remove_repeats(docs: DataFrame, *, length: int = 50, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each text without the words that windows of length words cover which also start elsewhere in docs."""
    if length < 1:
        raise ValueError("a window has one word at least")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    rows = written(keyed.select("h", "text").mapInArrow(cut_up(length, gram), ROWS), "segments")
    several = rows.where(F.col("kind") == TWIN).select("h").distinct()
    heavy = rows.where(F.col("kind") == WEIGHT).select("m").distinct()
    found, n_heavy = rows.where(F.col("kind") == SEGMENT), heavy.count()
    # a table of at most SMALL numbers is broadcast; a larger one is joined by shuffle
    few = F.broadcast(heavy) if n_heavy <= SMALL else heavy
    ruled = written(_judged(found.join(few, "m", "left_anti") if n_heavy else found), "ruled")
    apart = found.join(few, "m", "left_semi").withColumn("kind", F.lit(APART))
    cut = lambda df: df.where(F.col("kind") == CUT).select("h", "start", "n")
    cuts = cut(rows).unionAll(cut(ruled))
    unlike = ruled.where(F.col("kind") != CUT)
    unlike = unlike.unionAll(apart.select(*NAMES)) if n_heavy else unlike
    if not unlike.isEmpty():
        wanted = unlike.groupBy("h").agg(F.collect_list(F.struct(*NAMES)).alias("want"))
        # equal texts: the one of least id stands for all
        one = keyed.select("h", F.coalesce("doc_id", F.lit(-1)).alias("id")).groupBy("h").agg(F.min("id").alias("id"))
        texts = keyed.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(wanted.join(one, "h"), ["id", "h"]).select("id", "h", "text", "want")
        texts = texts.dropDuplicates(["id", "h"]).select("text", "want")
        words = texts.mapInArrow(fetch(length), ROWS + ", words binary")
        group = F.when(F.col("kind") == CUT, 0).when(F.col("kind") == SEGMENT, 1).otherwise(2)
        words = words.repartition("m").sortWithinPartitions(group, "m", "seg")
        cuts = cuts.unionAll(cut(words.mapInArrow(decide(length, shard_words), ROWS)))
    by_text = cuts.groupBy("h").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    by_text = by_text.join(several.withColumn("all_gone", F.lit(True)), "h", "full")
    whole = keyed.join(by_text, "h", "left").select("doc_id", "text", F.coalesce("all_gone", F.lit(False)).alias("all_gone"), "cuts")
    return whole.mapInArrow(finish(length, ["doc_id"]), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, length=35).select("doc_id", "n_words", "n_removed", "kept_sha256")
