"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Tiles.  Sizes fall into bands so narrow that two linked sets lie in one band or in neighbours.
For each band the hash space is cut into more parts than linked sets can differ in elements;
then some part, not empty, holds the same elements of both.  A set is put into the tile
(band, part, content of the part) of each of its non-empty parts, for its own band and for the
band below.  Sets with so many empty parts that only empty ones might agree take those tiles
too.  So each linked pair shares a tile; texts that merely share a passage hardly ever do.

Sets of equal content are one class, collapsed within a task before anything is shuffled.
Tiles with the same sets are one tile.  Within a tile XOR-ed bitmaps (one bit for the parity of
the elements hashed to it) bound each overlap from above, and of the pairs that pass a spanning
forest is kept: enough for the clusters of texts that might be linked.  A tile of more sets than
TILE_TEXTS keeps the links of a star instead, whose cluster holds all of it.  Clusters are
compared in bounded blocks: what passes wider bitmaps has its sorted arrays intersected, unless
the two are already known to be connected.  A cluster too
large for one block is dealt to several that share a few pivots; then everything outside the
cluster's largest component is compared with all of the cluster, block by block.  No link is
lost at any size, and no step holds more than a few blocks.

Defined results: null or wordless texts have an empty set and no link; texts of fewer words
than a shingle have their whole word sequence as their one shingle.  Rows of equal doc_id are
one node; a row whose doc_id is null has no component.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.components import components
from sieveline.llm.scratch import free_shuffles, written
from sieveline.llm.textkit import LOWER, blocks, distinct_sets, mix, runs, shingles, signed, without, word_hashes, word_spans

CLASS, HOME, VISITOR, EDGE, META, TILE = range(6)
#: Texts and shingles of one block of a cluster, about; and texts that all blocks of a cluster share.
BLOCK_TEXTS, BLOCK_SHINGLES, PIVOTS = 3000, 2_000_000, 16
#: Sets of a tile whose bitmaps are compared; 64-bit words of the bitmap of one set at most.
TILE_TEXTS, SIGNATURE_WORDS = 2048, 512


def sets_of(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles of each text, where each text's begin)."""
    for i, j, data, offs in blocks(column):
        data = LOWER[data]
        starts, ends, firsts = word_spans(data, offs)
        values, first = shingles(word_hashes(data, starts, ends), firsts, k)
        values, first = distinct_sets(values, first)
        yield i, j, values, first


def band_starts(pct: int, most: int) -> np.ndarray:
    lo = [1]
    while lo[-1] <= most:
        lo.append(lo[-1] * 100 // pct + 1)
    return np.array(lo, dtype=np.int64)


def parts_of(lo: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band the largest symmetric difference of a linked pair whose smaller set is in it, and the number of parts."""
    hi = np.maximum(lo[1:] - 1, 1)
    k = (100 - pct) * (hi + hi * 100 // pct) // (100 + pct)
    return k, k + 2 + k // 25


def tile_keys(values: np.ndarray, first: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(set's index, key) of all tiles; a key's last three bits are HOME or VISITOR."""
    size = np.diff(first)
    lo = band_starts(pct, int(size.max(initial=1)))
    k, parts = parts_of(lo, pct)
    band = np.searchsorted(lo, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    content = mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A))
    place = mix(values + np.uint64(0x51ED270B)) >> np.uint64(33)
    who, keys = [], []
    for role, shift in ((HOME, 0), (VISITOR, 1)):
        tile = band - shift
        ok = (size > 0) & (tile >= 0)
        tile = np.maximum(tile, 0)
        ok &= k[tile] > 0  # else only equal sets are linked
        n = np.where(ok, parts[tile], 0)
        at = np.concatenate([[0], np.cumsum(n)])
        use = ok[owner]
        o = owner[use]
        part = ((place[use] * n[o].astype(np.uint64)) >> np.uint64(31)).astype(np.int64)
        sums = np.zeros(at[-1], dtype=np.uint64)
        np.add.at(sums, at[o] + part, content[use])
        full = np.bincount(at[o] + part, minlength=at[-1]) > 0
        of = np.repeat(np.arange(len(size)), n)
        empty = n - np.bincount(of, full, len(size)).astype(np.int64)
        rare = empty >= n - k[tile]  # only empty parts might agree
        take = full | rare[of]
        number = np.arange(at[-1]) - at[of]
        head = mix((tile[of].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))
        key = mix(sums + head)
        who.append(of[take])
        keys.append((key[take] & ~np.uint64(7)) | np.uint64(role))
    return np.concatenate(who), np.concatenate(keys)


def _emit(key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(np.asarray(key, dtype=np.uint64)), pa.int64()), a, b], names=["key", "a", "b"])


def tiles(k: int, pct: int):
    """From batches of (doc_id, text), rows (key, a, b): classes and tiles of a; edges a-b to a copy; b shingles of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for i, j, values, first in sets_of(text, k):
                doc = ids.slice(i, j - i)
                size = np.diff(first)
                number = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                is_node = ~np.asarray(doc.is_null())
                spread = mix(number.view(np.uint64) + np.uint64(1)) & ~np.uint64(7)
                yield _emit(spread | np.uint64(META), doc, pa.array(size, pa.int64()))
                total = np.zeros(len(size), dtype=np.uint64)
                np.add.at(total, np.repeat(np.arange(len(size)), size), mix(values + np.uint64(77)))
                whole = mix(total + size.astype(np.uint64))
                new = np.zeros(len(size), dtype=bool)
                twin: list[int] = []
                of: list[int] = []
                for r in np.flatnonzero(is_node & (size > 0)):
                    h = int(whole[r])
                    if h in known:
                        twin.append(r)
                        of.append(known[h])
                    else:
                        known[h] = int(number[r])
                        new[r] = True
                if twin:
                    yield _emit(spread[twin] | np.uint64(EDGE), pa.array(of, pa.int64()), pa.array(number[twin], pa.int64()))
                if not new.any():
                    continue
                kept = np.flatnonzero(new)
                none = lambda n: pa.nulls(n, pa.int64())
                yield _emit((whole[kept] & ~np.uint64(7)) | np.uint64(CLASS), pa.array(number[kept], pa.int64()), none(len(kept)))
                some = np.concatenate([[0], np.cumsum(size[kept])])
                who, keys = tile_keys(values[np.repeat(new, size)], some, pct)
                for at in range(0, len(keys), 1 << 17):
                    part = who[at : at + (1 << 17)]
                    yield _emit(keys[at : at + (1 << 17)], pa.array(number[kept][part], pa.int64()), none(len(part)))

    return run


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, rows (kind, a, b).

    META as they are; EDGE from each class's first text to the others; TILE with a number made from
    a tile's sets and each of them, for tiles that hold a home set and another; HOME from a larger
    tile's first set to the others.
    """
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    held: dict[int, list[np.ndarray]] = {HOME: [], TILE: []}
    last = None  # (class, first text) of the run that goes on
    tile, who, home = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    large = False  # the tile that goes on has had its star begun

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), a, b], schema=schema)

    def flush(least: int):
        for kind, parts in held.items():
            if parts and sum(map(len, parts)) >= least:
                pairs = np.unique(np.concatenate(parts), axis=0)
                parts.clear()
                yield out(kind, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]))

    def settle(end: int, star: bool) -> None:
        """Keeps what the whole tiles before place end say; of the first only its star if it is large."""
        if not end:
            return
        begins = np.flatnonzero(np.concatenate([[True], tile[1:end] != tile[: end - 1]]))
        size = np.diff(np.append(begins, end))
        many = size > TILE_TEXTS
        many[0] |= star
        of = np.repeat(np.arange(len(begins)), size)
        number = np.add.reduceat(mix(who[:end].view(np.uint64) + np.uint64(0xB5)), begins)
        number = signed(mix(number + size.astype(np.uint64)))
        use = home[begins] & (size > 1)
        few, most = (use & ~many)[of], (use & many)[of]
        most[begins] = False
        held[TILE].append(np.stack([number[of[few]], who[:end][few]], axis=1))
        held[HOME].append(np.stack([who[begins[of[most]]], who[:end][most]], axis=1))

    for batch in batches:
        key = np.asarray(batch.column(0)).view(np.uint64)
        kind = (key & np.uint64(7)).astype(np.int64)
        for k in (META, EDGE):
            if (kind == k).any():
                m = pa.array(kind == k)
                yield out(k, batch.column(1).filter(m), batch.column(2).filter(m))
        rest = np.flatnonzero(kind == CLASS)
        if len(rest):
            a, group = np.asarray(batch.column(1).take(pa.array(rest))), key[rest]
            if last is not None:
                group, a = np.append(last[0], group), np.append(last[1], a)
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
            last = (group[-1], a[lead[-1]])
            same = a != a[lead]
            if same.any():
                yield out(EDGE, pa.array(a[lead][same]), pa.array(a[same]))
        rest = np.flatnonzero((kind == HOME) | (kind == VISITOR))
        if not len(rest):
            continue
        tile = np.append(tile, key[rest] >> np.uint64(3))
        who = np.append(who, np.asarray(batch.column(1).take(pa.array(rest))))
        home = np.append(home, kind[rest] == HOME)
        cut = int(np.searchsorted(tile == tile[-1], True))
        settle(cut, large)
        large = large and cut == 0
        tile, who, home = tile[cut:], who[cut:], home[cut:]
        if len(tile) > TILE_TEXTS or large:
            settle(len(tile), True)
            tile, who, home, large = tile[:1], who[:1], home[:1], True
        yield from flush(1 << 19)
    settle(len(tile), large)
    yield from flush(1)


def forest(size: np.ndarray, bits: np.ndarray, pct: int, linked=None) -> list[tuple[int, int]]:
    """Of the pairs that the bitmaps bits and linked(i, j) leave, one for each join of two components.

    size is ascending.  Two sets differ in at least as many elements as their bitmaps do in bits.
    """
    comp = np.arange(len(size))
    found = []
    for i in range(len(size) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // pct, side="right"))
        others = np.flatnonzero(comp[i + 1 : end] != comp[i]) + i + 1
        if not len(others):
            continue
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        both = size[others] + size[i]
        most = (both - apart) // 2  # the overlap is no larger
        for j in others[(100 + pct) * most >= pct * both]:
            if comp[j] != comp[i] and (linked is None or linked(i, j)):
                found.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]
    return found


def bitmaps(values: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The XOR-ed bitmaps of sets, each of a power of two of words, and where each begins."""
    at = np.concatenate([[0], np.cumsum(words)])
    v = mix(values ^ np.uint64(0x1234567))
    bits = np.zeros(at[-1], dtype=np.uint64)
    place = ((v >> np.uint64(6)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(bits, at[owner] + place, np.uint64(1) << (v & np.uint64(63)))
    return bits, at


def signatures(k: int):
    """From batches of (doc_id, text), rows (node, n, bits): each set's size and its bitmap, of about a bit for each element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, first in sets_of(batch.column(1), k):
                doc, size = batch.column(0).slice(i, j - i), np.diff(first)
                words = 1 << np.ceil(np.log2(np.maximum(size / 64, 1))).astype(np.int64)
                bits, at = bitmaps(values, np.repeat(np.arange(j - i), size), np.minimum(words, SIGNATURE_WORDS))
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(bits)])
                rows = pa.RecordBatch.from_arrays([doc, pa.array(size, pa.int64()), raw], names=["node", "n", "bits"])
                yield rows.filter(pa.array((size > 0) & ~np.asarray(doc.is_null())))

    return run


def sift(pct: int):
    """From rows (tile, node, n, bits) sorted by tile, pairs (a, b) that connect the sets of a tile that might be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            tile, node, size = (np.asarray(batch.column(c)) for c in ("tile", "node", "n"))
            raw = batch.column("bits").to_pylist()
            begins = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            a, b = [], []
            for begin, end in zip(begins, np.append(begins[1:], len(tile)), strict=True):
                order = begin + np.argsort(size[begin:end], kind="stable")
                words = min(len(raw[r]) for r in order) // 8
                # a wider bitmap is folded to the narrowest: places are hashes modulo a power of two
                bits = np.array([np.bitwise_xor.reduce(np.frombuffer(raw[r], dtype=np.uint64).reshape(-1, words), axis=0) for r in order])
                for i, j in forest(size[order], bits, pct):
                    a.append(node[order[i]])
                    b.append(node[order[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that do not cut a run of one tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.asarray(batch.column("tile"))
        if held and held[-1].column("tile")[-1].as_py() != tile[0]:
            yield pa.concat_batches(held)
            held = []
        cut = int(np.searchsorted(tile == tile[-1], True))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def links_within(ids: np.ndarray, values: np.ndarray, first: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets: one for each join of two components."""
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    n = len(order)
    if n < 2:
        return []
    rank = np.full(len(size), -1)
    rank[order] = np.arange(n)
    s = size[order]
    words = int(min(128, max(2, 1 << int(np.ceil(np.log2(max(1, int(np.median(s)) / 32)))))))
    owner = np.repeat(rank, size)
    bits, _ = bitmaps(values[owner >= 0], owner[owner >= 0], np.full(n, words))
    sets = [values[first[r] : first[r + 1]] for r in order]

    def linked(i: int, j: int) -> bool:
        x, y = sets[i], sets[j]
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum())
        return (100 + pct) * common >= pct * (len(x) + len(y))

    return [(int(ids[order[i]]), int(ids[order[j]])) for i, j in forest(s, bits.reshape(n, words), pct, linked)]


def compare(k: int, pct: int):
    """From texts sorted by (cluster, block), verified links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in runs(batches, ["cluster", "block"]):
            ids = np.asarray(table.column("doc_id"))
            vs, ns = [], []
            for _, _, values, first in sets_of(table.column("text"), k):
                vs.append(values)
                ns.append(np.diff(first))
            first = np.concatenate([[0], np.cumsum(np.concatenate(ns))])
            for x, y in links_within(ids, np.concatenate(vs), first, pct):
                a.append(x)
                b.append(y)
            if len(a) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _compared(docs: DataFrame, placed: DataFrame, k: int, pct: int) -> DataFrame:
    """Verified links among the texts placed (doc_id, cluster, block) in one block."""
    # by shuffle at every size: what is placed grows with the input
    texts = docs.join(placed.hint("merge"), "doc_id").select("cluster", "block", "doc_id", "text")
    parted = texts.repartition(F.col("cluster"), F.col("block")).sortWithinPartitions("cluster", "block")
    return parted.mapInArrow(compare(k, pct), "a long, b long")


def jaccard_components(docs: DataFrame, *, k: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Texts are linked if 100 * intersection >= pct * union of their sets of k-word shingles;
    component_id is the smallest doc_id that links reach.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = docs.mapInArrow(tiles(k, pct), "key long, a long, b long")
    rows = rows.repartition(F.shiftright("key", 3)).sortWithinPartitions("key", "a")
    found = written(rows.mapInArrow(stars, "kind int, a long, b long"), "tiles")
    free_shuffles(docs.sparkSession)  # texts and tiles are shuffled in turn: one such shuffle lies on the disks at a time
    sizes = found.where(F.col("kind") == META).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    same = found.where(F.col("kind") == EDGE).select("a", "b")
    shared = found.where(F.col("kind") == TILE).select(F.col("a").alias("tile"), F.col("b").alias("node")).distinct()
    prints = docs.mapInArrow(signatures(k), "node long, n long, bits binary")
    shared = shared.join(prints.hint("merge"), "node").select("tile", "node", "n", "bits").repartition("tile").sortWithinPartitions("tile")
    near = found.where(F.col("kind") == HOME).select("a", "b").unionAll(shared.mapInArrow(sift(pct), "a long, b long"))
    near = written(near.distinct(), "near")
    free_shuffles(docs.sparkSession)
    verified = None
    if not near.isEmpty():
        clusters = written(components(same.unionAll(near)), "clusters")
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        open_ = ends.join(clusters, "node").select("node", F.col("root").alias("cluster"))
        copies = same.select(F.col("b").alias("node")).distinct()
        lengths = sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("n")).withColumnRenamed("doc_id", "node")
        members = written(open_.join(copies, "node", "left_anti").join(lengths, "node"), "members")
        count = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("texts")).where("texts > 1")
        dealt = members.join(count, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = written(dealt, "dealt")
        large = dealt.where("blocks > 1")
        several = not large.isEmpty()
        placed = dealt.select(F.col("node").alias("doc_id"), "cluster", F.col("own").alias("block"))
        if several:
            rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node", F.lit(3)), "node"))
            pivots = large.withColumn("r", rank).where(F.col("r") <= PIVOTS)
            spread = pivots.select(F.col("node").alias("doc_id"), "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            placed = placed.unionAll(spread).distinct()
        verified = written(_compared(docs, placed, k, pct), "verified")
        free_shuffles(docs.sparkSession)
        if several:
            # all that is not in a large cluster's largest component meets all of the cluster
            roots = components(same.unionAll(verified))
            state = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            part = state.groupBy("cluster", "root").agg(F.count("*").alias("c"))
            main = part.groupBy("cluster").agg(F.max(F.struct("c", -F.col("root"))).alias("m")).select("cluster", (-F.col("m.col2")).alias("main"))
            state = written(state.join(main, "cluster"), "state")
            rest = state.where(F.col("root") != F.col("main"))
            if not rest.isEmpty():
                groups = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("groups"))
                number = F.col("own") * F.col("groups") + F.col("g")
                every = state.join(groups, "cluster").select(F.col("node").alias("doc_id"), "cluster", "own", "groups", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
                others = rest.join(groups, "cluster").withColumn("g", F.pmod(F.xxhash64("node", F.lit(9)), F.col("groups")).cast("int"))
                others = others.select(F.col("node").alias("doc_id"), "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "groups", "g")
                pairs = every.unionByName(others).select("doc_id", "cluster", number.alias("block")).distinct()
                verified = written(verified.unionAll(_compared(docs, pairs, k, pct)), "verified")
                free_shuffles(docs.sparkSession)
    links = same if verified is None else same.unionAll(verified)
    roots = components(links)
    out = sizes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, *, k: int = 5, pct: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; every row without an id stays.

    Of rows that repeat the kept doc_id with the same text one stays; a different text under the
    same id is no copy, and stays too.
    """
    joined = jaccard_components(docs, k=k, pct=pct)
    roots = joined.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(roots, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, pct=85)
