"""Substring deduplication and its index against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sieveline.llm import substring as S
from sieveline.llm.fmindex import Bits, FMIndex

DATA = "/root/testdata/sf0.001"


def brute(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(b" ".join(w[j : j + length]) for _, w in words for j in range(len(w) - length + 1))
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - length + 1):
            if count[b" ".join(w[j : j + length])] > 1:
                keep[j : j + length] = [False] * length
        left = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df, **options).collect()), key=str)


def crafted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passage, line = text(260), text(40)
    rows = [(i, " ".join(text(rng.randint(0, 150)))) for i in range(30)]
    for i in range(30, 70):  # a passage that many share, from different places on
        a = rng.randint(0, 150)
        rows.append((i, " ".join(text(rng.randint(0, 30)) + passage[a : a + rng.randint(20, 200)] + text(rng.randint(0, 30)))))
    rows += [(i, " ".join(text(10) + line + text(10))) for i in range(70, 110)]
    rows += [(200, "a " * 500), (201, "a b " * 300), (202, " ".join(passage * 3)), (203, rows[0][1]), (203, rows[0][1]), (None, rows[40][1]), (None, rows[40][1]), (204, None), (205, ""), (206, " \n ")]
    return rows


@pytest.mark.parametrize("length", [1, 5, 8, 20, 35, 71, 72, 100, 200])
def test_any_length_equals_brute_force(spark, length):
    rows = crafted()
    assert got(spark, rows, length=length, shard_words=3000) == brute(rows, length)


@pytest.mark.parametrize(("heavy", "hot", "stretch"), [(2, 8192, 1 << 22), (10**9, 3, 1 << 22), (2, 3, 100), (10**9, 8192, 77)])
def test_split_minimisers_equal_brute_force(spark, monkeypatch, heavy, hot, stretch):
    import sys

    # workers get the module by value, with these limits
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "STRETCH", stretch)
    from pyspark import cloudpickle as spark_pickle

    spark_pickle.register_pickle_by_value(sys.modules[S.__name__])
    try:
        rows = crafted(4)
        assert got(spark, rows, length=35, shard_words=3000) == brute(rows, 35)
    finally:
        spark_pickle.unregister_pickle_by_value(sys.modules[S.__name__])


def test_tables_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(spark, rows, length=35) == brute(rows, 35)


def test_long_texts_and_empty_tables(spark):
    rows = [(1, " ".join(str(i) for i in range(200_000))), (2, " ".join(str(i) for i in range(150_000, 150_100))), (3, "x " * 100_000)]
    assert [r[1:3] for r in got(spark, rows, length=50)] == [(200_000, 100), (100, 100), (100_000, 100_000)]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=35).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=0)


def test_bits_rank_and_are_compressed():
    rng = np.random.default_rng(1)
    for bit in (rng.random(5000) < 0.5, rng.random(64) < 0.1, np.zeros(3000, bool), np.ones(777, bool), np.repeat(rng.random(60) < 0.5, 301)):
        b = Bits(bit)
        at = np.arange(len(bit) + 1)
        assert b.before(at).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist()
    runs = np.repeat(np.arange(1000) % 2 == 0, 1000)
    assert Bits(runs).nbytes() < len(runs) / 8 / 2


def test_index_equals_counting():
    rng = np.random.default_rng(0)
    for _ in range(25):
        n, sig = int(rng.integers(2, 8)), int(rng.integers(2, 20))
        seqs = [rng.integers(0, sig, int(rng.integers(0, 40))) for _ in range(20)]
        words, sizes = np.concatenate(seqs).astype(np.uint64) + np.uint64(3), np.array([len(s) for s in seqs])
        first = np.concatenate([[0], np.cumsum(sizes)])
        found = FMIndex(words, sizes, depth=64).repeated_windows(words, first, n)
        c = Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1))
        assert [list(g) for g in found] == [[i for i in range(len(s) - n + 1) if c[tuple(s[i : i + n])] > 1] for s in seqs]
