"""Decontamination against a search over all windows, and texts that break careless patterns."""

from collections import defaultdict

import pytest
import regex
from sieveline.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"
NUMBER = regex.compile(r"(?<![\p{L}\p{N}])[+-]?[0-9]+(?:[.,:/][0-9]+)*")
UNIT = regex.compile(rf"(?i)(\x01\x20?)(?:{D.UNITS})(?![\p{{L}}\p{{N}}])")


def forms(text):
    even = regex.sub(r"[\x20\x09-\x0D]+", " ", regex.sub("[\x01-\x03]", "?", text or "")).strip(" ")
    slots = UNIT.sub("\\1\x02", NUMBER.sub("\x01", even))
    inner = regex.sub(r"(?<=[\p{Ll},;\x02]\x20)\p{Lu}\p{Ll}+", "\x03", slots)
    named = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", "\x03", slots)
    return [[w for w in t.lower().split(" ") if w] for t in (even, inner, named)]


def free(word):
    return not regex.search("[\x01-\x03]", word)


def bare(word):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word)


def union(starts, w):
    return len({s + i for s in starts for i in range(w)})


def function(places):
    return len({i for _, i, _ in places}) == len({(i, d) for _, i, d in places})


def brute(docs, items, window=D.WINDOW, cover=D.COVER):
    found = set()
    ready = [(n, forms(t)) for n, t in items]
    for doc, text in docs:
        have = forms(text)
        for item, of in ready:
            size = len(of[0])
            w = min(window, size)
            if not w:
                continue
            where = [defaultdict(list) for _ in range(3)]
            for f in range(3):
                for at in range(len(have[0]) - w + 1):
                    where[f][tuple(have[f][at : at + w])].append(at)
            lines = defaultdict(lambda: defaultdict(set))
            for start in range(size - w + 1):
                some = range(start, start + w)
                enough = size >= D.MIN_ITEM
                literal = [True, enough and sum(free(of[1][i]) for i in some) >= D.MIN_LITERAL, enough and sum(free(of[2][i]) for i in some) >= D.MIN_LITERAL]
                for f in range(3):
                    for at in where[f].get(tuple(of[f][start : start + w]), []) if literal[f] else []:
                        lines[at - start][f].add(start)
            for diagonal, by in lines.items():
                every, strict, same = by[0] | by[1] | by[2], by[0] | by[1], by[0]
                slots = lambda starts, forms_: {(i, bare(of[0][i]), bare(have[0][i + diagonal])) for s in starts for i in range(s, s + w) if not all(free(of[f][i]) for f in forms_)}
                enough = min(cover, size)
                good = union(same, w) >= enough or union(every, w) >= enough and function(slots(every, (1, 2))) or union(strict, w) >= enough and function(slots(strict, (1,)))
                if not good:
                    for lo in sorted(every):
                        for hi in sorted(every):
                            run = {s for s in every if lo <= s <= hi}
                            if run and union(run, w) >= 2 * cover and function({p for p in slots(every, (1, 2)) if lo <= p[0] < max(run) + w}):
                                good = True
                if good:
                    found.add((doc, item))
    return found


def got(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.item_id) for r in D.leaks(d, b, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_tables_equal_all_windows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and got(spark, docs, items) == want


WORDS = " ".join(f"w{chr(97 + i)}ord" for i in range(24)).split()


@pytest.mark.parametrize("limit", [1 << 26, 2000])
def test_cases_equal_all_windows(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    two = [w if i not in (8, 17) else "new" for i, w in enumerate(WORDS)]
    items = [
        (1, "Anna has 5 apples and gives 2 apples to her brother, who eats them."),
        (2, " ".join(WORDS)),
        (3, "two words"),
        (4, "1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (5, "He paid 5, then 5. Then he paid 5 and left the old town on foot"),
        (6, ""),
        (7, None),
    ]
    docs = [
        (1, "Boris has 7 apples and gives 3 apples to her brother, who eats them."),
        (2, " ".join(two)),
        (3, "some two words here"),
        (4, "x 1 2 3 4 5 6 7 8 9 10 11 12 13 y"),
        (5, "Boris has 3 apples and gives 3 apples to her brother, who eats them."),
        (6, "13 12 11 10 9 8 7 6 5 4 3 2 1"),
        (7, "He paid 9, then 9. Then he paid 9 and left the old town on foot"),
        (8, "He paid 9, then 8. Then he paid 7 and left the old town on foot"),
        (9, None),
        (10, ""),
        (None, " ".join(two)),
        (2, " ".join(two)),
    ]
    want = brute(docs, items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (7, 5), (None, 2)} == want
    assert got(spark, docs, items) == want
    assert got(spark, docs, items[5:]) == set() == got(spark, docs[8:10], items)


def test_long_texts_and_empty_tables(spark):
    docs = [(1, "1,1," * 250_000), (2, "1 " * 200_000), (3, "ab" * 500_000), (4, "Anna " * 100_000), (5, " ".join(WORDS * 3000))]
    items = [(1, " ".join(WORDS)), (2, "1,1," * 3000)]
    assert got(spark, docs, items) == {(5, 1)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(empty, bench).count() == 0 and D.drop_leaks(empty, bench).count() == 0
    full = spark.createDataFrame([(1, " ".join(WORDS), "a", 2), (2, "clean", "b", 3)], "doc_id long, text string, _id string, anchor long")
    assert [tuple(r) for r in D.drop_leaks(full, bench).collect()] == [(2, "clean", "b", 3)]
    assert D.drop_leaks(full, bench.limit(0)).count() == 2
