"""Secrets against a loop of Python patterns, chats with parts of every type, and byte BPE against the library."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from sieveline.llm import bpe, chat, scratch
from sieveline.llm import secret_scan as S

DATA = "/root/testdata/sf0.001"
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def base_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_query_equals_python_patterns(spark):
    got = {r.doc_id: r for r in S.op2_secret_scan(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert set(spans) <= set(got[i].spans.split(","))


def test_second_version_scans_only_new_pairs(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "B" * 12), (2, "gho_" + "x" * 36), (3, None), (3, None)], "doc_id long, text string")
    ledger = S.scan(docs, rules=S.FIRST_RULES)
    fresh = S.scan(docs, ledger)
    assert {r.rule for r in ledger.collect()} == {r.id for r in S.FIRST_RULES}
    assert {r.rule for r in fresh.collect()} == {r.id for r in S.RULES} - {r.id for r in S.FIRST_RULES}
    assert S.scan(docs, S.advance(ledger, docs)).count() == 0
    whole = sorted(map(str, S.findings(docs).collect()))
    assert whole == sorted(map(str, S.findings(docs, ledger).collect())) == sorted(map(str, S.findings(docs, ledger.unionAll(ledger)).collect()))


def test_whole_private_keys_and_clashing_columns(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA" + "x-y" * 5 for _ in range(9))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n{body}\n-----END RSA PRIVATE KEY-----"
    open_ = "-----BEGIN PRIVATE KEY-----"
    rows = [(1, f"a {key} b {key}", "p", [1], 7), (2, f"{open_} {open_} x", None, None, None), (3, open_ * 40_000, "q", [2], 8), (4, "-" * 1_000_000, "q", [], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secret_blob string, secret_spans array<int>, secret_gone int")
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert got[1].text == "a [SECRET] b [SECRET]" and got[2].text == "[SECRET] [SECRET] x" and got[3].text == "[SECRET]" and got[4].text == rows[3][1]
    assert [tuple(got[i])[2:] for i in (1, 2, 3, 4)] == [tuple(r[2:]) for r in rows]
    found = S.findings(docs)
    assert found.columns == ["doc_id", "text", "secret_blob", "secret_gone", "secret_spans"] and found.count() == 4
    assert S.redact(docs.limit(0)).count() == 0


PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, attachments string"


def part(type_, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (type_, text, ref, width, height, seconds, pages)


def test_parts_of_every_type(spark):
    rows = [
        (1, 0, "user", [part("text", "see <this> \\ "), part("image", ref="s3://a/b:c>d.png", width=29, height=14), part("text", "and"), part("audio", ref="x.wav", seconds=2.1)], "a"),
        (1, 1, "assistant", [part("document", ref="r.pdf", pages=3), part(None, "ok"), part("vid:eo<>", ref=None)], "b"),
        (1, 2, "user", None, "c"),
        (1, 3, "user", [], "c"),
        (2, None, None, [part("image"), part("audio"), part("document"), part("text")], None),
    ]
    chats = chat.format_chats(spark.createDataFrame(rows, PARTS))
    turns = chats.withColumn("t", chat.read_bodies(F.col("formatted"))).withColumn("p", F.transform("t", lambda t: chat.read_parts(t.body)))
    got = {r.conv_id: r for r in turns.collect()}
    plain = lambda parts: [(p.type, p.text, p.ref, p.tokens) for p in parts]
    first, second, third, fourth = got[1].p
    assert plain(first) == [("text", "see <this> \\ ", None, 0), ("image", None, "s3://a/b:c>d.png", 3), ("text", "and", None, 0), ("audio", None, "x.wav", 53)]
    assert plain(second) == [("document", None, "r.pdf", 768), ("text", "ok", None, 0), ("vid:eo<>", None, "", 0)] and third == fourth == []
    assert [(a.turn_no, a.part_no, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "s3://a/b:c>d.png", 3), (0, 3, "audio", "x.wav", 53), (1, 0, "document", "r.pdf", 768), (1, 2, "vid:eo<>", None, 0)]
    assert got[1].attachment_tokens == 824 and got[2].attachment_tokens == 1 + 1 + 256
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["<document:r.pdf:768>ok<vid\\ceo\\l\\g::0>"]
    assert plain(got[2].p[0]) == [("image", None, "", 1), ("audio", None, "", 1), ("document", None, "", 256)]
    assert chat.format_chats(spark.createDataFrame([], PARTS)).count() == 0


def test_random_chats_are_read_back(spark):
    rng = random.Random(4)
    bits = ["<", ">", "\\", "\\b", "\\l", "\n", "</turn>\n", "<turn ", ":", "é", "😀", "a", " ", "<image:x:3>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), [part("text", text()) if rng.random() < 0.5 else part("image", ref=text(), width=rng.randint(1, 99), height=rng.randint(1, 99)) for _ in range(rng.randint(0, 5))], None) for c in range(60) for t in range(rng.randint(1, 5))]
    out = chat.format_chats(spark.createDataFrame(rows, PARTS)).withColumn("t", chat.read_bodies(F.col("formatted"))).withColumn("p", F.transform("t", lambda t: chat.read_parts(t.body)))
    got = {r.conv_id: r for r in out.collect()}
    for c in range(60):
        mine = [r for r in rows if r[0] == c]
        assert [t.role for t in got[c].t] == [r[2] for r in mine]
        for r, parts in zip(mine, got[c].p):
            want = []
            for p in r[3]:
                if p[0] == "image":
                    want.append(("image", p[2]))
                elif p[1]:
                    want.append(("text", want.pop()[1] + p[1] if want and want[-1][0] == "text" else p[1]))
            assert [(p.type, p.text if p.type == "text" else p.ref) for p in parts] == want


def test_bpe_query_equals_the_library(spark):
    import numpy as np
    import public_tokenizers

    enc = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.mark.parametrize("pattern", [r"\S+\s*|\s+", r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+(?!\S)|\s+"])
def test_other_patterns_are_not_cut(spark, pattern):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "!", "\n", " ", "1", "\r\n", "é"]) for _ in range(300)), "x") for i in range(30)] + [(None, None, "y"), (3, "", None), (4, "é! \n" * 50_000, "z")]
    assert not bpe.splits(pattern) and bpe.splits(public_tokenizers.PATTERN)
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe_n_tokens string")
    enc = bpe.load(path, pattern)
    got = bpe.encode_texts(docs, path, pattern, leaf=4).collect()
    assert len(got) == 33 and all(r.bpe_n_tokens == len(enc.encode_ordinary(r.text or "")) for r in got)
    assert bpe.encode_texts(docs.limit(0), path, pattern).count() == 0


def test_tables_are_deleted(spark):
    import os

    one = scratch.written(spark.range(3), "t")
    assert one.count() == 3
    with scratch.Passing(spark) as passing:
        two, three = scratch.written(spark.range(4), "t"), passing.keep(scratch.written(spark.range(5), "t"))
    exists = lambda df: os.path.isdir(df._written_to.removeprefix("file:"))
    assert exists(one) and not exists(two) and three.count() == 5
    scratch.forget(one)
    scratch.forget(three)
    assert not exists(one) and not exists(three)
