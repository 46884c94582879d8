"""The operators against brute force on small inputs, and on odd ones."""

import random
import re

import numpy as np
import pytest
from sieveline.llm import bpe, chat, decontaminate, jaccard, langid, secret_scan, substring, surrogates, toxicity
from sieveline.llm.components import components

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", "x"), (3, "   \n", None), (None, "a b c d e f", "x"), (4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (5, "é " * 3000, "y")]
SCHEMA = "doc_id long, text string, Toxicity string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in table(spark, "documents").collect()}


def test_secret_spans(spark):
    docs = spark.createDataFrame([(1, 'secret: ab token="abcdefgh1" x'), (2, "secret= token:abcdefgh"), (3, None), (4, "é" * 5 + "AKIA" + "A" * 12)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secret_scan.findings(docs).collect()}
    assert got == {1: [("assign", 11, 27)], 2: [], 3: [], 4: [("access", 5, 21)]}
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert masked[1] == 'secret: ab [SECRET]" x' and masked[3] is None


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "B" * 12), (2, "none")], "doc_id long, text string")
    first = secret_scan.scan(docs)
    assert secret_scan.scan(docs, first).count() == 0
    more = docs.union(spark.createDataFrame([(3, "f" * 40)], docs.schema))
    assert secret_scan.scan(more, first).select("blob").distinct().count() == 1
    assert sorted((r.doc_id, len(r.secret_spans)) for r in secret_scan.findings(more, first).collect()) == [(1, 1), (2, 0), (3, 1)]


def test_chat_round_trip(spark):
    rows = [(1, 0, "us<er>\n", "a\\l<b\\b</turn>\n"), (1, 1, "assistant", None), (2, 0, None, "x"), (1, 2, "assistant", "<turn user>\n")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    out = chat.format_chats(m.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("us<er>\n", "a\\l<b\\b</turn>\n"), ("assistant", ""), ("assistant", "<turn user>\n")]
    assert got[1].l == "<turn user>\n" and [(t.role, t.text) for t in got[2].t] == [("", "x")]


def test_bpe_equals_library():
    import public_tokenizers

    enc = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    random.seed(3)
    bits = ["a", "'s", "'", "re", " ", "  ", "\n", "1", "é", "!", "\x1c", "\xa0", "😀", "the"]
    for _ in range(400):
        s = "".join(random.choice(bits) for _ in range(random.randint(0, 50)))
        ids = enc.encode_ordinary(s)
        assert all(bpe.encode(s, enc, leaf) == ids for leaf in (1, 3, 8))
        assert bpe.decode(ids, enc, 2) == s.encode()


def brute_components(docs, k, pct):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [3000, 4])
def test_jaccard_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    docs = texts(spark)
    base = docs[min(docs)].split()[:60]
    for n in range(30):  # near copies of which neighbours only are alike
        base = base[:]
        base[n % 60] = f"w{n}"
        docs[100000 + n] = " ".join(base)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=4, pct=85).collect()}
    assert got == brute_components(docs, 4, 85)


def test_one_of_each_group_stays_and_no_other_text_goes(spark):
    a, b = " ".join(f"a{n}" for n in range(60)), " ".join(f"b{n}" for n in range(60))
    rows = [(3, a, 1), (3, b, 2), (5, a + " x", 3), (7, b, 4), (7, b, 5), (8, None, 6), (9, "", 7), (None, a, 8), (None, a, 9)]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, component_id long"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (3, b), (8, None), (9, ""), (0, a), (0, a)], key=str)
    assert jaccard.keep_first(kept.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (1, 1), (None, 2)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "A train leaves the station at 60 km and travels for 3 hours before it meets Anna near the old stone bridge"), (2, "too short")], "item_id long, text string")
    again = "so: A train leaves the station at 75 km and travels for 4 hours before it meets Boris near the old stone bridge"
    bad = "A train leaves the station at 75 km and travels for 75 hours before it meets Boris near the old stone bridge"
    docs = spark.createDataFrame([(1, again), (2, bad), (3, "a train leaves the station"), (4, None)], "doc_id long, text string")
    # two values of the item's may be one of the document's
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {1, 2}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4]


def test_decontamination_of_inconsistent_copies(spark):
    word = lambda n: "".join("bcdfghklmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{n:03d}")
    passage = lambda number, first=0: " ".join(str(number(n)) if n % 6 == 3 else word(n + first) for n in range(100))
    item = passage(lambda n: 5 if n in (9, 57) else n)
    copy = item.replace("5 " + word(58), "6 " + word(58))  # one number changed of two that were equal
    asked = passage(lambda n: 1000 + (5 if n in (9, 15, 57) else n))  # all numbers are others, and two that differed are equal
    mixed = passage(lambda n: n, 500)  # the item has one number only, so no run is consistent
    docs = spark.createDataFrame([(1, copy), (2, asked), (3, mixed), (4, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, passage(lambda n: 7, 500))], "item_id long, text string")
    assert copy != item and {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {1, 2, 4}
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [3]


def test_decontamination_of_other_writings(spark):
    items = [
        (1, "Tom has 5 apples. Tom gives 2 apples to his friend. Tom buys 9 pears after lunch."),
        (2, "yesterday she met Anna in town and paid 60 km fare"),
        (3, "Tom counts 7 green sheep"),
        (4, "We drove, Maria told us, for 90 km along the coast until Peter fell asleep near the harbour"),
        (5, "Pride And Prejudice By Jane Austen"),
    ]
    texts = {
        1: "Max has 6 apples. Max gives 3 apples to his friend. Max buys 8 pears after lunch.",
        2: "Yesterday she\nmet  Anna in town\nand paid 60\nkm fare",
        3: "now: Eve counts 8 green sheep",
        4: items[3][1].lower().replace(" ", "  "),
        5: "of pride and prejudice\nby jane austen we read",
        6: "yesterday she met Anna out of town and paid 60 km fare",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, n) for n in range(1, 6)]


def test_surrogates(spark):
    rows = [(1, "Mr. John Smith and Mrs. Anna Smith, Mr. Smith; a.b@X.org A.B@x.org +1 (017) 555-7713 and +1 017 555 7713; 4111 1111 1111 1111"), (2, None), (3, "plain"), (4, "Mr. John Smith")]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    t = got[1].text
    m = re.match(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+), Mr\. (\w+); (\S+) (\S+) \+1 \((\d{3})\) (\d{3})-(\d{4}) and \+1 (\d{3}) (\d{3}) (\d{4}); (\d{4} \d{4} \d{4} \d{4})$", t)
    assert m and m[2] == m[4] == m[5] and m[6] == m[7] and m[3].endswith("a") and (m[8], m[9], m[10]) == (m[11], m[12], m[13])
    assert "Smith" not in t and got[4].text == f"Mr. {m[1]} {m[2]}" and got[2].text is None and got[3].text == "plain"
    digits = [int(c) for c in m[14] if c != " "]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_hint_holds_for_every_entity(spark):
    found = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "123-45-6789", "+45 12 34 56 78", "+47-22-33-44", "+1 (555) 123-4567", "(55) 123 456", "555.123.4567", "06 12 34 56 78", "06-12-34-56-78", "06.12.34.56.78", "Mr. Li", "Госпожа Анна"]
    rows = spark.createDataFrame([(i, f"at {t} ok") for i, t in enumerate(found)], "doc_id long, text string")
    assert rows.where(rows.text.rlike(surrogates.ANY)).count() == rows.where(rows.text.rlike(surrogates.HINT)).count() == len(found)
    got = {r.doc_id: r for r in surrogates.replace_entities(rows, key="k").collect()}
    assert all(got[i].n_entities == 1 and t not in got[i].text for i, t in enumerate(found))


def test_surrogates_of_later_mentions(spark):
    rows = [
        (1, "Mr. John Smith called. Smith (John Smith) said SMITH's dog, Smithson and smith."),
        (2, "Smith and John stay"),
        (3, "call 555-123-4567 or (555) 123-4567, 1 555 123 4567, 06 12 34 56 78; not 12-05-2024, 2001-555-123-4567"),
        (4, "Smith saw Herr Smith"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    m = re.match(r"Mr\. (\w+) (\w+) called\. (\w+) \((\w+) (\w+)\) said (\w+)'s dog, Smithson and smith\.$", got[1].text)
    assert m and m[2] == m[3] == m[5] and m[1] == m[4] and m[6] == m[2].upper() and got[1].n_entities == 5
    assert "John" not in got[1].text and m[2] != "Smith" and got[2].text == rows[1][1] and got[2].n_entities == 0
    p = re.match(r"call (\d{3})-(\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}), (\d) (\d{3}) (\d{3}) (\d{4}), (\d\d(?: \d\d){4}); not 12-05-2024, 2001-555-123-4567$", got[3].text)
    assert p and p.groups()[:3] == p.groups()[3:6] != ("555", "123", "4567") and p[11] != "06 12 34 56 78" and got[3].n_entities == 4
    assert got[4].text == f"{m[2]} saw Herr {m[2]}" and got[4].n_entities == 2


def test_surrogates_where_values_run_short(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 2)
    emails = [("email", f"{c}@x.org") for c in "0123456789"]
    phones = [("phone", f"2:12{n:02d}") for n in range(45)]  # 45 originals, 55 free values
    ips = [("ip", f"10.0.0.{n}") for n in range(5)] + [("card", "4111111111111111"), ("surname", "Li"), ("name_m", "Li")]
    got = surrogates.assign(spark.createDataFrame(emails + phones + ips, "kind string, norm string"), "k").collect()
    given = [("name" if "name" in r.kind else r.kind, r.surrogate) for r in got]
    assert len(given) == len(set(given)) == 63
    assert not {s for _, s in given} & ({n for _, n in emails + ips} | {n[2:] for _, n in phones})
    assert all(len(r.surrogate) == 4 and r.surrogate.startswith("12") for r in got if r.kind == "phone")
    frame = spark.createDataFrame([("phone", "phone", "1:15", "15"), ("ip", "ip", "10.0.0.1", "10.0.0.1"), ("card", "card", "4111111111111111", "4111111111111111")], "kind string, family string, norm string, plain string")
    taken = spark.createDataFrame([("phone", f"1{n}") for n in range(9)], "family string, surrogate string")
    dealt = {r.kind: r.surrogate for r in surrogates.free_values(frame, taken, "k").collect()}
    assert dealt["phone"] == "19" and re.fullmatch(r"10(\.\d{1,3}){3}", dealt["ip"]) and re.fullmatch(r"4\d{15}", dealt["card"])
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(dealt["card"])) % 10 == 0


def test_classifiers():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(" ".join([word() for _ in range(80)] + (["idiotic", "scumbag"] if n % 5 == 0 else [])), int(n % 5 == 0)) for n in range(600)]
    m = toxicity.train(rows)
    import pyarrow as pa

    s = toxicity.score_column(m, pa.array([t for t, _ in rows] + ["", None]))
    assert np.mean((s[:600] >= 0.5) == [y == 1 for _, y in rows]) > 0.98 and s[600] == s[601] < 0.5
    assert toxicity.score_column(toxicity.train([("a", 1)]), pa.array(["a"])).tolist() == [0.0]
    pairs = [("der und die " * 20 + word(), "de") if n % 2 else ("the and of " * 20 + word(), "en") for n in range(200)]
    model = langid.train(pairs)
    assert langid.predict_columns(model, pa.array(["the of " * 90, "und der " * 90]))[0] == ["en", "de"]


def test_odd_rows(spark, odd):
    scored = toxicity.score(odd, toxicity.train([("bad bad", 1)] * 30 + [("good day", 0)] * 30))
    assert scored.count() == 7 and scored.columns == ["doc_id", "text", "toxicity"]
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(odd, None).collect()} == {(i, "und") for i, _, _ in ODD}
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert (0, 2, None) in got and (1, 0, 1) in got and got.count((4, 2, 4)) == 2
    assert substring.remove_repeats(odd).count() == 7
    assert secret_scan.findings(odd).count() == 7 and surrogates.replace_entities(odd, key="k").count() == 7
    none = odd.limit(0)
    assert jaccard.jaccard_components(none).count() == 0 and substring.remove_repeats(none).count() == 0
    assert surrogates.replace_entities(none, key="k").count() == 0 and secret_scan.findings(none).count() == 0


@pytest.mark.parametrize("most", [2048, 3])
def test_tiles_join_all_that_might_be_linked(monkeypatch, most):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", most)
    import pyarrow as pa

    rng = random.Random(5)
    tiles = {t: (rng.randint(0, 7), rng.randint(0, 9)) for t in range(60)}
    rows, want = [], []
    for t, (homes, visitors) in tiles.items():
        nodes = rng.sample(range(1000), homes + visitors)
        rows += [(t << 3 | (jaccard.HOME if n < homes else jaccard.VISITOR), a) for n, a in enumerate(nodes)]
        if homes and len(nodes) > 1:
            want.append(frozenset(nodes))
    rows.sort(key=lambda r: r[0])
    batches = [jaccard._emit([k for k, _ in part], pa.array([a for _, a in part], pa.int64()), pa.nulls(len(part), pa.int64())) for part in (rows[i : i + 7] for i in range(0, len(rows), 7))]
    few, stars = {}, set()
    for batch in jaccard.stars(iter(batches)):
        for r in batch.to_pylist():
            if r["kind"] == jaccard.TILE:
                few.setdefault(r["a"], set()).add(r["b"])
            else:
                assert r["kind"] == jaccard.HOME
                stars.add((r["a"], r["b"]))
    assert {frozenset(s) for s in few.values()} == {s for s in want if len(s) <= most}
    for s in want:
        if len(s) > most:
            assert any({(c, x) for x in s if x != c} <= stars for c in s)
