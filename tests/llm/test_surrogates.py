"""Surrogates against an entity-by-entity reading, and texts that break careless patterns."""

import regex
from sieveline.llm import surrogates as S

DATA = "/root/testdata/sf0.001"
ANY = regex.compile(S.ANY.replace(r"\d", "[0-9]"))


def replaced(spark, rows):
    return {r.doc_id: r for r in S.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}


def test_tables_entity_by_entity(spark):
    """Every entity has one surrogate of its own form, and all else stays."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(-1, "mail a.b@x.org, A.B@x.org; ip 10.2.3.4 and 8.8.4.4; 4111-1111-1111-1111 (123-45-6789), +44 20 7946 0958")]
    got = replaced(spark, rows)
    given = {}
    total = 0
    for n, text in rows:
        found = ANY.findall(text or "")
        pieces = ANY.split(text or "")
        total += len(found)
        assert got[n].n_entities == len(found)
        rest = got[n].text or ""
        for before, old, after in zip(pieces, found, pieces[1:]):
            assert rest.startswith(before)
            rest = rest[len(before) :]
            new = rest[: rest.index(after) if after else len(rest)] if "@" in old or old.count(".") == 3 else rest[: len(old)]
            shape = lambda s: regex.sub("[0-9]", "0", s)
            if "@" in old:
                assert new.count("@") == 1 and new.rpartition(".")[2] == old.rpartition(".")[2].lower()
            elif old.count(".") == 3:
                assert regex.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", new)
            else:
                assert shape(new) == shape(old)
            norm = regex.sub(r"[^0-9]", "", old) if "@" not in old and old.count(".") != 3 else old.lower()
            assert given.setdefault(norm, regex.sub(r"[^0-9]", "", new) if norm.isdigit() else new) == (regex.sub(r"[^0-9]", "", new) if norm.isdigit() else new)
            rest = rest[len(new) :]
        assert rest == pieces[-1]
    assert total > 6 and len(set(given.values())) == len(given) and not set(given) & set(given.values())


def test_long_texts(spark):
    rows = [(1, "x@" + "a." * 500_000 + "b"), (2, "a" * 1_000_000), (3, "a.b%" * 250_000 + "@x.org"), (4, "1." * 500_000), (5, "Mr. A" + "b" * 500_000), (6, "+1 " * 300_000), (7, "1" * 1_000_000)]
    got = replaced(spark, rows)
    assert [got[n].n_entities for n in range(1, 8)] == [1, 0, 1, 0, 1, 0, 0]
    assert len(got[1].text) >= 1_000_000 and all(got[n].text == t for n, t in rows if n in (2, 4, 6, 7))


def test_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("a@b.org", "k", 1, True, "p"), (None, None, None, None, None)], "text string, key string, n_entities long, _has boolean, body string")
    got = sorted(S.replace_entities(rows, key="k").collect(), key=lambda r: r.text or "")
    assert got[0].__fields__ == ["text", "key", "_has", "body", "n_entities"] and got[0].n_entities == 0 and got[0].text is None
    assert got[1].key == "k" and got[1].body == "p" and got[1].n_entities == 1 and got[1].text != "a@b.org"
    only = rows.select("text")
    assert S.replace_entities(only, key="k").columns == ["text", "n_entities"] and S.replace_entities(only.limit(0), key="k").count() == 0
