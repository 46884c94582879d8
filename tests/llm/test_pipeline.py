"""The pipeline over the smallest tables and planted rows, against a brute-force version of each stage."""

import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from sieveline.llm import bpe, toxicity

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
KEY = "AKIA" + "Q7" * 8


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """The tables, with copies, a near copy, a passage of the benchmark, a secret and odd rows added to documents."""
    folder = tmp_path_factory.mktemp("tables")
    docs, bench, labels = (pd.read_parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark", "labels"))
    clean = set(labels.doc_id[labels.toxic == 0])
    base = next(t for i, t in zip(docs.doc_id, docs.text) if i in clean and t and 150 < len(t.split()) < 400)
    words = base.split()
    item = max(bench.text.dropna(), key=lambda t: len(t.split()))
    extra = {
        900000: base,
        900001: " ".join([*words[:-1], "changed"]),
        900002: f"{' '.join(words[:20][::-1])} {item} {' '.join(words[20:40][::-1])}",
        900003: f"{' '.join(words[::-1])} {KEY} {' '.join(words[:30])}",
        900004: None,
        900005: "",
    }
    more = pd.DataFrame({"doc_id": list(extra), "text": list(extra.values()), "lang": "en", "source": "web", "n_chars": [len(t or "") for t in extra.values()]})
    pd.concat([docs, more.astype({"doc_id": docs.doc_id.dtype, "n_chars": docs.n_chars.dtype})]).to_parquet(f"{folder}/documents.parquet", index=False)
    bench.to_parquet(f"{folder}/benchmark.parquet", index=False)
    labels.to_parquet(f"{folder}/labels.parquet", index=False)
    return str(folder)


def test_stages(spark, planted):
    import public_tokenizers
    from test_llm import brute_components

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{planted}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    score = dict(zip(text, toxicity.score_column(model, pa.array(list(text.values()), pa.string())), strict=True))
    left = {i: t for i, t in text.items() if score[i] < 0.5}
    roots = brute_components({i: t or "" for i, t in left.items()}, 5, 80)
    left = {i: t for i, t in left.items() if roots[i][1] == i}
    assert not {900000, 900001} & set(left) and {900002, 900003, 900004, 900005} <= set(left)

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, planted).collect()}
    assert set(rows) <= set(left)
    gone = set(left) - set(rows)
    assert 900002 in gone
    bench = [t.lower().split() for t in pd.read_parquet(f"{planted}/benchmark.parquet").text.dropna()]
    grams = {tuple(w[i : i + 13]) for w in bench for i in range(len(w) - 12)}
    for i, t in left.items():  # a passage word by word never stays
        w = (t or "").lower().split()
        if any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12)):
            assert i in gone
    enc = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, r in rows.items():
        ids = np.frombuffer(r.bpe_ids, dtype="<u4").tolist()
        assert ids == enc.encode_ordinary(r.text or "") and enc.decode_bytes(ids) == (r.text or "").encode()
        assert not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text or "")
        assert r.n_chars == len(r.text) if r.text is not None else r.text == left[i]
    assert rows[900003].text == left[900003].replace(KEY, "[SECRET]")
    assert rows[900004].text is None and rows[900005].text == ""


def test_shuffles_of_the_join_go_before_the_next(spark, monkeypatch):
    from sieveline.llm import jaccard, scratch

    steps, write, free = [], jaccard.written, jaccard.free_shuffles
    monkeypatch.setattr(jaccard, "written", lambda df, name: steps.append(name) or write(df, name))
    monkeypatch.setattr(jaccard, "free_shuffles", lambda session: steps.append("free") or free(session))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 3 :])) for i in range(30)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {0}
    assert [steps[k + 1] for k, name in enumerate(steps) if name in ("tiles", "near", "verified")] == ["free"] * 3

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    spark.range(1000).repartition(3, "id").groupBy("id").count().collect()
    made = files() - before
    spark.range(1).collect()
    scratch.free_shuffles(spark)
    for _ in range(50):
        if made & files():
            time.sleep(0.1)
    assert made and not made & files()
