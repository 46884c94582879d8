"""The byte network against a plain loop over windows and filters, alone and in batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sieveline.llm import langid as L


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    rows = [(" ".join(word("abcdef") for _ in range(rng.randint(1, 90))), "xx") for _ in range(60)]
    rows += [(" ".join(word("defghé") for _ in range(rng.randint(1, 90))), "yy") for _ in range(60)]
    return L.train(rows)


TEXTS = ["abc", "a", "hgé " * 100, "ab fg" * 51 + "a", "é" * 128, "x" * 253, "x" * 254, "x" * 255, "x" * 256, "fghé " * 400, "", "cab " * 63 + "efg"]


def plain(model, text):
    raw = text.encode() + bytes(L.REACH - 1)
    total, weight = np.zeros(len(model.langs)), 0
    for at in range(0, len(raw), L.WINDOW):
        best = np.full(model.conv.shape[1], -np.inf)
        for i in range(at, at + L.WINDOW):
            gram = [raw[j] if j < len(raw) else 0 for j in range(i, i + L.REACH)]
            best = np.maximum(best, model.embed[gram].ravel() @ model.conv)
        z = np.maximum(best + model.bias, 0) @ model.dense + model.out
        z = z - z.max()
        used = max(1, min(L.WINDOW, len(text.encode()) - at))
        total += used * (z - np.log(np.exp(z).sum()))
        weight += used
    p = np.exp(total / weight)
    return p / p.sum()


def test_equals_plain_convolution(model):
    langs, scores = L.predict_columns(model, pa.array(TEXTS))
    for text, lang, score in zip(TEXTS, langs, scores):
        p = plain(model, text)
        assert abs(p.max() - score) < 1e-4 and (p.max() - np.sort(p)[-2] < 1e-3 or model.langs[int(p.argmax())] == lang)


def test_alone_batched_and_shuffled_are_the_same(model):
    whole = L.predict_columns(model, pa.array(TEXTS))[1]
    assert [L.predict_columns(model, pa.array([t]))[1][0] for t in TEXTS] == whole
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    mixed = L.predict_columns(model, pa.array([TEXTS[i] for i in order]))[1]
    assert [mixed[order.index(i)] for i in range(len(TEXTS))] == whole


def test_gradients_lead_to_the_labels(model):
    rng = random.Random(9)
    some = ["".join(rng.choice(letters) for _ in range(80)) for letters in ("abc", "ghé") for _ in range(20)]
    assert L.predict_columns(model, pa.array(some))[0] == ["xx"] * 20 + ["yy"] * 20


def test_odd_tables(spark, model):
    rows = spark.createDataFrame([(1, None, "a", "b", 0.5), (2, "12 3", "a", "b", 0.5), (3, "ab " * 300_000, "a", "b", 0.5), (3, "ab", None, None, None)], "doc_id long, text string, body string, _lang string, lang_score double")
    got = [tuple(r) for r in L.identify(rows, model).orderBy("doc_id", "text").collect()]
    assert [(g[0], g[2], g[3], g[4]) for g in got] == [(1, "a", "b", "und"), (2, "a", "b", "und"), (3, None, None, "xx"), (3, "a", "b", "xx")]
    assert got[0][5] == got[1][5] == 0.0 and 0.5 < got[3][5] <= 1
    assert L.identify(rows.limit(0), model).count() == 0 and L.train([]) is None and L.train([("1 2", "xx")]) is None
    labels = rows.selectExpr("doc_id", "'xx' as label")
    from sieveline.llm.sampling import labelled_sample

    assert labelled_sample(rows, labels, rows=10, most_bytes=10) in ([("", "xx")], [("", "xx"), ("12 3", "xx")], [("ab", "xx")], [("12 3", "xx")], [("ab", "xx"), ("12 3", "xx")], [("", "xx"), ("12 3", "xx"), ("ab", "xx")])
