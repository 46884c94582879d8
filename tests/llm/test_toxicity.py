"""The label model on planted votes, and the query on held-out rows and odd tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sieveline.llm import toxicity as T
from sieveline.llm.sampling import fold


def planted(seed: int, n: int = 6000):
    """Votes of eight voters of known rates: two kinds of toxic text, and three voters that mostly repeat another one."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=[0.8, 0.12, 0.08])
    rate = np.array([[0.02, 0.02, 0.03, 0.01, 0.02, 0.05], [0.8, 0.7, 0.75, 0.02, 0.02, 0.3], [0.02, 0.02, 0.03, 0.85, 0.7, 0.3]])
    votes = (rng.random((n, 6)) < rate[kind]).astype(float)
    repeats = np.where(rng.random((n, 2)) < 0.93, votes[:, [5, 5]], rng.random((n, 2)) < 0.1)
    return np.hstack([votes, repeats]), kind


def best_possible(votes, kind):
    """How often a reader of the planted rates, who knows which voters repeat, is right."""
    y = kind > 0
    say = np.zeros((len(votes), 2))
    for pattern in np.unique(votes, axis=0):
        at = (votes == pattern).all(1)
        say[at] = [(~y[at]).sum(), y[at].sum()]
    return (say.argmax(1) == y).mean()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_rates_correlations_and_classes_are_recovered(seed):
    votes, kind = planted(seed)
    y = kind > 0
    noted = np.where(np.arange(len(y)) % 3 == 0, y, -1)  # names the kinds
    model = T.label_model(votes, noted)
    want = np.stack([votes[~y].mean(0), votes[y].mean(0)])
    assert np.abs(model.rate - want).max() < 0.06
    rest = votes - want[y.astype(int)]
    assert np.abs(model.correlation - np.corrcoef(rest.T)).max() < 0.15
    assert model.correlation[5:, 5:].min() > 0.6 > 0.3 > np.abs(model.correlation[:3, 5:]).max()
    assert ((model.posterior(votes) > 0.5) == y).mean() > best_possible(votes, kind) - 0.02


def test_silence_counts_and_repeated_voters_count_once():
    votes, kind = planted(5)
    y = kind > 0
    model = T.label_model(votes, np.where(np.arange(len(y)) % 3 == 0, y, -1))
    none, all_ = np.zeros((1, 8)), np.zeros((1, 8))
    all_[0, 5:] = 1
    silent = model.posterior(none)[0]
    # as if the three had nothing in common, their votes would be worth three times one of them
    odds = lambda p: np.log(p / (1 - p))
    single = np.log(model.rate[1, 5:] / model.rate[0, 5:]).sum()
    assert silent < 0.05 and odds(model.posterior(all_)[0]) - odds(silent) < 0.9 * single


def test_labels_are_no_votes():
    """Wrong labels on a tenth of the texts hardly change what is believed."""
    votes, kind = planted(7)
    y = (kind > 0).astype(int)
    rng = np.random.default_rng(0)
    noisy = np.where(rng.random(len(y)) < 0.1, 1 - y, y)
    clear, dim = T.label_model(votes, y).posterior(votes) > 0.5, T.label_model(votes, noisy).posterior(votes) > 0.5
    assert (clear == (y == 1)).mean() > 0.94 and (dim == (y == 1)).mean() > 0.9  # more than of the labels are right


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = T.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    held = got.where("held_out").select("predicted", "toxic", "score").collect()
    wrong = sum(r.predicted != r.toxic for r in held)
    assert len(held) > 700 and wrong / len(held) < 0.03 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    false = sum(r.predicted == 1 and r.toxic == 0 for r in held)
    assert false / len(held) < 0.01
    assert got.where((fold(F.col("doc_id"), 5) == 0) != F.col("held_out")).isEmpty()


def test_odd_tables(spark):
    rows = [(n, ("you idiot, scum " if n % 4 == 0 else "a fine day ") * 5 + f"w{n} " * 9, "x", n % 4 == 0) for n in range(200)]
    rows += [(900, None, None, None), (901, "", "x", None), (902, "scum idiot " * 100_000, None, None), (902, "scum idiot " * 100_000, "y", None), (None, "fine", "z", None)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, Toxicity string").withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows if r[3] is not None] + [(901, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {(r.doc_id, r.text): r.toxicity for r in T.score(docs, model).collect()}
    assert got[902, rows[202][1]] > 0.5 and got[900, None] == got[901, ""] < 0.5 and got[None, "fine"] < 0.5
    assert T.score(docs, model).count() == 205 and T.score(docs.limit(0), model).count() == 0
    assert T.fit(docs, labels.limit(0)) is None and T.fit(docs, labels.where("toxic = 1")) is None
    assert {r.toxicity for r in T.score(docs, None).collect()} == {0.0}
    alone = T.score_column(model, pa.array(["scum idiot"]))
    assert alone[0] == T.score_column(model, pa.array(["x", "scum idiot", None]))[1]


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fitting_holds_little_more_than_the_texts():
    """The driver's memory is what ends a run of the pipeline."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (4000, 7))])
    y = np.arange(2400) % 2
    texts = [" ".join(rng.choice(words[1000 * v : 1000 * v + 3000], 400)).encode() for v in y]  # a fourth of the words is of one class alone
    data, offs = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    best, used = peak_mb(lambda: T.mine(data, offs, y))
    own = {int(b) for w in words[3000:] for b in T.grams(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, 7]))[1]}
    assert len(best) >= T.VOTERS // 6 and np.isin(best, list(own)).all()
    assert used < 9 * len(data) / 1e6 + 40  # 151 MB on these 7.7 when all grams were in one piece, now 56
    model = T.LabelModel(np.arange(200), np.full(24, 1 / 24), np.log(np.full((24, 200, T.LEVELS), 1 / T.LEVELS)), np.arange(24) < 6, np.zeros((2, 200)), np.eye(200))
    post, used = peak_mb(lambda: model.posterior(np.zeros((4000, 200))))
    assert np.allclose(post, 0.25) and used < 40  # a number for each kind, text and family takes 154


def test_parts_are_bounded_by_texts_and_bytes():
    size = np.array([0, 5, T.PART_BYTES - 5, 1, 3 * T.PART_BYTES, 0] + [1] * 250)
    parts = list(T._parts(np.concatenate([[0], np.cumsum(size)])))
    assert [i for i, _ in parts] == [0] + [j for _, j in parts[:-1]] and parts[-1][1] == len(size)
    assert all(j - i == 1 or (j - i <= T.PART_TEXTS and size[i:j].sum() <= T.PART_BYTES) for i, j in parts)
    assert list(T._parts(np.array([0]))) == []
