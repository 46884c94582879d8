"""Language identification by a convolutional network over bytes.

Fixed-length windows of a text's UTF-8 bytes are embedded, convolved with filters of
several widths, max-pooled over the window and classified by a softmax layer.  Training
(Adam, plain numpy) runs on the driver over a bounded sample of labelled texts; every
window of every text is classified, and a text's class has the largest mean log
probability, weighted by the windows' bytes.

A text's score depends on its own bytes alone: windows end in zeros behind a text, and are
multiplied in slices of one shape, so that neighbours in a batch change nothing.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does every
text if there is no labelled row to learn from.  Repeated rows get the same; ties go to the
language that sorts first; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.sampling import fold, labelled_sample
from sieveline.llm.textkit import blocks, without

WINDOW = 256
DIM = 8
#: Filters by width; the widest is REACH bytes.
FILTERS = {2: 8, 3: 12, 4: 12}
REACH = 4
#: Labelled texts that the network is trained on, at most; every window of each is used.
TRAIN_ROWS = 2000
#: Windows that are classified together; a constant shape, so that a score is the same in any batch.
SLICE = 64


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # REACH * DIM x filters; rows beyond a filter's width are 0
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray


def _mask() -> np.ndarray:
    cols = [np.repeat([1.0, 0.0], [w * DIM, (REACH - w) * DIM]) for w, n in FILTERS.items() for _ in range(n)]
    return np.array(cols, dtype=np.float32).T


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW + REACH bytes, each window's text and number of its own bytes.

    A row ends with the first bytes of its text's next window, so that grams across windows are
    seen once; behind a text's end there are zeros, never another text.
    """
    size = np.diff(offs)
    count = np.maximum(1, -(-(size + REACH - 1) // WINDOW))
    first = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    flat = np.zeros(first[-1] * WINDOW, dtype=np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offs[:-1], size)] = data
    owner = np.repeat(np.arange(len(size)), count)
    rows = np.zeros((first[-1], WINDOW + REACH), dtype=np.uint8)
    rows[:, :WINDOW] = flat.reshape(-1, WINDOW)
    rows[:-1, WINDOW:-1] = np.where((owner[1:] == owner[:-1])[:, None], rows[1:, : REACH - 1], 0)
    used = np.clip(size[owner] - (np.arange(first[-1]) - first[owner]) * WINDOW, 0, WINDOW)
    return rows, owner, used


def log_probs(model: Model, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of each window, in slices that stay in cache."""
    out = np.empty((len(rows), len(model.langs)), dtype=np.float32)
    stride = WINDOW + REACH
    x = np.zeros(SLICE * stride + REACH, dtype=np.uint8)
    for at in range(0, len(rows), SLICE):
        n = min(SLICE, len(rows) - at)
        x[: n * stride] = rows[at : at + n].ravel()
        x[n * stride :] = 0
        e = model.embed[x].ravel()
        best = None
        for phase in range(REACH):  # grams that begin at phase modulo REACH: a reshape, no copy
            grams = e[phase * DIM : (phase + SLICE * stride) * DIM].reshape(-1, REACH * DIM)
            top = (grams @ model.conv).reshape(SLICE, stride // REACH, -1)[:, : WINDOW // REACH].max(axis=1)
            best = top if best is None else np.maximum(best, top)
        z = np.maximum(best + model.bias, 0) @ model.dense + model.out
        z -= z.max(axis=1, keepdims=True)
        out[at : at + n] = (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[:n]
    return out


def train(rows: list[tuple[str, str]], *, epochs: int = 3, least_steps: int = 200, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Model | None:
    """The network fitted to (text, language) pairs, in epochs, and more of them if they have fewer than least_steps steps."""
    rows = [(t, y) for t, y in rows if any(c.isalpha() for c in t)]
    langs = sorted({y for _, y in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t, _ in rows]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    x, owner, used = windows_of(np.frombuffer(b"".join(raw), dtype=np.uint8), offs)
    x, owner = x[used > 0], owner[used > 0]
    y = np.array([langs.index(v) for _, v in rows])[owner]
    mask, n_filters, n_langs = _mask(), sum(FILTERS.values()), len(langs)
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "conv": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(n_filters, dtype=np.float32),
        "dense": rng.normal(0, 0.2, (n_filters, n_langs)).astype(np.float32),
        "out": np.zeros(n_langs, dtype=np.float32),
    }
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    at = np.arange(WINDOW)[:, None] + np.arange(REACH)[None, :]
    for _ in range(max(epochs, -(-least_steps * batch // max(len(x), 1)))):
        order = rng.permutation(len(x))
        for b in range(0, len(x), batch):
            xb, yb = x[order[b : b + batch]], y[order[b : b + batch]]
            n = len(xb)
            grams = xb[:, at]  # n x WINDOW x REACH
            pre = p["embed"][grams].reshape(n, WINDOW, -1) @ p["conv"]
            where = pre.argmax(axis=1)  # n x filters
            pooled = np.take_along_axis(pre, where[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            z = hidden @ p["dense"] + p["out"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), yb] -= 1
            z /= n
            back = (z @ p["dense"].T) * (pooled > 0)
            hit = grams[np.arange(n)[:, None], where]  # n x filters x REACH
            vec = p["embed"][hit].reshape(n, n_filters, -1)
            g = {"dense": hidden.T @ z, "out": z.sum(0), "bias": back.sum(0), "conv": np.einsum("nfd,nf->df", vec, back) * mask, "embed": np.zeros_like(p["embed"])}
            spread = (back[:, :, None] * p["conv"].T[None]).reshape(n, n_filters, REACH, DIM)
            np.add.at(g["embed"], hit, spread)
            t += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(langs, **p)


def predict_columns(model: Model | None, column) -> tuple[list[str], list[float]]:
    """Languages and their probabilities, for an Arrow text column."""
    langs: list[str] = []
    scores: list[float] = []
    for i, j, data, offs in blocks(column):
        if model is None:
            langs += ["und"] * (j - i)
            scores += [0.0] * (j - i)
            continue
        windows, owner, used = windows_of(data, offs)
        lp = log_probs(model, windows) * np.maximum(used, 1)[:, None]
        total = np.zeros((j - i, len(model.langs)))
        np.add.at(total, owner, lp)
        total /= np.maximum(np.bincount(owner, np.maximum(used, 1), j - i), 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        langs += [model.langs[k] for k in best]
        scores += total[np.arange(j - i), best].tolist()
    return langs, scores


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, which take the place of columns of those names."""
    docs = without(docs, "lang_pred", "lang_score")
    kept = docs.columns
    body, lettered = F.col(f"`{text}`"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    packed = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), body.alias("body"), lettered.alias("lettered"))
    kind = packed.schema["row"].dataType.simpleString() if kept else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, scores = predict_columns(model, batch.column("body"))
            langs = [lang if ok else "und" for lang, ok in zip(known, batch.column("lettered").to_pylist(), strict=True)]
            scores = [s if lang != "und" else 0.0 for lang, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "lang_score"])

    out = packed.mapInArrow(run, f"row {kind}, lang_pred string, lang_score double")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "lang_score")


def fit(docs: DataFrame, *, held_out: int = 1, folds: int = 3, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from the text and lang of at most rows documents outside the held-out fold."""
    learn = docs.where(fold(F.col("doc_id"), folds) != held_out)
    return train(labelled_sample(learn, learn.select("doc_id", F.col("lang").alias("label")), rows=rows))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
