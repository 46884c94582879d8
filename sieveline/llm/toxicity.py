"""Toxicity by weak supervision.

1. Voters, which vote toxic or abstain.  General ones come from no label: families of abusive
   words in four languages, and patterns of address, repetition, capitals and marks, which vote
   where they stand out from what is usual.  Induced ones are entries of a lexicon of 5-byte
   grams of normalised text (lower case; runs of ASCII other than letters and digits become one
   space), which tell apart the labelled toxic and clean texts of two thirds of the sample.
2. Label model.  The other third's labels are looked at only to name its result: a generative
   model with latent kinds of text explains the votes on it.  Each kind has its probabilities of
   how many voters of a family vote, silence included.  So voters that vote together, as those of
   one language do, are one kind's evidence; those that correlate within the kinds as well are one
   family, and what they repeat counts once.  Expectation maximisation fits it; the labels
   then tell which kinds are toxic.  So each voter's accuracy and the correlations are estimated.
3. Classifier.  A logistic regression over the log rates of the lexicon's grams and the votes is
   trained on the label model's posteriors, not on the labels.

Fitting reads at most ``TRAIN_ROWS`` labelled texts, chosen by a hash of the id, on the driver.
Scoring is one pass over all bytes of every text.

Defined results: nulls count as empty; an empty text gets the classifier's bias and abstentions
alone.  Without labelled rows of both kinds every score is 0.  Repeated rows get the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.sampling import fold, labelled_sample
from sieveline.llm.textkit import blocks, without

TRAIN_ROWS = 7000
VOTERS = 240
GRAM = 5
BITS = 20

#: ASCII letters and digits and all bytes of other characters stay; the rest become spaces.
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each gram, its bucket, bytes of each normalised text); every text gets a space on either side."""
    b = _NORMAL[data]
    n = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (owner[1:] != owner[:-1])
    b, owner = b[keep], owner[keep]
    size = np.bincount(owner, minlength=n)
    # GRAM - 1 spaces between texts: a gram that reaches into them ends its text
    at = np.arange(len(b)) + owner.astype(np.int64) * (GRAM - 1) + 1
    wide = np.full(len(b) + n * (GRAM - 1) + GRAM, 32, dtype=np.uint8)
    wide[at] = b
    begins = np.concatenate([[0], np.cumsum(size)])[:-1] + np.arange(n) * (GRAM - 1)
    code = np.zeros(len(wide) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        code |= wide[k : len(wide) - GRAM + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
    text = np.searchsorted(begins, np.arange(len(code)), side="right") - 1 if n < 2 else None
    if text is None:
        mark = np.zeros(len(code), dtype=np.int32)
        ok = begins[1:] < len(code)
        np.add.at(mark, begins[1:][ok], 1)
        text = np.cumsum(mark)
    return text, bucket, size


@dataclass
class Model:
    slot: np.ndarray  # bucket -> feature, or -1
    weight: np.ndarray
    bias: float
    voters: list[dict]
    correlation: np.ndarray


def features(slot: np.ndarray, n_features: int, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """log(1 + 1000 * rate a byte) of each feature's gram in each text."""
    n = len(offs) - 1
    text, bucket, size = grams(data, offs)
    which = slot[bucket]
    hit = which >= 0
    counts = np.bincount(text[hit].astype(np.int64) * n_features + which[hit], minlength=n * n_features)[: n * n_features]
    return np.log1p(1000.0 * counts.reshape(n, n_features) / np.maximum(size, 200)[:, None])


#: Texts that are looked at together while a model is fitted: so many, or so many bytes, at most.
PART_TEXTS, PART_BYTES = 100, 1 << 20


def _parts(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """(i, j) of texts i to j - 1, part by part; one text at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(i + PART_TEXTS, n, max(i + 1, int(np.searchsorted(offs, offs[i] + PART_BYTES, side="right")) - 1))
        yield i, j
        i = j


def _rates(data: np.ndarray, offs: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, log rate) of the grams of texts i to j - 1, by text and bucket."""
    part = offs[i : j + 1]
    text, bucket, size = grams(data[part[0] : part[-1]], part - part[0])
    key, count = np.unique(text.astype(np.int64) << BITS | bucket, return_counts=True)
    t = (key >> BITS).astype(np.int32)
    return t + np.int32(i), (key & ((1 << BITS) - 1)).astype(np.int32), np.log1p(1000.0 * count / np.maximum(size, 200)[t]).astype(np.float32)


def mine(data: np.ndarray, offs: np.ndarray, y: np.ndarray, top: int = VOTERS, rounds: int = 6) -> np.ndarray:
    """The buckets whose log rates differ most between the classes, by their t statistic.

    By sequential covering: what one round's best grams explain is set aside, so that kinds of
    toxic text which have little in common each get entries of their own.
    """
    # which grams are more frequent in toxic texts at all; only those are held, and summed up part by part
    seen = np.zeros((2, 1 << BITS), dtype=np.int32)
    for i, j in _parts(offs):
        t, b, _ = _rates(data, offs, i, j)
        for c in (0, 1):
            np.add.at(seen[c], b[y[t] == c], 1)
    n_texts = np.maximum(np.bincount(y, minlength=2), 1)
    telling = np.flatnonzero((seen[1] >= 3) & (seen.sum(0) >= 5) & (seen[1] / n_texts[1] >= seen[0] / n_texts[0]))
    del seen
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[telling] = np.arange(len(telling))
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # first text, grams of each text, their places in telling, log rates
    for i, j in _parts(offs):
        t, b, v = _rates(data, offs, i, j)
        keep = place[b] >= 0
        held.append((i, np.bincount(t[keep] - i, minlength=j - i), place[b[keep]], v[keep]))
    del place
    text_of = lambda i, size: np.repeat(np.arange(i, i + len(size)), size)
    live = np.ones(len(y), dtype=bool)
    chosen: list[int] = []
    for _ in range(rounds):
        sums = np.zeros((2, 2, len(telling)))
        for i, size, b, v in held:
            t = text_of(i, size)
            for c in (0, 1):
                of = ((y == c) & live)[t]
                for k in (0, 1):
                    np.add.at(sums[c, k], b[of], (v[of] ** (k + 1)).astype(float))
        n = [max(1, int(((y == c) & live).sum())) for c in (0, 1)]
        mean = [sums[c, 0] / n[c] for c in (0, 1)]
        var = [np.maximum(sums[c, 1] / n[c] - mean[c] ** 2, 0) for c in (0, 1)]
        score = (mean[1] - mean[0]) / np.sqrt(var[1] / n[1] + var[0] / n[0] + 1e-4)
        score[chosen] = 0
        best = [int(g) for g in np.argsort(-score, kind="stable")[: top // rounds] if score[g] > 4.0]
        if not best:
            break
        chosen += best
        strong = best[:10]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in strong]
        for i, size, b, v in held:
            t = text_of(i, size)
            for k, g in enumerate(strong):
                of = b == g
                found[k].append((t[of], v[of]))
        for pairs in found:  # a strong entry accounts for the toxic texts in which it is as frequent as in few clean ones
            t, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            clean = np.sort(v[y[t] == 0])
            bar = clean[max(0, len(clean) - 1 - n[0] // 50)] if len(clean) > n[0] // 50 else 0.0
            hit = t[v > bar]
            live[hit[y[hit] == 1]] = False
    return telling[chosen].astype(np.int64)


#: Words of abuse in general use, a family for each language.
ABUSE = {
    "en": "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown clowns dumb fool fools ugly jerk creep liar coward garbage filthy shut",
    "de": "idiot idioten dumm blöd trottel versager abschaum müll erbärmlich wertlos widerlich ekelhaft arschloch lügner feigling dreck",
    "fr": "idiot idiote stupide crétin imbécile minable ordure déchet pathétique dégoûtant clown menteur lâche connard salaud",
    "es": "idiota idiotas estúpido estúpida imbécil basura escoria patético asqueroso payaso inútil mentiroso cobarde tonto perdedor",
}
#: Words by which a reader is addressed.
SECOND = frozenset("you your yours yourself du dich dein euch euer tu toi ton vous votre te tú tus usted vosotros".split())
_ABUSE = {lang: frozenset(words.split()) for lang, words in ABUSE.items()}
_WORD = re.compile(r"\w+")


def general(text: str) -> list[float]:
    """What the general voters look at: shares of abusive words by language, of words that address, repeat or shout, and of marks that shout."""
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n = max(len(words), 20)
    shout = sum(len(w) > 3 and w.isupper() for w in words)
    marks = sum(text.count(c) for c in "!?*#$%&@")
    twice = sum(a == b for a, b in zip(low, low[1:], strict=False))
    return [*(sum(w in family for w in low) / n for family in _ABUSE.values()), sum(w in SECOND for w in low) / n, twice / n, shout / n, marks / max(len(text), 100)]


GENERAL = (*(f"abuse_{lang}" for lang in ABUSE), "address", "repeats", "capitals", "marks")


#: Of the texts on which an induced voter votes, so many at least must be toxic where it comes from.
SOUND = 0.5


def thresholds(x: np.ndarray, extra: np.ndarray, y: np.ndarray) -> list[dict]:
    """Each voter's kind and the value from which on it votes: induced entries part the labels best there, general voters stand out there from what is usual.

    Induced voters that are wrong more often than right are left out.
    """
    voters = []

    def add(kind: str, value: np.ndarray, name) -> None:
        grid = np.unique(np.quantile(value[value > 0], np.linspace(0, 0.9, 10))) if (value > 0).any() else [1e9]
        best = max(grid, key=lambda t: ((value >= t) & (y == 1)).sum() / max(1, (y == 1).sum()) - 3 * ((value >= t) & (y == 0)).sum() / max(1, (y == 0).sum()))
        votes = value >= best
        if y[votes].sum() - 1 >= SOUND * (votes.sum() + 1):  # one text more or less must not decide
            voters.append({"kind": kind, "name": name, "threshold": float(best)})

    for j in range(x.shape[1]):
        add("lexicon", x[:, j], j)
    for j, name in enumerate(GENERAL):
        usual = float(np.quantile(extra[:, j], 0.95)) if len(extra) else 0.0
        voters.append({"kind": "general", "name": name, "threshold": max(usual * 1.5, 1e-9)})
    return voters


def fired(x: np.ndarray, extra: np.ndarray, voters: list[dict]) -> np.ndarray:
    """The 0/1 matrix of votes of voters on texts with features x and general features extra; 0 is an abstention."""
    value = {"lexicon": lambda j: x[:, j], "general": lambda name: extra[:, GENERAL.index(name)]}
    return np.array([value[v["kind"]](v["name"]) >= v["threshold"] for v in voters], dtype=float).reshape(len(voters), len(x)).T


@dataclass
class LabelModel:
    """P(votes, kind of text): kinds are latent; each family of voters says how many of it voted, up to LEVELS - 1."""

    families: np.ndarray  # each voter's family
    share: np.ndarray  # of each kind
    emission: np.ndarray  # kinds x families x LEVELS, log probabilities
    toxic: np.ndarray  # whether a kind is toxic
    rate: np.ndarray  # 2 x voters: probability of a vote from clean and from toxic texts
    correlation: np.ndarray  # of the votes within clean and within toxic texts

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Posterior probabilities of the kinds; silence of a family counts as what it is."""
        level = levels(votes, self.families)
        say = np.zeros((len(votes), len(self.share)))
        for i in range(0, len(votes), PART_TEXTS):  # a number for each kind, text and family
            part = level[i : i + PART_TEXTS]
            say[i : i + PART_TEXTS] = np.log(self.share)[None] + self.emission[:, np.arange(part.shape[1])[None], part].sum(-1).T
        say -= say.max(1, keepdims=True)
        p = np.exp(say)
        return p / p.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.kinds(votes)[:, self.toxic].sum(1)


LEVELS = 4
#: Kinds of text at most.  Correlations from which on two voters are one family, within kinds, and from which on they may speak of one kind, over all texts.
KINDS, REPEATS, TOGETHER = 24, 0.3, 0.35
#: Kinds that are split because they hold both toxic and clean texts, at most.
SPLITS = 6


def levels(votes: np.ndarray, families: np.ndarray) -> np.ndarray:
    """How many voters of each family vote on each text, up to LEVELS - 1."""
    sums = np.zeros((len(votes), int(families.max(initial=-1)) + 1))
    np.add.at(sums.T, families, votes.T)
    return np.minimum(sums, LEVELS - 1).astype(int)


def joined(near: np.ndarray) -> np.ndarray:
    """The number of the group of each voter, voters that are near being one group."""
    group = np.arange(len(near))
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        group[group == group[j]] = group[i]
    return np.unique(group, return_inverse=True)[1]


def correlations(votes: np.ndarray) -> np.ndarray:
    """Of the voters over all texts; 0 for those that always or never vote."""
    corr = np.zeros((votes.shape[1],) * 2)
    some = np.flatnonzero(votes.std(0) > 0)
    if len(some):
        corr[np.ix_(some, some)] = np.atleast_2d(np.corrcoef(votes[:, some].T))
    return corr


def _first_kinds(votes: np.ndarray, most: int) -> np.ndarray:
    """A first guess of each text's kind: 0 where no voter votes, else the group of voters that vote together, of which most do."""
    group = joined(correlations(votes) > TOGETHER)
    size, support = np.bincount(group), np.bincount(group, votes.sum(0))
    groups = [g for g in np.lexsort((-support, -size))[: most - 1] if support[g]]
    if not groups:
        return np.zeros(len(votes), dtype=int)
    say = np.stack([votes[:, group == g].sum(1) for g in groups], axis=1)
    return np.where(say.max(1) > 0, say.argmax(1) + 1, 0)


def _within(post: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter votes on texts of each kind, and the correlations within the kinds."""
    mean = (post.T @ votes + 0.5 * votes.mean(0)) / (post.sum(0)[:, None] + 0.5)
    rest = votes - post @ mean
    cov = rest.T @ rest / len(votes)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return mean, cov / np.outer(sd, sd)


def _fitted(votes: np.ndarray, start: np.ndarray, families: np.ndarray, rounds: int):
    """(families, share, emission, posterior) by expectation maximisation from a first guess of the kinds, with families joined until no voters correlate within the kinds."""
    n, kinds = len(votes), int(start.max()) + 1
    while True:
        one_hot = np.eye(LEVELS)[levels(votes, families)]  # n x families x LEVELS
        usual = (one_hot.sum(0) + 0.5) / (n + 0.5 * LEVELS)
        post = 0.9 * np.eye(kinds)[start] + 0.1 / kinds
        for _ in range(rounds):
            share = (post.sum(0) + 1) / (n + kinds)
            count = np.einsum("nc,nfl->cfl", post, one_hot) + 2.0 * usual[None]
            emission = np.log(count / count.sum(-1, keepdims=True))
            say = np.log(share)[None] + np.einsum("nfl,cfl->nc", one_hot, emission)
            say -= say.max(1, keepdims=True)
            new = np.exp(say)
            new /= new.sum(1, keepdims=True)
            done = np.abs(new - post).max() < 1e-5
            post = new
            if done:
                break
        merged = joined((_within(post, votes)[1] > REPEATS) | (families[:, None] == families[None]))
        if merged.max(initial=-1) == families.max(initial=-1):
            return families, share, emission, post
        families = merged


def label_model(votes: np.ndarray, noted: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """The generative model fitted to votes by expectation maximisation.

    What voters repeat of one another is explained by kinds of text on which they vote together;
    voters that still correlate within the kinds are put into one family, and the model is fitted
    again, until none do.  Labels are no votes: noted (1, 0, or -1 where unknown) only
    tells which kinds are toxic, and which hold both and are split; without it those kinds are
    toxic, from which most voters vote more often than from the largest kind.
    """
    families = np.arange(votes.shape[1])
    start = np.unique(_first_kinds(votes, KINDS), return_inverse=True)[1]
    known = np.flatnonzero(noted >= 0) if noted is not None else np.zeros(0, dtype=int)
    for _ in range(SPLITS + 1):
        families, share, emission, post = _fitted(votes, start, families, rounds)
        kind = post.argmax(1)
        size = np.bincount(kind[known], minlength=len(share))
        bad = np.bincount(kind[known], noted[known] == 1, minlength=len(share)) if len(known) else size
        mixed = np.flatnonzero((np.minimum(bad, size - bad) >= 3) & (np.minimum(bad, size - bad) > 0.05 * size))
        if not len(mixed):
            break
        # a kind that holds both: the texts on which its most telling voter votes become another
        c = mixed[np.argmax(np.minimum(bad, size - bad)[mixed])]
        mine_ = known[kind[known] == c]
        gap = np.abs(votes[mine_][noted[mine_] == 1].mean(0) - votes[mine_][noted[mine_] == 0].mean(0))
        start = np.where((kind == c) & (votes[:, gap.argmax()] > 0), len(share), kind)
        start = np.unique(start, return_inverse=True)[1]
    mean, _ = _within(post, votes)
    if len(known):
        # a kind without labelled texts is as toxic as all of them are
        toxic = (bad + (noted[known] == 1).mean()) / (size + 1) > 0.5
    else:
        toxic = (mean > mean[post.sum(0).argmax()]).mean(1) > 0.5
    p = post[:, toxic].sum(1)
    rate, corr = _within(np.stack([1 - p, p], axis=1), votes)
    return LabelModel(families, share, emission, toxic, np.clip(rate, 1e-6, 1 - 1e-6), corr)


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with an L2 penalty; targets are probabilities."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (target - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """Where the log odds z part the classes best: the middle of the gap with most texts on their own side."""
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order]
    good = np.concatenate([[0], np.cumsum(~toxic)]) + toxic.sum() - np.concatenate([[0], np.cumsum(toxic)])
    at = np.flatnonzero(good == good.max())
    at = at[len(at) // 2]
    lo, hi = z[max(at - 1, 0)], z[min(at, len(z) - 1)]
    return float((lo + hi) / 2)


def train(rows: list[tuple[str, int]]) -> Model | None:
    """The model fitted to (text, 0 or 1) pairs.

    Voters are induced from two thirds of the texts and their labels; the label model sees the
    votes on the others, and of all texts only what it believes goes to the classifier.
    """
    y = np.array([int(v) for _, v in rows])
    if len(set(y.tolist())) < 2:
        return None
    raw = [t.lower().encode() for t, _ in rows]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    del raw
    dev = np.zeros(len(y), dtype=bool)
    for label in (0, 1):  # two thirds of either kind
        at = np.flatnonzero(y == label)
        dev[at[np.arange(len(at)) % 3 < 2]] = True
    size = np.diff(offs)
    best = mine(data[np.repeat(dev, size)], np.concatenate([[0], np.cumsum(size[dev])]), y[dev])
    slot = np.full(1 << BITS, -1, dtype=np.int16)
    slot[best] = np.arange(len(best))
    x = np.vstack([features(slot, len(best), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in _parts(offs)]) if len(best) else np.zeros((len(y), 0))
    extra = np.array([general(t) for t, _ in rows])
    voters = thresholds(x[dev], extra, y[dev])
    votes = fired(x, extra, voters)
    rest = ~dev if (~dev).any() else dev
    believed = label_model(votes[rest], np.where(dev, y, -1)[rest] if dev[rest].any() else y[rest])
    post = believed.posterior(votes)
    z = np.hstack([x, votes])
    weight, bias = logistic(z, post)
    if 0 < (post > 0.5).sum() < len(post):  # else there is nothing to part
        bias -= cut(z @ weight + bias, post > 0.5)
    share = post.mean()
    for v, r0, r1, family in zip(voters, *believed.rate, believed.families.tolist(), strict=True):
        v |= {"fires_clean": float(r0), "fires_toxic": float(r1), "accuracy": float(share * r1 / (share * r1 + (1 - share) * r0)), "family": family}
    return Model(slot, weight, bias, voters, believed.correlation)


def score_column(model: Model | None, column) -> np.ndarray:
    out = np.zeros(len(column))
    if model is None:
        return out
    lowered = pa.compute.utf8_lower(column)
    n_features = len(model.weight) - len(model.voters)
    for i, j, data, offs in blocks(lowered):
        x = features(model.slot, n_features, data, offs) if n_features else np.zeros((j - i, 0))
        extra = np.array([general(t or "") for t in column.slice(i, j - i).to_pylist()])
        z = model.bias + np.hstack([x, fired(x, extra, model.voters)]) @ model.weight
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with toxicity, a probability."""
    docs = without(docs, "toxicity")
    names = docs.columns
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["toxicity double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score_column(model, batch.column(text)))], names=[*names, "toxicity"])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most rows labelled documents outside the held-out fold."""
    inside = fold(F.col("doc_id"), folds) != held_out
    return train(labelled_sample(docs.select("doc_id", "text").where(inside), labels.where(inside).select("doc_id", F.col("toxic").alias("label")), rows=rows))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
