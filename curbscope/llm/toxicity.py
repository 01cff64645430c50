"""Toxicity: classifier chains.

Categories are predicted one after the other. Each has a linear model
(logistic regression) over the features of the text and the probabilities of
the categories before it. For training, those earlier probabilities are
out-of-fold: every labelled row is predicted by a model that has not seen it,
so later models learn how far to trust what they will get.

Features are present or not: words, beginnings of words (so that other
endings of a known stem count), n-grams of long runs of letters and of scripts
without spaces, runs of punctuation and repeated words. The
models are fitted on a bounded, documented sample of labelled rows (about
``sample_rows``, chosen by a hash) and use at most ``max_features`` features
for each category, those whose share among its positive rows deviates most.
All texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col

SAMPLE_ROWS = 12_000
MAX_FEATURES = 1_500
#: Least number of rows with a feature, and least deviation in standard errors.
LEAST_ROWS, LEAST_Z = 4, 4.0
PREFIXES = (3, 4, 5, 6, 7, 8)
FOLDS = 3
#: Words whose features a worker keeps.
CACHE = 150_000
PARTS = re.compile(r"([^\W_]+)|([^\w\s]+)")
#: Characters of a word that is one feature, and of a run of marks.
LONGEST, MARKS = 32, 4
#: Thai to Myanmar, Khmer, kana and Han: scripts that set no spaces between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")

#: Category, label column and the label that is positive, in chain order.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def word_features(word: str) -> set[str]:
    """Features of a run of characters that are no white space, all of it. A
    long run of letters, or one in a script without spaces, has its n-grams all
    along, under the names of beginnings of words."""
    out: set[str] = set()
    for part in PARTS.finditer(word):
        letters, marks = part.groups()
        if marks:
            out.update(f"p:{marks[k:k + MARKS]}" for k in range(max(1, len(marks) - MARKS + 1)))
            continue
        out.add("w:" + letters[:LONGEST])
        if len(letters) > LONGEST or UNSPACED.search(letters):
            out.update(f"{n}:{letters[k:k + n]}" for n in (2, *PREFIXES) for k in range(len(letters) - n + 1))
        else:
            out.update(f"{n}:{letters[:n]}" for n in PREFIXES if len(letters) >= n)
    return out


class Features:
    """Numbers of the known features of texts."""

    def __init__(self, names: list[str] | None):
        self.number = None if names is None else {f: k for k, f in enumerate(names)}
        self.kept: dict[str, tuple] = {}

    def of_word(self, word: str) -> tuple:
        found = self.kept.get(word)
        if found is None:
            found = tuple(word_features(word))
            if self.number is not None:
                found = tuple(self.number[f] for f in found if f in self.number)
            if len(self.kept) >= CACHE:
                self.kept.clear()
            if len(word) <= 48:
                self.kept[word] = found
        return found

    def __call__(self, text: str | None) -> set:
        words = (text or "").lower().split()
        out: set = set()
        get = self.kept.get
        for w in set(words):
            found = get(w)
            if found is None:
                found = self.of_word(w)
            if found:
                out.update(found)
        repeats = sum(map(str.__eq__, words, words[1:]))
        if repeats * 4 > len(words):
            if self.number is None:
                out.add("r:")
            elif "r:" in self.number:
                out.add(self.number["r:"])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, n_features: int,
        l2: float = 1.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated gradient steps: weights of the
    present features, of the ``dense`` columns, and the intercept. Features
    are scaled by their log odds ratio in these rows, so that rare but clear
    ones carry weight."""
    at = np.concatenate([np.full(len(r), k) for k, r in enumerate(rows)]) if rows else np.array([], int)
    item = np.concatenate(rows) if rows else np.array([], int)
    m, d = len(y), dense.shape[1]
    if not m or y.min() == y.max():
        p = float(np.clip(y.mean() if m else 0.0, 1e-6, 1 - 1e-6))
        return np.zeros(n_features), np.zeros(d), float(np.log(p / (1 - p)))
    with_, pos = np.bincount(item, minlength=n_features), np.bincount(item, y[at], minlength=n_features)
    scale = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((with_ - pos + 0.5) / (m - y.sum() + 1))
    x = scale[item]
    # Bounds of the curvature by column: frequent features move less.
    widest = max(1.0, np.sqrt((np.bincount(at, x * x, minlength=m) ** 2).mean()))
    share = np.concatenate((np.bincount(item, x * x, minlength=n_features), np.full(d + 1, float(m)))) / m
    step = 4.0 / (np.sqrt(share * widest) + share + l2 / m)
    w = np.zeros(n_features + d + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(at, v[item] * x, minlength=m) + dense @ v[n_features:-1] + v[-1]
        err = (sigmoid(z) - y) / m
        g = np.concatenate((np.bincount(item, err[at] * x, minlength=n_features), dense.T @ err, [err.sum()]))
        g[:-1] += l2 / m * v[:-1]
        return float((np.logaddexp(0, z) - y * z).mean() + l2 / m / 2 * (v[:-1] ** 2).sum()), g

    ahead, t, rate, last = w.copy(), 1.0, 1.0, np.inf
    for _ in range(steps):
        now, grad = loss(ahead)
        if now > last:  # too far: smaller steps, and the momentum starts anew
            rate, t, ahead, last = rate / 2, 1.0, w.copy(), np.inf
            continue
        last = now
        new = ahead - rate * step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:n_features] * scale, w[n_features:-1], float(w[-1])


def linear(rows: list[np.ndarray], dense: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    w, v, b = model
    return sigmoid(np.array([w[r].sum() for r in rows]) + dense @ v + b) if rows else np.array([])


class Chain:
    """The fitted models, in order. ``rows``: numbers of the present features
    of each labelled row; ``labels``: a 0/1 column for each category."""

    def __init__(self, names: list[str], rows: list[np.ndarray], labels: np.ndarray):
        self.names, self.models = names, []
        fold = np.arange(len(rows)) % FOLDS
        earlier = np.zeros((len(rows), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            self.models.append(fit(rows, earlier, y, len(names)))
            out = np.zeros(len(rows))
            for k in range(FOLDS):
                rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                m = fit([rows[i] for i in rest], earlier[rest], y[rest], len(names))
                out[own] = linear([rows[i] for i in own], earlier[own], m)
            earlier = np.column_stack((earlier, out))

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for m in self.models:
            earlier = np.column_stack((earlier, linear(rows, earlier, m)))
        return earlier


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Chain:
    """The chain of the labelled rows. Rows without an id, a text or one of
    the labels are left out; of several label rows of an id, the one with the
    smallest labels counts."""
    marks = [(col(c).cast("int") == v).cast("int").alias(f"y{k}") for k, (_, c, v) in enumerate(chain)]
    names = [f"y{k}" for k in range(len(chain))]
    known = labels.select(col(id_col).cast("long").alias("id"), *marks).dropna()
    known = known.groupBy("id").agg(*[F.min(y).alias(y) for y in names])
    n = known.count()
    u = (F.xxhash64("id", F.lit("toxicity")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    known = known.where(u < sample_rows / max(n, 1))
    own = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).dropna()
    own = own.where(u < sample_rows / max(n, 1))  # before the join: other texts need no shuffle
    sample = common.held(own.join(known, "id").dropDuplicates(["id"]).select("id", "text", *names))
    totals = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(y), F.lit(0)) for y in names]).first()
    m, positive = totals[0], totals[1:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(None)
        held = [Counter() for _ in range(len(names) + 1)]

        def out() -> pa.RecordBatch:
            keys = list(held[0])
            return pa.record_batch(
                [pa.array(keys, pa.string()), *[pa.array([h[k] for k in keys], pa.int64()) for h in held]],
                names=["feature", "n", *names])

        for b in common.slices(batches, 64):
            for text, *ys in zip(*[b.column(k).to_pylist() for k in range(1, 2 + len(names))]):
                found = features(text)
                held[0].update(found)
                for h, y in zip(held[1:], ys):
                    if y:
                        h.update(found)
            if len(held[0]) > 400_000:
                yield out()
                held = [Counter() for _ in held]
        yield out()

    schema = "feature string, n long, " + ", ".join(f"{y} long" for y in names)
    counted = sample.mapInArrow(count, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    counted = counted.where(F.col("n") >= LEAST_ROWS)
    chosen: set[str] = set()
    z_of = []
    for y, k in zip(names, positive):
        p = min(max(k / max(m, 1), 1e-6), 1 - 1e-6)
        z_of.append(F.abs(F.col(y) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)))
    scored = common.held(counted.select("feature", *[z.alias(f"z{k}") for k, z in enumerate(z_of)]))
    for k in range(len(names)):
        best = scored.where(F.col(f"z{k}") >= LEAST_Z).orderBy(F.col(f"z{k}").desc(), "feature").limit(max_features)
        chosen |= {r["feature"] for r in best.select("feature").collect()}
    features = sorted(chosen)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(features)
        for b in common.slices(batches, 64):
            found = [sorted(of(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]],
                                  names=["id", "present", *names])

    rows = sample.mapInArrow(present, "id long, present array<int>, " + ", ".join(f"{y} int" for y in names))
    rows = rows.orderBy("id").collect()
    return Chain(features, [np.array(r["present"], dtype=np.int64) for r in rows],
                 np.array([[r[y] for y in names] for r in rows], dtype=np.int64).reshape(len(rows), len(names)))


def toxicity(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.3, **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_<category> for each category of
    the chain, and toxic: whether the last category's probability reaches
    ``threshold``.

    Null and empty texts have no features: they get what the intercepts say.
    With no labelled row, or only one label value, a category's probability
    is that value's share. Repeated rows give repeated rows; other columns
    are not read; an empty table gives an empty result.
    """
    model = train(docs, labels, chain, id_col, text_col, **limits)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c, _, _ in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = Features(m.names)
        for b in common.slices(batches):
            rows = [np.array(sorted(of(t)), dtype=np.int64) for t in b.column(1).to_pylist()]
            p = m.predict(rows)
            yield pa.record_batch(
                [b.column(0), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= threshold)],
                names=["doc_id", *names, "toxic"])

    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
