import random

import numpy as np
import pytest
from llm_cases import odd_rows

from curbscope.llm import toxicity


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    common = ["w%s%d" % (rng.choice("abcde"), k) for k in range(150)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(60)]
        toxic, low = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "vile" + rng.choice(["st", "r", "ness", "ly", "d"])]))
        if low:
            words = [w + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1 - low, toxic))
    return rows, labels


def test_held_out_rows(spark, make_docs):
    rows, labels = corpus()
    known = spark.createDataFrame(labels[:350], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(make_docs(rows), known)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    found = {r.doc_id: r for r in got.collect()}
    assert sum(found[i].toxic == bool(t) for i, _, t in labels[350:]) / 150 >= 0.98
    assert sum((found[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in labels[350:]) / 150 >= 0.98


def test_later_models_get_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(1)
    first = rng.random(300) < 0.5
    rows = [np.array([int(f) if rng.random() < 0.9 else 2]) for f in first]
    seen, fit = [], toxicity.fit

    def noted(rows_, dense, y, n, **more):
        seen.append((len(y), dense))
        return fit(rows_, dense, y, n, **more)

    monkeypatch.setattr(toxicity, "fit", noted)
    chain = toxicity.Chain(["a", "b", "c"], rows, np.column_stack((first, first)).astype(int))
    second = next(dense for m, dense in seen if m == 300 and dense.shape[1] == 1)
    fold = np.arange(300) % toxicity.FOLDS
    for k in range(toxicity.FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        m = fit([rows[i] for i in rest], np.zeros((len(rest), 0)), first[rest].astype(float), 3)
        assert second[own, 0] == pytest.approx(toxicity.linear([rows[i] for i in own], np.zeros((len(own), 0)), m))
    assert chain.models[0][1].size == 0 and chain.models[1][1].size == 1
    p = chain.predict([np.array([0]), np.array([1])])
    assert p.shape == (2, 2) and p[0, 1] < 0.2 and p[1, 1] > 0.8


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    y = np.array([float(rng.random() < (0.8 if 2 in r else 0.3)) for r in rows])
    w, _, b = toxicity.fit(rows, np.zeros((300, 0)), y, 6, steps=2000)
    x = np.zeros((300, 6))
    for k, r in enumerate(rows):
        x[k, r] = 1
    err = toxicity.sigmoid(x @ w + b) - y
    n, pos = x.sum(0), y @ x
    scale = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((n - pos + 0.5) / (300 - y.sum() + 1))
    assert np.abs((x * scale).T @ err + w / scale).max() < 0.05 and abs(err.sum()) < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (999, 0, 1), (5, 0, 1), (8, 1, 0)]])
def test_odd_rows(spark, make_docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(make_docs(odd_rows()), known).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.toxicity(make_docs([]), known).count() == 0


def test_whole_runs_are_read():
    from curbscope.llm.toxicity import word_features

    for joint in "./_,":
        assert "w:idiot" in word_features(joint.join(["word"] * 200 + ["idiot"]))
    assert "5:idiot" in word_features("x" * 500 + "idiot" + "y" * 500)
    assert "2:馬鹿" in word_features("今日はとても良い天気ですね馬鹿")
    assert "p:#!?&" in word_features("." * 300 + "#!?&")
    assert word_features("hated!") == {"w:hated", "3:hat", "4:hate", "5:hated", "p:!"}
