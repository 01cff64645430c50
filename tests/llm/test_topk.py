import math
import random

import numpy as np
import pytest

from curbscope.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k=20, every=20):
    own = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in own:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in own if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, c int, asks string, rank int")


def cases():
    rng = random.Random(1)
    plain = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(120)]
    ties = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(90)]
    odd = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [NAN, 1.0]), (60, [INF, 1.0]), (80, [None, 1.0]), (None, [1.0, 1.0]),
           (3, [0.0, 0.0]), (100, []), (4, [1.0]), (5, [-1.0, 3.0, 9.0]), (0, [0.5, 0.5])]
    return [plain, ties, odd, [(0, [1.0])], []]


@pytest.mark.parametrize("rows", cases())
def test_equals_brute_force(spark, rows, monkeypatch):
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == brute(rows)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows, "double")).collect())) == brute(rows)


@pytest.mark.parametrize("size", [1, 2**10, 2**24, 2**30])
def test_accumulation_is_exact(size):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-size, size + 1, (300, 12)), rng.integers(-size, size + 1, (7, 12))
    x[:, 3:6] *= rng.random((300, 3)) < 0.1  # sparse postings
    terms = topk.postings(list(x))
    assert min(len(i) for i, _ in terms) < 100
    assert (topk.accumulate(q, terms, 300) == q @ x.T).all()
