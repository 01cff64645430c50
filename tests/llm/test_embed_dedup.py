import numpy as np
import pytest

from curbscope.llm import embed_dedup

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                linked[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(linked[k]), first, i is not None and i == first))
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, copies int, key string")


def groups(n=150, dims=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dims))
    return [(k, [float(x) for x in np.float32(centres[rng.integers(len(centres))] + rng.normal(size=dims) * 0.08)]) for k in range(n)]


ODD = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [NAN, 1.0]), (7, [INF, 1.0]),
       (8, [None, 1.0]), (None, [1.0, 0.01]), (None, None), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 5.0]), (12, [0.0, 5.0])]


@pytest.mark.parametrize("rows", [groups(), ODD, [(1, [1.0])], []])
def test_equals_brute_force(spark, rows, monkeypatch):
    got = embed_dedup.embedding_groups(vectors(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    monkeypatch.setattr(embed_dedup, "TILE", 4)  # hot buckets in many tiles
    got = embed_dedup.embedding_groups(vectors(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in (1_000, 60_000, 10**8):
        k, tables = embed_dedup.parameters(n, 0.9, embed_dedup.WIDTH, embed_dedup.RECALL)
        a = rng.normal(size=(400, 32))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.normal(size=(400, 32))
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.9 * a + np.sqrt(1 - 0.81) * b
        x, y = (embed_dedup.signatures(v, k, tables, embed_dedup.WIDTH, 7) for v in (a, b))
        assert (x == y).any(axis=1).mean() >= 0.93
