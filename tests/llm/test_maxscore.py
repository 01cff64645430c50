import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from llm_cases import odd_rows

from curbscope.llm import maxscore

ITEM = "item_id long, text string, doc_id long, q long, terms string, rank int"


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, 1, 2, "t", 3) for i, t in rows], ITEM)

    return make


def cut(text):
    return re.findall(maxscore.TERM, (text or "").translate(str.maketrans(maxscore.UPPER, maxscore.LOWER)))


def by_hand(rows, items, k=50):
    """The definition: every document scored for every item. Rows of one
    item_id are listed under the same id."""
    docs = [(r[0], cut(r[1])) for r in rows]
    docs = [d for d in docs if d[1]]
    n, length = len(docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        found = []
        terms = set(cut(text))
        df = {t: sum(t in d for _, d in docs) for t in terms}
        for i, d in docs:
            score = 0
            for t in terms:
                tf = d.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * len(d) * n // length)))
            if score > 0:
                found.append((-score, i is not None, i or 0))
        for rank, (s, known, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, i if known else None, -s))
    return sorted(out, key=repr)


def drawn(seed=1, n=150):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(60)]
    odds = [1 / (k + 1) for k in range(60)]
    draw = lambda m: " ".join(rng.choices(words, odds, k=m))
    rows = [(i, draw(rng.randrange(40)), "en", "s") for i in range(n)]
    rows += rows[:20] + [(n + i, rows[i][1], "en", "s") for i in range(20)]
    return rows, [(k, draw(rng.randrange(1, 15)).upper()) for k in range(25)] + [(3, "w1 w2"), (None, "w0 w5"), (90, None), (91, "?")]


CASES = [drawn(), (odd_rows(), [(1, "quick brown fox alpha"), (2, "ein 日本語 ü 123"), (3, "x" * 300_000)]),
         ([(1, "a b", "en", "s")], []), ([], [(1, "a")]), ([(1, None, "en", "s")], [(1, "a")])]


@pytest.mark.parametrize("rows,items", CASES)
def test_against_brute_force(make_docs, make_items, rows, items):
    got = maxscore.ranked(make_docs(rows), make_items(items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, items)


def test_sql_says_the_same():
    rows, items = drawn(2)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in rows], columns=["doc_id", "text"]).astype(
        {"doc_id": "Int64", "text": "string"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    assert sorted(con.execute(maxscore.SQL).fetchall(), key=repr) == by_hand(rows, items)


def test_blocks_and_small_shards_give_the_same_rows(make_docs, make_items):
    rows, items = drawn(4, 80)
    docs, bench = make_docs(rows), make_items(items)
    want = by_hand(rows, items, 7)
    assert sorted(map(tuple, maxscore.ranked(docs, bench, k=7, block=30).collect()), key=repr) == want


def made_shard(rng, rows, terms, queries):
    """A shard of random postings, and the exact scores of each query."""
    mass = rng.integers(1, 1000, (rows, terms)) * (rng.random((rows, terms)) < rng.random(terms) * 0.6)
    row, term = np.nonzero(mass)
    q = maxscore.Queries.__new__(maxscore.Queries)
    q.terms = [rng.permutation(terms)[: rng.integers(1, terms)] for _ in range(queries)]
    q = q.weighed(rng.integers(1, 50, terms))
    shard = maxscore.Shard(q, row, term, mass[row, term], rows)
    return shard, q, [mass[:, t].sum(axis=1) for t in q.terms], mass


@pytest.mark.parametrize("trial", range(20))
def test_search_keeps_all_of_the_best(trial):
    rng = np.random.default_rng(trial)
    shard, q, exact, mass = made_shard(rng, int(rng.integers(1, 200)), int(rng.integers(2, 12)), 20)
    for x, (terms, pair) in enumerate(zip(q.terms, q.pair_of)):
        truth = np.sort(exact[x])[::-1]
        for k in (1, 3, 1000):
            for least in (0, int(truth[min(len(truth) - 1, 5)]), int(truth[0]), int(truth[0]) + 1):
                rows, score = maxscore.search_shard(shard, terms, pair, k, least)
                assert np.array_equal(score, exact[x][rows]) and (score > 0).all()
                must = np.flatnonzero(exact[x] >= max(least, 1, int(truth[min(k, len(truth)) - 1])))
                assert set(must) <= set(rows.tolist())
        for with_pairs in (True, False):
            bound = maxscore.bounds(shard.top[terms], shard.joint_top[pair] if with_pairs else None)
            for i in range(len(terms) + 1):
                assert bound[i] >= mass[:, terms[:i]].sum(axis=1).max()


def test_pair_bounds_read_fewer_postings():
    rng = np.random.default_rng(7)
    rows, terms = 5000, 12
    # Terms of even number exclude their neighbour: joint maxima stay low.
    mass = rng.integers(400, 1000, (rows, terms)) * (rng.random((rows, terms)) < 0.3) * (np.arange(terms) + 1) ** 2
    for t in range(0, terms, 2):
        mass[:, t] *= mass[:, t + 1] == 0
    row, term = np.nonzero(mass)
    q = maxscore.Queries.__new__(maxscore.Queries)
    q.terms = [np.arange(terms)]
    q = q.weighed(np.arange(terms) + 1)
    shard = maxscore.Shard(q, row, term, mass[row, term], rows)
    exact = mass.sum(axis=1)
    least = int(np.sort(exact)[-20])
    seen = {}
    for with_pairs in (True, False):
        touched = [0]
        found, score = maxscore.search_shard(shard, q.terms[0], q.pair_of[0], 10, least, touched, with_pairs)
        assert set(np.flatnonzero(exact >= np.sort(exact)[-10])) <= set(found.tolist())
        seen[with_pairs] = touched[0]
    assert seen[True] < seen[False] < len(row)


def test_large_products_do_not_overflow():
    got = maxscore.impacts(np.array([7]), np.array([3]), np.array([10**7]), 10**11, 10**13)
    assert got.tolist() == [7 * (3 * 10**9 // (3000 + 20 * (50 + 50 * 10**18 // 10**13)))]
