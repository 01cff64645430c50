import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from llm_cases import odd_rows

from curbscope.llm import decontam
from curbscope.llm.fm_index import FMIndex
from curbscope.llm.words import word_lists

ITEM = "item_id long, text string, doc_id long, phrase string, item long"


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], ITEM)

    return make


def by_sql(rows, items):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in rows], columns=["doc_id", "text"]).astype(
        {"doc_id": "Int64", "text": "string"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype(
        {"item_id": "Int64", "text": "string"}))
    return sorted(con.execute(decontam.SQL).fetchall(), key=repr)


def by_hand(rows, items, window=10):
    """The definition, word sequence by word sequence."""
    cut = lambda t: re.findall(decontam.WORD, (t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))
    asked = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            asked.setdefault(tuple(w[s: s + window]), set()).add(i)
    sizes, out = {len(p) for p in asked}, []
    for r in rows:
        w, hit, ids = cut(r[1]), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                found = asked.get(tuple(w[s: s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def drawn(seed=3):
    rng = random.Random(seed)
    draw = lambda n, v: " ".join("w%d" % rng.randrange(v) for _ in range(n))
    items = [(k, draw(rng.choice([1, 2, 3, 9, 10, 11, 25]), 40)) for k in range(30)]
    items += [(7, items[7][1]), (100, items[3][1]), (None, items[5][1]), (101, None), (102, "?!"), (-5, "Ä ß")]
    rows = []
    for i in range(200):
        t = draw(rng.randrange(60), 40)
        for _ in range(rng.randrange(3)):
            k, item = items[rng.randrange(30)]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice([" ", ". ", "x"]) + item.upper() + rng.choice(["\n", ",", "9"]) + t[at:]
        rows.append((i, t, "en", "s"))
    return rows + [(500, items[12][1] * 3, "en", "s"), (500, items[12][1] * 3, "en", "s"), (501, "ä ß. Ä ß", "de", "s")], items


CASES = [
    drawn(), (odd_rows(), [(1, "quick brown fox"), (2, "beta gamma delta epsilon alpha beta gamma delta epsilon alpha beta")]),
    (odd_rows(), [(1, None), (None, "alpha")]), ([(1, "a b", "en", "s")], []), ([], [(1, "a")]), ([], []),
]


@pytest.mark.parametrize("rows,items", CASES)
def test_against_brute_force(make_docs, make_items, rows, items):
    found = decontam.digests(decontam.contamination(make_docs(rows), make_items(items)))
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    assert got == by_hand(rows, items)


def test_sql_says_the_same():
    assert by_sql(*drawn()) == by_hand(*drawn())


def test_blocks_of_phrases_give_the_same_rows(make_docs, make_items):
    rows, items = drawn(5)
    docs, bench = make_docs(rows), make_items(items)
    one = sorted(map(repr, decontam.contamination(docs, bench).collect()))
    assert sorted(map(repr, decontam.contamination(docs, bench, block=60).collect())) == one


def test_spans_are_the_merged_hits(make_docs, make_items):
    docs = make_docs([(1, "x a b c a b c y a b", "en", "s"), (2, "b c a", "en", "s")])
    got = decontam.contamination(docs, make_items([(1, "a b c"), (2, "a b"), (3, "y")])).collect()
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert spans == {1: [(1, 10)], 2: []} and {r.doc_id: r.n_hit for r in got} == {1: 9, 2: 0}


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "MOST", 50)
    rng = np.random.default_rng(1)
    import pyarrow as pa
    texts = [" ".join(map(str, rng.integers(0, 4, n))) for n in (7, 400, 0, 49, 50, 3)]
    words, starts = word_lists(pa.array(texts))
    block = decontam.Phrases(pa.table({"phrase": ["1 2 3", "0 0", "3"], "item": pa.array([1, 2, 3], pa.int64())}))
    got = set(zip(*(x.tolist() for x in decontam.hits(words, starts, block))))
    flat, order = words.to_pylist(), pa.array(["1 2 3", "0 0", "3"]).dictionary_encode().dictionary.to_pylist()
    want = {(p, a + s) for p, t in enumerate(order) for a, b in zip(starts, starts[1:])
            for s in range(b - a) if flat[a + s: min(a + s + len(t.split()), b)] == t.split()}
    assert got == want


@pytest.mark.parametrize("trial", range(15))
def test_index_finds_all_occurrences(trial):
    rng = random.Random(trial)
    size = rng.choice([1, 2, 3, 8])
    texts = [[rng.randrange(size) for _ in range(rng.choice([0, 1, 5, 30, 80]))] for _ in range(rng.randint(1, 20))]
    texts += texts[: rng.randint(0, 5)]
    words = np.array([x for t in texts for x in t], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    index = FMIndex(words, starts, size, sample=rng.choice([1, 3, 16]))
    asked = [[rng.randrange(size) for _ in range(rng.randint(1, 4))] for _ in range(10)]
    table = np.full((10, 4), -1)
    for k, p in enumerate(asked):
        table[k, : len(p)] = p
    found = index.locate(*index.search(table, np.array([len(p) for p in asked])))
    want = {(k, int(starts[t]) + s) for k, p in enumerate(asked) for t, x in enumerate(texts)
            for s in range(len(x) - len(p) + 1) if x[s: s + len(p)] == p}
    assert set(zip(*(x.tolist() for x in found))) == want
