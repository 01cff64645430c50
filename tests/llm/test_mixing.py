import random

import duckdb
import pandas as pd
import pytest
from llm_cases import odd_rows

from curbscope.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above three times a size is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / max(sum(w[x] for x in open_), 1e-12) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in names}
        full |= above


def drawn_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randint(0, 60))), "en",
             rng.choice(["a", "a", "a", "b", "c", "d", None, "Ä"])) for i in range(n)]
    return rows + [(n + 1, "one two", "en", "tiny"), (n + 2, None, "en", "void"), (n + 3, "", "en", "void")]


@pytest.mark.parametrize("rows", [drawn_rows(), odd_rows(), [(1, "a b", "en", "s")], [(1, None, "en", "s")]])
def test_plan_against_sql_and_the_contract(make_docs, rows):
    docs = make_docs(rows)
    got = mixing.mix_plan(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    found = sorted(map(tuple, got.collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, t, _, s in rows], columns=["doc_id", "text", "source"]).astype(
        {"doc_id": "Int64", "text": "string", "source": "string"}))
    assert found == sorted(con.execute(mixing.SQL).fetchall(), key=repr)
    source = [(s, len((t or "").split())) for _, t, _, s in rows]
    sizes = {}
    for s, n in source:
        sizes[s] = sizes.get(s, 0) + n
    want = slow_targets(sizes)
    by = mixing.with_copies(docs).collect()
    taken = {s: 0 for s in sizes}
    for r in by:
        assert r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r["size"]
    for s, n in taken.items():
        largest = max(r["size"] for r in by if r.row.source == s)
        assert abs(n - want[s]) <= largest


def test_the_mix_repeats_rows_and_reruns_agree(make_docs):
    docs = make_docs(drawn_rows(150))
    once = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert once == again and mixing.mix(docs).columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.with_copies(docs).collect()}
    assert len(once) == sum(copies.values())


def test_no_python_in_the_plan(make_docs):
    plan = mixing.mix_plan(make_docs(drawn_rows(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weights_and_empty(make_docs):
    assert mixing.mix_plan(make_docs([])).count() == 0
    got = mixing.with_copies(make_docs(drawn_rows(90)), weights=(1.0,), max_copies=2).collect()
    assert max(r.copies for r in got) <= 2


@pytest.mark.parametrize("limit", ["-1", "100m"])
def test_no_text_is_shuffled_or_broadcast(spark, tmp_path, make_docs, limit):
    make_docs(drawn_rows(300)).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        mixed = mixing.mix(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString().splitlines()
        assert mixed.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    exchanges = [k for k, x in enumerate(plan) if "Exchange" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    assert exchanges
    for k in exchanges:
        below = []
        for x in plan[k + 1:]:
            if depth(x) <= depth(plan[k]):
                break
            below.append(x)
        assert not any("FileScan" in x and "text" in x for x in below), plan[k]
