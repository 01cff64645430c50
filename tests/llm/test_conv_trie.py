import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbscope.llm import conv_trie

TURNS = "conv_id long, turn long, role string, text string, c long, d long, depth long, part string, k int, total long"


@pytest.fixture(scope="module")
def make_turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, 2, 3, "p", 4, 5) for r in rows], TURNS)

    return make


def by_hand(rows, graft=True):
    """The definition: every prefix as a tuple, subtrees by comparing prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        base = c - int(c / 100) * 100
        full[c] = own.get(c - base, [])[:h] + t[h:]
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[x] for x in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def drawn(seed, convs=120, words=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 450), convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "é🙂 word " * rng.randrange(words)))
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "user", "x"),
    (0, 1, "assistant", "x"), (1, 5, None, "a"), (2, 5, "", "a"), (3, 5, "", "a"), (-7, 0, "user", "minus"), (-107, 0, "user", "minus"),
    (301, 0, "user", "no base"), (302, 0, "user", "no base"), (303, 0, "user", "no base"), (304, 0, "user", "b" * 200_000),
]
CASES = [drawn(1), drawn(2, 60, 2, 4), ODD, [(5, 0, "user", "one")], [(None, 0, "user", "x")], []]


def trie(turns, graft=True):
    rules = dict(base=conv_trie.hundred, share=conv_trie.drawn_share, most=5) if graft else {}
    return sorted(map(tuple, conv_trie.conversation_trie(turns, **rules).collect()), key=repr)


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(make_turns, rows):
    assert trie(make_turns(rows)) == by_hand(rows)


def test_as_they_stand_and_columns(make_turns):
    rows = drawn(3, 50)
    found = conv_trie.conversation_trie(make_turns(rows))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for n, t in found.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(rows, graft=False)


def test_sql_says_the_same():
    rows = drawn(4) + [r for r in ODD if r[0] is not None and r[0] >= 0 and len(r[3] or "") < 9]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}))
    got = con.execute(conv_trie.SQL).fetchall()
    assert sorted(got, key=repr) == by_hand(rows)


def test_one_long_conversation_over_many_partitions_and_a_wide_node(spark, make_turns, monkeypatch):
    """Rows of one conversation lie in several sorted partitions; one turn
    begins most conversations, and many end in one node."""
    monkeypatch.setattr(conv_trie, "RUN", 16)
    rows = [(200, k, "user", "t%d" % (k % 7)) for k in range(300)]
    rows += [(c, 0, "user", "t0") for c in range(1000, 1150)] + [(c, 1, "user", "t%d" % c) for c in range(1100, 1150)]
    assert trie(make_turns(rows).repartition(7), graft=False) == by_hand(rows, graft=False)
    assert trie(make_turns(rows).repartition(7)) == by_hand(rows)


def test_sums_over_random_forests(spark):
    rng = random.Random(9)
    parent = {}
    for v in range(1, 250):   # chains, stars and random trees; two roots
        parent[v] = v - 1 if v < 80 else 3 if v < 160 else rng.randrange(v)
    parent[120] = None
    kids = {v: [c for c, p in parent.items() if p == v] for v in range(250)}
    rows = []
    for v in range(250):
        p, x, y = parent.get(v), 0, 0
        for c in kids[v]:
            x, y = x ^ c, y ^ (c * 3)
        rows.append((v, v * 3, p, None if p is None else p * 3, len(kids[v]), x, y, v + 1))
    tree = spark.createDataFrame(rows, "c long, d long, pc long, pd long, k long, kc long, kd long, size long")
    got = {r.c: r["size"] for r in conv_trie.subtree_sums(tree, ["size"]).collect()}

    def total(v):
        return v + 1 + sum(total(c) for c in kids[v])

    assert got == {v: total(v) for v in range(250)}


def test_graft_rule_is_crc32_of_the_decimal_number(spark):
    rows = spark.range(-50, 2000, 13).select("id", conv_trie.drawn_share(F.col("id")).alias("h")).collect()
    assert all(r.h == zlib.crc32(str(r.id).encode()) % 6 for r in rows)
