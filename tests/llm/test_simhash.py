import random
from collections import defaultdict

import pytest
import xxhash
from llm_cases import odd_rows

from curbscope.llm import common, simhash


def slow_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows, max_bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                parent[root(i)] = root(j)
    first = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        first[root(k)].append(i)
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(
        ((i, f"{fps[k]:016x}", smallest(first[root(k)])) for k, (i, _) in enumerate(rows)), key=repr
    )


def near_copies(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(n // 4)]
    rows = []
    for k in range(n):
        w = rng.choice(texts).split(" ")
        if k % 3:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    return rows


def test_fingerprint_follows_the_definition():
    texts = ["A b C d e", "one two", "ÄÖ äö A", "a\x0bb\x0cc\rd e\x1ff", "", None, "a b c d " * 50]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("rows", [near_copies(), [(i, t) for i, t, _, _ in odd_rows()], [(1, "a b c d e f")], []])
def test_groups_equal_brute_force(make_docs, rows):
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got = simhash.simhash_groups(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_groups(rows)


def test_more_blocks_and_hot_tiles_give_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(60)}
    fps = [simhash.signed(f & (2**64 - 1)) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts():
        found = dict(map(tuple, common.connected_components(simhash.hamming_edges(df, n, 4)).collect()))
        return sorted((f, found.get(f, f)) for f in fps)

    n = len(fps)
    few = parts()
    monkeypatch.setattr(simhash, "TILE", 16)
    assert parts() == few
    n = 2**27  # more blocks per key
    assert len(simhash.block_masks(n, 4)) > 5
    assert parts() == few


def test_one_document_of_each_group_stays(make_docs):
    rows = [(i, t, "en", "s") for i, t in near_copies()]
    rows += [(i and i + 1000, *r) for i, *r in odd_rows()]
    docs = make_docs(rows)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in slow_groups([(i, t) for i, t, _, _ in rows]) if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (5, 5)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}
