import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import odd_rows

from curbscope.llm import ctw


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "a", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50))).title(), "en", "s") for i in range(n)]


class SlowTree:
    """Context-tree weighting by the recursion, one decision at a time, on
    counts of all contexts; contexts with fewer than ``least`` bits belong to
    the rest of their parent."""

    def __init__(self, texts, depth, least):
        self.depth, self.least, self.n = depth, least, Counter()
        for t in texts:
            for c, node, bit in self.bits(t):
                for d in range(depth + 1):
                    self.n[c[depth - d:], node, bit] += 1

    def bits(self, text):
        body = b"\n" * self.depth + b" ".join(ctw.tokens(text)) + b"\n"
        for k in range(self.depth, len(body)):
            node = 1
            for j in range(7, -1, -1):
                yield body[k - self.depth : k], node, body[k] >> j & 1
                node = node << 1 | body[k] >> j & 1

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(self, c, node):
        found = [bytes([x]) + c for x in range(256)]
        return [s for s in found if self.n[s, node, 0] + self.n[s, node, 1] >= self.least]

    def rest(self, c, node):
        kids = self.children(c, node)
        return [self.n[c, node, b] - sum(self.n[s, node, b] for s in kids) for b in (0, 1)]

    def weighted(self, c, node):
        own = self.kt(self.n[c, node, 0], self.n[c, node, 1])
        if len(c) == self.depth:
            return own
        split = self.kt(*self.rest(c, node)) + sum(self.weighted(s, node) for s in self.children(c, node))
        return np.logaddexp(own, split) - math.log(2)

    def one(self, context, node, d=0):
        c = context[self.depth - d :]
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        stop = math.exp(self.kt(a, b) - math.log(2) - self.weighted(c, node))
        deeper = context[self.depth - d - 1 :]
        if self.n[deeper, node, 0] + self.n[deeper, node, 1] >= self.least:
            below = self.one(context, node, d + 1)
        else:
            a, b = self.rest(c, node)
            below = (b + 0.5) / (a + b + 1)
        return stop * own + (1 - stop) * below

    def score(self, text):
        known = {}
        total = 0.0
        for c, node, bit in self.bits(text):
            p = known.setdefault((c, node), None) or known.__setitem__((c, node), self.one(c, node)) or known[c, node]
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.mark.parametrize("rows", [corpus(), [(i, (t or "")[:400], *r) for i, t, *r in odd_rows()], [(1, "a b", "en", "s")]])
def test_scores_equal_brute_force(make_docs, rows):
    depth, max_nodes = 2, 300
    got = ctw.lm_scores(make_docs(rows), depth=depth, max_nodes=max_nodes, head_words=20)
    learn = [t for i, t, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    n = sum(len(b" ".join(ctw.tokens(t))) + 1 for t in learn)
    tree = SlowTree(learn, depth, max(2.0, n / max_nodes))
    c = Counter(w for t in learn for w in [*ctw.tokens(t), ctw.END])
    total, v = sum(c.values()), len(c)
    want = []
    for i, t, _, _ in rows:
        w = [*ctw.tokens(t), ctw.END]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        want.append((i, held, len(w), sum(c[x] > 0 for x in w), total, base, tree.score(t)))
    found = [tuple(r)[:7] for r in got.collect()]
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-8, abs=1e-8)


def test_long_texts_and_empty_tables(make_docs):
    got = {r.doc_id: r for r in ctw.lm_scores(make_docs(odd_rows())).collect() if r.doc_id}
    assert got[5].n_tokens == 200_001 and got[5].held_out and got[2].n_bytes == 1
    assert ctw.lm_scores(make_docs([])).count() == 0
    nothing = ctw.lm_scores(make_docs([(None, "ab", "en", "s")])).collect()[0]
    assert nothing.score == pytest.approx(3 * 8 * math.log10(0.5)) and nothing.train_tokens == 0


def test_probabilities_sum_to_one():
    g, _ = ctw.grams([b"the cat sat on the mat", b"a hat"], 3)
    keys, n = np.unique(g, return_counts=True)
    levels = []
    for d in range(4):
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
        nodes = Counter()
        for c, byte, k in zip(context.tolist(), (keys & np.uint64(255)).tolist(), n.tolist()):
            for j in range(8):
                nodes[c << 8 | 1 << j | byte >> (8 - j), byte >> (7 - j) & 1] += k
        own = np.array(sorted({k for k, _ in nodes}), dtype=np.uint64)
        levels.append((own, *[np.array([nodes[int(k), b] for k in own]) for b in (0, 1)]))
    model = ctw.Model(levels)
    for context in (b"the", b"zzz", b" ca"):
        every = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)], dtype=np.uint64)
        assert (10 ** model.lengths(every)).sum() == pytest.approx(1.0)


class WholeTree(SlowTree):
    """Without small nodes left out; remembers what it has computed."""

    def __init__(self, texts, depth):
        super().__init__(texts, depth, 1)
        self.below, self.known = {}, {}
        for c, node in {(c, node) for c, node, _ in self.n if c}:
            self.below.setdefault((c[1:], node), []).append(c)

    def children(self, c, node):
        return self.below.get((c, node), [])

    def weighted(self, c, node):
        if (c, node) not in self.known:
            self.known[c, node] = super().weighted(c, node)
        return self.known[c, node]


@pytest.mark.parametrize("depth,head_grams", [(1, 5), (2, 40), (4, 0), (4, 1 << 20)])
def test_whole_tree_equals_brute_force(make_docs, depth, head_grams):
    """By default no context is dropped, however rare: texts not learned from
    and grams that are not broadcast included."""
    rows = [*corpus(24, 2), (900, "rare quux quux", "en", "s"), (901, "unseen ZEBRA ø", "en", "s"), (901, "unseen ZEBRA ø", "en", "s"), (None, "rare", None, None)]
    got = ctw.lm_scores(make_docs(rows), depth=depth, head_words=20, head_grams=head_grams)
    learn = [t for i, t, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(learn) < len(rows) - 1
    tree = WholeTree(learn, depth)
    found = sorted((repr(r.doc_id), r.score) for r in got.collect())
    want = sorted((repr(i), tree.score(t)) for i, t, _, _ in rows)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-8)
