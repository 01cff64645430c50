"""LM scoring: context-tree weighting over bytes.

A text is its lower-cased words with one space between them and a line feed
as its end. Each byte is eight binary decisions, and each decision has a tree
of contexts: the 0 to ``depth`` bytes before it. A node's bits are estimated
by Krichevsky-Trofimov counts; the weighting mixes, at every node, its own
estimate with the product of its children, so that a prediction is a mixture
of the estimates of all depths, with weights that the training texts give.

The tree is whole: every context that occurs has its node. It is never in one
place. The distinct grams (a byte with the ``depth`` bytes before it) of all
texts are dealt by the ``SPLIT`` bytes before the byte, so that a task has
whole subtrees and gives the code length of each of their grams; grams of texts
that are not learned from have count zero, which changes no node. Only the
nodes above the subtrees, a number that the alphabet bounds, go through the
driver. The ``HEAD_GRAMS`` most frequent grams are broadcast with their code
lengths, all others are looked up by a join.

With ``max_nodes``, nodes with fewer than 1 / ``max_nodes`` of all training
bytes are not kept, but are one child of their parent, "the rest": a smaller
model of a fixed bound, which is broadcast. The query does not use it.

The unigram score beside it needs the count of every word. The
``head_words`` most frequent words are broadcast; all others are looked up by
a join, so no vocabulary has to fit anywhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col
from .langid import held_out

DEPTH = 6
#: Depth of the nodes whose subtrees a task has whole.
SPLIT = 3
HEAD_GRAMS = 1 << 21
#: Grams of whole subtrees in one row, about.
CHUNK = 1 << 17
HEAD_WORDS = 200_000
#: Longest word, in bytes, that is broadcast.
HEAD_BYTES = 48
#: Slots of a worker's cache of code lengths, as a power of two.
CACHE_BITS = 22
#: Distinct items that a counting task holds before it gives them out.
HELD = 800_000
WORDS_HELD = 250_000
#: Parts into which grams are dealt by a hash; one is summed at a time.
PARTS = 4096
#: The token that ends a text: no word holds a line feed.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of bytes other than space and 0x09..0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts given as words joined by spaces: each byte with the
    ``depth`` bytes before it in one integer (the byte lowest), and where
    each text starts. Before a text is nothing but ends."""
    pad = END * depth
    data = np.frombuffer(pad + (END + pad).join(bodies) + END, dtype=np.uint8)
    sizes = np.array([len(b) + 1 for b in bodies])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    g = np.zeros(len(data) - depth, dtype=np.uint64)
    for k in range(depth + 1):
        g = (g << np.uint64(8)) | data[k : len(data) - depth + k]
    # The positions between texts predict the padding: they go.
    keep = np.ones(len(g), dtype=bool)
    ends = starts + depth * np.arange(len(bodies)) + sizes
    if len(bodies) > 1:
        gaps = (ends[:-1, None] + np.arange(depth)[None, :]).ravel()
        keep[gaps] = False
    return g[keep], starts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0."""
    z, low = x + 8.0, np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - low


#: ln of the gamma function at k + 1/2 and at k + 1, for small k.
SMALL = 1 << 12
HALVES, WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def log_gamma_of(counts: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(counts, SMALL - 1)]
    large = np.flatnonzero(counts >= SMALL)
    out[large] = log_gamma(counts[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many bits."""
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return log_gamma_of(zeros, HALVES, 0.5) + log_gamma_of(ones, HALVES, 0.5) - log_gamma_of(zeros + ones, WHOLES, 1.0) - math.log(math.pi)


class Model:
    """``levels[d]``: (keys, probability of a 1) of the kept nodes of depth
    d, where a key is the d context bytes and, lowest, the decision (1, then
    the bits decided so far). The probability holds for contexts of which no
    deeper node is kept."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        depth = len(levels) - 1
        log_w: list[np.ndarray] = [np.array([])] * (depth + 1)
        stop, own, rest = ([None] * (depth + 1) for _ in range(3))
        above: list[np.ndarray] = [np.array([], dtype=int)] * (depth + 1)
        for d in range(depth, -1, -1):
            keys, zeros, ones = levels[d]
            rest0, rest1, children = zeros.astype(float), ones.astype(float), np.zeros(len(keys))
            if d < depth and len(levels[d + 1][0]):
                below, z, o = levels[d + 1]
                mask = np.uint64((1 << (8 * (d + 1))) - 1)
                above[d + 1] = np.searchsorted(keys, below & mask)
                np.subtract.at(rest0, above[d + 1], z)
                np.subtract.at(rest1, above[d + 1], o)
                np.add.at(children, above[d + 1], log_w[d + 1])
            log_own = log_kt(zeros, ones)
            own[d] = (ones + 0.5) / (zeros + ones + 1.0)
            if d == depth:
                log_w[d], stop[d], rest[d] = log_own, np.ones(len(keys)), own[d]
                continue
            split = children + log_kt(rest0, rest1)
            log_w[d] = np.logaddexp(log_own, split) - math.log(2)
            stop[d] = np.exp(log_own - math.log(2) - log_w[d])
            rest[d] = (rest1 + 0.5) / (rest0 + rest1 + 1.0)
        self.depth, self.levels = depth, []
        done, left = np.zeros(len(levels[0][0])), np.ones(len(levels[0][0]))
        for d in range(depth + 1):
            if d:
                done, left = done[above[d]], left[above[d]]
            done, left = done + left * stop[d] * own[d], left * (1 - stop[d])
            self.levels.append((levels[d][0], done + left * rest[d]))

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's lowest byte."""
        total = np.zeros(len(g))
        byte, context = g & np.uint64(255), g >> np.uint64(8)
        for j in range(8):
            node = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            one = np.full(len(g), 0.5)
            open_ = np.arange(len(g))
            for d in range(self.depth, -1, -1):
                keys, p = self.levels[d]
                if not len(open_) or not len(keys):
                    continue
                mask = np.uint64((1 << (8 * d)) - 1)
                key = ((context[open_] & mask) << np.uint64(8)) | node[open_]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                one[open_[hit]] = p[at[hit]]
                open_ = open_[~hit]
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, one, 1.0 - one))
        return total


class Scorer:
    """Sums of code lengths, with a cache by gram: one slot each."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << CACHE_BITS, 2**64 - 1, dtype=np.uint64)
        self.values = np.zeros(1 << CACHE_BITS)

    def score(self, bodies: list[bytes]) -> tuple[np.ndarray, Rest]:
        """log10 probability of each text (words joined by single spaces)."""
        g, starts = grams(bodies, self.model.depth)
        with np.errstate(over="ignore"):
            slot = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        value = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            found = self.model.lengths(new)
            value[miss] = found[back]
            self.keys[slot[miss]], self.values[slot[miss]] = g[miss], value[miss]
        return np.add.reduceat(value, starts), NO_REST


#: Of grams that are looked up elsewhere: the text, the gram, how often.
Rest = tuple[np.ndarray, np.ndarray, np.ndarray]
NO_REST: Rest = (np.array([], np.int64), np.array([], np.uint64), np.array([], np.int64))


class Lookup:
    """Sums of the code lengths of the head grams, given rising in frequency."""

    def __init__(self, grams_: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth = depth
        order = np.argsort(grams_)
        self.grams, self.lengths = grams_[order], lengths[order]
        # No gram has bits above its 8 * (depth + 1) <= 56.
        self.keys, self.values = np.full(1 << CACHE_BITS, 2**64 - 1, dtype=np.uint64), np.zeros(1 << CACHE_BITS)
        slot = self.slot(grams_)
        self.keys[slot], self.values[slot] = grams_, lengths

    def slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def score(self, bodies: list[bytes]) -> tuple[np.ndarray, Rest]:
        """For each text (words joined by single spaces) the sum over its
        head grams, and the other grams."""
        g, starts = grams(bodies, self.depth)
        slot = self.slot(g)
        value = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != g)
        rest = NO_REST
        if len(miss):
            own = g[miss]
            known = np.zeros(len(miss), dtype=bool)
            value[miss] = 0.0
            if len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                known = self.grams[at] == own
                value[miss[known]] = self.lengths[at[known]]
            if not known.all():
                own, text = own[~known], np.searchsorted(starts, miss[~known], side="right") - 1
                order = np.lexsort((own, text))
                own, text = own[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
                rest = text[first], own[first], np.diff(np.append(first, len(own)))
        return np.add.reduceat(value, starts), rest


def part_of(g: np.ndarray, depth: int) -> np.ndarray:
    """The same for all grams of a subtree."""
    context = (g >> np.uint64(8)) & np.uint64((1 << 8 * min(SPLIT, depth)) - 1)
    with np.errstate(over="ignore"):
        return ((context * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64) % PARTS


def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def nearest_first(g: np.ndarray, depth: int) -> np.ndarray:
    """The context of each gram with the byte just before in front: the
    contexts of a node are next to each other in this order."""
    out = np.zeros(len(g), dtype=np.uint64)
    for k in range(1, depth + 1):
        out = (out << np.uint64(8)) | ((g >> np.uint64(8 * k)) & np.uint64(255))
    return out


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(grams, counts): the distinct grams of all texts of ``docs`` (text,
    learn) as arrays, with their counts in the texts to learn from. A row has
    whole subtrees, by ``nearest_first`` and byte. Tasks count what they read
    and pass their counts on as arrays, one for each part."""
    below = np.uint64(8 * (depth - min(SPLIT, depth)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = joined(held)
            part = part_of(keys, depth)
            order = np.argsort(part, kind="stable")
            keys, n, part = keys[order], n[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            cuts = list(zip(first, np.append(first[1:], len(keys))))
            for at in range(0, len(cuts), 512):
                some = cuts[at : at + 512]
                yield pa.record_batch(
                    [pa.array([int(part[a]) for a, _ in some], pa.int32()),
                     pa.array([keys[a:z].tobytes() for a, z in some], pa.binary()),
                     pa.array([n[a:z].tobytes() for a, z in some], pa.binary())],
                    names=["part", "grams", "counts"])

        for b in common.slices(batches, 512):
            learn = b.column(1).to_pylist()
            bodies = [b" ".join(tokens(t)) for t in b.column(0).to_pylist()]
            for learned in (True, False):
                some = [x for x, y in zip(bodies, learn) if y == learned]
                if some:
                    keys, n = np.unique(grams(some, depth)[0], return_counts=True)
                    held.append((keys, n.astype(np.int64) * learned))
            if sum(len(k) for k, _ in held) > 4 * HELD:
                held = [joined(held)]
                if len(held[0][0]) > 2 * HELD:
                    yield from out()
                    held = []
        if held:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = -1, 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, n = joined(held)
            context = nearest_first(keys, depth)
            order = np.argsort((context << np.uint64(8)) | (keys & np.uint64(255)))
            keys, n, tree = keys[order], n[order], context[order] >> below
            first = np.append(np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1]))), len(keys))
            at = 0
            while at < len(keys):
                to = int(first[max(np.searchsorted(first, at + CHUNK, side="right") - 1, np.searchsorted(first, at, side="right"))])
                yield pa.record_batch(
                    [pa.array([keys[at:to].tobytes()], pa.binary()), pa.array([n[at:to].tobytes()], pa.binary())], names=["grams", "counts"])
                at = to

        for b in batches:
            for part, keys, n in zip(*(b.column(k) for k in range(3))):
                if part.as_py() != current or size > 8 * HELD:
                    if part.as_py() != current:
                        yield from out()
                        held = []
                    else:
                        held = [joined(held)]
                    current, size = part.as_py(), 0
                held.append((np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)))
                size += len(held[-1][0])
        yield from out()

    counted = docs.select("text", "learn").mapInArrow(count, "part int, grams binary, counts binary")
    return common.sorted_groups(counted, ["part"]).mapInArrow(add, "grams binary, counts binary")


class Decision:
    """The nodes of one of the eight decisions at the depths ``low`` to
    ``depth``, for the grams of whole subtrees as ``gram_counts`` gives them.

    A node's key is the decision (1, then the bits decided so far) and below
    it the context, the byte just before first. Lists go by depth from
    ``low``; ``up`` has the place of each child (at last: of each gram)."""

    def __init__(self, g: np.ndarray, counts: np.ndarray, depth: int, low: int, j: int):
        byte = g & np.uint64(255)
        node = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        self.order = np.argsort(node.astype(np.uint8), kind="stable")
        key = ((node << np.uint64(8 * depth)) | nearest_first(g, depth))[self.order]
        self.bit = ((byte >> np.uint64(7 - j)) & np.uint64(1))[self.order] == 1
        n = counts[self.order]
        ones = np.where(self.bit, n, 0)
        zeros = n - ones
        log_w = None
        self.p, self.stop, self.up = [], [], []
        for d in range(depth, low - 1, -1):
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            self.up.insert(0, np.cumsum(new) - 1)
            key, zeros, ones = key[first], np.add.reduceat(zeros, first), np.add.reduceat(ones, first)
            log_own = log_kt(zeros, ones)
            if log_w is None:
                log_w = log_own
            else:
                log_w = np.logaddexp(log_own, np.add.reduceat(log_w, first)) - math.log(2)
                self.stop.insert(0, np.exp(log_own - math.log(2) - log_w))
            self.p.insert(0, (ones + 0.5) / (zeros + ones + 1.0))
            self.key, self.zeros, self.ones, self.log_w = key, zeros, ones, log_w
            key = key >> np.uint64(8)

    def lengths(self, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's bit, in the order of
        ``order``; ``done`` and ``left`` of each node of depth ``low`` are
        what the nodes above it give to a 1, and the weight they leave."""
        for p, stop, up in zip(self.p, self.stop, self.up):
            done, left = (done + left * stop * p)[up], (left * (1 - stop))[up]
        one = (done + left * self.p[-1])[self.up[-1]]
        return np.log10(np.where(self.bit, one, 1.0 - one))


class Top:
    """The nodes above the subtrees. ``keys`` (as in ``Decision``) are those
    of depth ``low`` - 1; ``children`` sums the ln of their children's
    weighted probabilities."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, low: int):
        order = np.argsort(keys)
        self.keys = key = keys[order]
        zeros, ones, below = zeros[order], ones[order], children[order]
        p, stop, ups = [], [], []
        for d in range(low - 1, -1, -1):
            log_own = log_kt(zeros, ones)
            log_w = np.logaddexp(log_own, below) - math.log(2)
            p.append((ones + 0.5) / (zeros + ones + 1.0))
            stop.append(np.exp(log_own - math.log(2) - log_w))
            if d and len(key):
                key = key >> np.uint64(8)
                new = np.concatenate(([True], key[1:] != key[:-1]))
                first = np.flatnonzero(new)
                ups.append(np.cumsum(new) - 1)
                key, zeros, ones, below = key[first], *(np.add.reduceat(x, first) for x in (zeros, ones, log_w))
        self.done, self.left = np.zeros(len(key)), np.ones(len(key))
        for p_, stop_ in zip(reversed(p), reversed(stop)):
            self.done, self.left = self.done + self.left * stop_ * p_, self.left * (1 - stop_)
            if ups:
                up = ups.pop()
                self.done, self.left = self.done[up], self.left[up]

    def below(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys >> np.uint64(8))
        return self.done[at], self.left[at]


def gram_lengths(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n, length): each distinct gram of ``docs`` (text, learn) with its
    count in the texts to learn from and the log10 of its byte's probability
    by the tree of all of them. Depth 1 to 6."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    low = min(SPLIT, depth)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for k in range(b.num_rows):
                yield np.frombuffer(b.column(0)[k].as_py(), np.uint64), np.frombuffer(b.column(1)[k].as_py(), np.int64)

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in chunks(batches):
            for j in range(8):
                x = Decision(g, n, depth, low, j)
                key = x.key >> np.uint64(8)
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                yield pa.record_batch(
                    [pa.array(key[first].view(np.int64)), *(pa.array(np.add.reduceat(c, first)) for c in (x.zeros, x.ones, x.log_w))],
                    names=["key", "zeros", "ones", "children"])

    counted = common.held(gram_counts(docs, depth))
    sums = counted.mapInArrow(upward, "key long, zeros long, ones long, children double")
    # At most 255 decisions in each of the 256^(low - 1) contexts.
    top = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children"))).toArrow()
    key, zeros, ones, children = (top.column(c).to_numpy() for c in ("key", "zeros", "ones", "children"))
    shared = docs.sparkSession.sparkContext.broadcast(Top(key.view(np.uint64), zeros, ones, children, low))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value
        for g, n in chunks(batches):
            total = np.zeros(len(g))
            for j in range(8):
                x = Decision(g, n, depth, low, j)
                total[x.order] += x.lengths(*above.below(x.key))
            for at in range(0, len(g), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.record_batch(
                    [pa.array(g[some].view(np.int64)), pa.array(n[some]), pa.array(total[some])], names=["gram", "n", "length"])

    return counted.mapInArrow(downward, "gram long, n long, length double")


def train(docs: DataFrame, depth: int, max_nodes: int) -> Model:
    """The model of all texts of ``docs`` (text) without small nodes; depth at
    most 6. A level is summed from the one below it; only contexts with enough
    bytes are taken apart into their decisions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.record_batch([pa.array(np.frombuffer(b.column(c)[k].as_py(), np.int64)) for c in (0, 1)], names=["gram", "n"])

    counted = common.held(gram_counts(docs.select("text", F.lit(True).alias("learn")), depth).mapInArrow(rows, "gram long, n long"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    enough = max(2.0, n / max_nodes)
    level = counted.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("byte"), "n")
    bit = F.expr("shiftright(byte, 7 - j) & 1")
    node = F.expr("shiftleft(1L, j) | shiftright(byte, 8 - j)")
    found = None
    for d in range(depth, -1, -1):
        if d < depth:
            level = level.groupBy(F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context"), "byte").agg(F.sum("n").alias("n"))
        many = level.groupBy("context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("byte", "n")).alias("each"))
        if d:
            many = many.where(F.col("total") >= enough)
        split = many.select("context", F.explode("each").alias("x")).select("context", "x.byte", "x.n")
        nodes = (
            split.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
            .groupBy(F.lit(d).alias("d"), F.shiftleft("context", 8).bitwiseOR(node).alias("key"))
            .agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("ones"))
        )
        if d:
            nodes = nodes.where(F.col("zeros") + F.col("ones") >= enough)
        found = nodes if found is None else found.union(nodes)
    found = found.toArrow()
    depths, keys = found.column("d").to_numpy(), found.column("key").to_numpy().view(np.uint64)
    zeros, ones = found.column("zeros").to_numpy(), found.column("ones").to_numpy()
    levels = []
    for d in range(depth + 1):
        at = np.flatnonzero(depths == d)
        at = at[np.argsort(keys[at])]
        levels.append((keys[at], zeros[at], ones[at]))
    return Model(levels)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts of ``docs`` (text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in common.slices(batches, 64):
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
            held[END] += b.num_rows
            if len(held) > WORDS_HELD:
                yield out()
                held = Counter()
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def least_of(counts: DataFrame, most: int) -> int:
    """The lowest count (n) that one of the at most ``most`` head rows has.
    Rows of a count are in the head all or not at all."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    least, total = 2**62, 0
    for r in sizes.orderBy(F.col("n").desc()).limit(most).collect():
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
              max_nodes: int | None = None, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 1. score
    and base_score are log10 probabilities of the whole text by the context
    tree and by words alone; bits_per_byte is the code length of the score
    over its bytes (end included). The tree is whole; with ``max_nodes`` small
    nodes are not kept. A null, empty or blank text is one end
    token. Rows without doc_id are scored, not learned from. With nothing to
    learn, every bit has probability 1/2 and base_score is that of one
    unknown class. Repeated rows give repeated rows; other columns are not
    read; an empty table gives an empty result.
    """
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    own = own.withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    learn = "doc_id is not null and not held_out"
    training = own.where(learn)
    counts = common.held(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_of(counts, head_words)
    head = counts.where((F.col("n") >= least) & (F.length("word") <= HEAD_BYTES)).toArrow()
    tail = counts.where((F.col("n") < least) | (F.length("word") > HEAD_BYTES)).select(
        F.xxhash64("word").alias("_key"), F.col("word").alias("_word"), "n", F.log10(F.col("n") + F.lit(0.5)).alias("length"))
    if max_nodes is None:
        lengths = common.held(gram_lengths(own.select("text", F.expr(learn).alias("learn")), depth))
        at_least = least_of(lengths, head_grams)
        often = lengths.where(F.col("n") >= at_least).toArrow()
        rising = np.argsort(often.column("n").to_numpy(), kind="stable")
        model = often.column("gram").to_numpy().view(np.uint64)[rising], often.column("length").to_numpy()[rising]
        rare = lengths.where(F.col("n") < at_least)
        tail = tail.union(rare.select("gram", F.lit(b"").alias("_word"), F.lit(0).cast("long"), "length"))
    else:
        model = train(training, depth, max_nodes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, head))
    per_token = math.log10(n + 0.5 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, head = shared.value
        scorer = Scorer(tree) if isinstance(tree, Model) else Lookup(*tree, depth)
        logs = dict(zip(head.column("word").to_pylist(), np.log10(head.column("n").to_numpy() + 0.5).tolist()))
        for b in common.slices(batches, 256):
            rows, split = b.column(0).to_pylist(), [tokens(t) for t in b.column(3).to_pylist()]
            bodies = [b" ".join(w) for w in split]
            scores, (text, rare, often) = scorer.score(bodies)
            words: list[bytes] = []
            at: list[int] = []
            times: list[int] = []
            sums, known = [], []
            get = logs.get
            for row, w in zip(rows, split):
                c = Counter(w)
                c[END] += 1
                total, seen = 0.0, 0
                for word, k in c.items():
                    p = get(word)
                    if p is None:
                        words.append(word)
                        at.append(row)
                        times.append(k)
                    else:
                        total += k * p
                        seen += k
                sums.append(total)
                known.append(seen)
            none = len(words)
            # A row's own sums travel under a key that no word has: 0xFF is not in UTF-8.
            keys = words + [b"\xff" + str(row).encode() for row in rows]
            heads = pa.StructArray.from_arrays(
                [b.column(1), b.column(2), pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                 pa.array(scores), pa.array([len(x) + 1 for x in bodies], pa.int64())],
                names=["doc_id", "held_out", "n_tokens", "known", "total", "score", "n_bytes"])
            empty = pa.nulls(none, heads.type)
            names = ["gram", "word", "row", "times", "head"]
            yield pa.record_batch(
                [pa.nulls(none + len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(at + rows, pa.int64()),
                 pa.array(times + [0] * len(rows), pa.int64()), pa.concat_arrays([empty, heads])], names=names)
            if len(rare):  # no word is empty
                yield pa.record_batch(
                    [pa.array(rare.view(np.int64)), pa.array([b""] * len(rare), pa.binary()), pa.array(np.array(rows, np.int64)[text]),
                     pa.array(often.astype(np.int64)), pa.nulls(len(rare), heads.type)], names=names)

    numbered = own.withColumn("row", F.monotonically_increasing_id())
    schema = ("gram long, word binary, row long, times long, head struct<doc_id:long, held_out:boolean, n_tokens:long, "
              "known:long, total:double, score:double, n_bytes:long>")
    parts = numbered.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)
    parts = parts.withColumn("key", F.coalesce("gram", F.xxhash64("word")))
    looked = parts.join(tail, (F.col("key") == F.col("_key")) & (F.col("word") == F.col("_word")), "left")
    # Words that were not seen have count 0; every gram has its length.
    length, of_word = F.coalesce("length", F.lit(math.log10(0.5))), F.col("gram").isNull()
    sums = looked.groupBy("row").agg(
        F.sum(F.when(of_word, F.col("times") * length).otherwise(0.0)).alias("tail"),
        F.sum(F.when(of_word & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.when(of_word, 0.0).otherwise(F.col("times") * length)).alias("rare"),
        F.first("head", ignorenulls=True).alias("head"),
    )
    h = F.col("head")
    score = h.score + F.col("rare")
    return sums.select(
        h.doc_id.alias("doc_id"), h.held_out.alias("held_out"), h.n_tokens.alias("n_tokens"),
        (h.known + F.col("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (h.total + F.col("tail") - h.n_tokens * F.lit(per_token)).alias("base_score"), score.alias("score"),
        h.n_bytes.alias("n_bytes"), (-score / F.lit(math.log10(2)) / h.n_bytes).alias("bits_per_byte"),
    )
