"""FM-index of one shard of texts over an alphabet of words.

The suffixes of the shard are sorted by prefix doubling; kept are the
Burrows-Wheeler transform as a wavelet matrix of bit vectors with rank
counts, the number of smaller symbols of each symbol, and every
``SAMPLE``-th suffix position. Phrases are found by backward search, several
at a time, and their occurrences by walking to the next sampled position.
"""

from __future__ import annotations

import numpy as np

#: A suffix position is kept for every so many positions of a shard.
SAMPLE = 16

#: Symbols of a shard: two ranks and a position fit one 63-bit sort key.
MOST = (1 << 21) - 2


class Bits:
    """A bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)
        self.ones = int(ones.sum())

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``first`` (integers >= 0), sorted.
    Only suffixes that still tie take part in a round."""
    n = len(first)
    at = np.arange(n, dtype=np.int64)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    key = first[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    sa = order.astype(np.int64)
    tied = _tied(new)
    k, low = 1, (1 << 21) - 1
    slots = np.flatnonzero(tied)
    while len(slots):
        pos = sa[slots]
        ahead = rank[np.minimum(pos + k, n)] + 1
        packed = np.sort((rank[pos] << 42) | (ahead << 21) | pos)
        pos = packed & low
        key = packed >> 21
        new = np.concatenate(([True], key[1:] != key[:-1]))
        sa[slots] = pos
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[_tied(new)]
        k *= 2
    return sa


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of more than one; ``new`` marks where groups begin."""
    alone = new & np.concatenate((new[1:], [True]))
    return ~alone


class FMIndex:
    """Index of texts of word numbers: ``words`` (0 to ``size`` - 1) of all
    texts one after another, ``starts`` where each text begins (and the end).
    No phrase reaches from one text into the next. Texts and words together
    must not exceed ``MOST``."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, size: int, sample: int = SAMPLE):
        texts = len(starts) - 1
        n = len(words) + texts
        if n > MOST:
            raise ValueError(f"{n} symbols are more than a shard holds")
        where = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(starts))
        ends = starts[1:] + np.arange(texts)
        seq = np.zeros(n, dtype=np.int64)         # 0 ends a text
        seq[where] = words + 1
        first = np.empty(n, dtype=np.int64)       # ends differ from each other
        first[where] = words + texts
        first[ends] = np.arange(texts)
        sa = suffix_array(first)
        bwt = np.where(sa > 0, seq[np.maximum(sa, 1) - 1], 0)
        self.size = size + 1
        self.less = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.size))))
        self.levels = []
        for shift in range(int(self.size).bit_length() - 1, -1, -1):
            bit = ((bwt >> shift) & 1).astype(bool)
            level = Bits(bit)
            self.levels.append((shift, level, n - level.ones))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        self.base = self._down(np.arange(self.size), np.zeros(self.size, dtype=np.int64))
        # A text's first position is always kept: no walk passes its end.
        kept = (sa % sample == 0) | (sa == 0) | (seq[np.maximum(sa, 1) - 1] == 0)
        self.kept, self.samples = Bits(kept), sa[kept].astype(np.int32)
        self.begins = starts[:-1] + np.arange(texts)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            r = level.rank(i)
            i = np.where((c >> shift) & 1 != 0, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols c in front of position i of the transform."""
        return self._down(c, i) - self.base[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Row of the suffix that begins one position earlier."""
        c = np.zeros(len(i), dtype=np.int64)
        for shift, level, zeros in self.levels:
            one = level.get(i)
            r = level.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return self.less[c] + i - self.base[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) whose suffixes begin with each phrase: ``phrases`` has
        one row of word numbers for each, of which the first ``lengths`` count;
        -1 is a word that the shard lacks."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        inside = np.arange(phrases.shape[1]) < lengths[:, None]
        live = np.flatnonzero((lengths > 0) & ~((phrases < 0) & inside).any(axis=1))
        last = phrases[live, lengths[live] - 1] + 1
        lo[live], hi[live] = self.less[last], self.less[last + 1]
        step = 1
        live = live[lengths[live] > step]
        while len(live):
            c = phrases[live, lengths[live] - 1 - step] + 1
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            step += 1
            live = live[(hi[live] > lo[live]) & (lengths[live] > step)]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word position in ``words``) of every occurrence."""
        count = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(lo)), count)
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(phrase))
        pos = np.empty(len(phrase), dtype=np.int64)
        todo, steps = np.arange(len(phrase)), 0
        while len(todo):
            there = self.kept.get(row)
            pos[todo[there]] = self.samples[self.kept.rank(row[there])] + steps
            todo, row = todo[~there], self.back(row[~there])
            steps += 1
        text = np.searchsorted(self.begins, pos, side="right") - 1
        return phrase, pos - text
