"""BPE encoding and decoding: bounded-lookahead streaming transducer.

Encoding. Text is cut into pre-tokens; the bytes of a pre-token are merged by
the merge list. Whatever follows a position can change tokens only within a
bounded distance before it, because a change travels left one merge at a
time, each of a later rank than the one before (``lookahead``). So the
transducer holds a window of bytes, and emits a token once it ends at least
that distance before the window's end. No merge of the full result crosses a
token boundary, so the rest is encoded afresh from there. Memory is constant
however long a pre-token is.

Decoding. A state machine takes ids one by one, looks up their bytes and
gives out text as soon as a code point is complete; bytes that are no UTF-8
become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .common import col

# The byte-level pre-token pattern, and the byte ranges that the
# byte-level alphabet writes as themselves (all others follow from U+0100 on).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

#: Pieces of text in each of the two generations of the cache, and the
#: longest piece that is kept.
CACHE = 250_000
CACHE_CHARS = 48


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte."""
    own = [b for a, z in PRINTED for b in range(a, z + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder of one byte-level BPE vocabulary (the JSON of the
    tokenizers library)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model, pre = j["model"], j["pre_tokenizer"]
        if (
            model["type"] != "BPE" or j.get("normalizer") or model.get("ignore_merges") or model.get("dropout")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True)
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in j["added_tokens"])
        ):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        for text, i in self.added.items():
            known = all(c in alphabet for c in text)
            self.bytes_of[i] = bytes(alphabet[c] for c in text) if known else text.encode()
        self.added_pattern = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
            if self.added else None
        )
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # rank[a][b]: place of the merge of a and b in the list
        self.rank: list[dict[int, int]] = [{} for _ in range(max(self.bytes_of) + 1)]
        self.result: list[int] = []
        for a, b in pairs:
            self.rank[vocab[a]].setdefault(vocab[b], len(self.result))
            self.result.append(vocab[a + b])
        self.none = len(self.result)
        self.merges = [(vocab[a], vocab[b]) for a, b in pairs]
        self.lookahead = self.sufficient_lookahead()
        longest = max(map(len, self.bytes_of.values()))
        self.window = max(256, 2 * self.lookahead + 2 * longest)
        self.digits = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.lines = re.compile(r"(?<=\S)\n(?=\S)").split
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes before the end of the known text in which tokens may still
        change.

        Where the known text ends, a merge (u, v) of u with something beyond
        may or may not happen. This moves the border between settled and
        open symbols left by u. It can only be moved further by a later merge
        (x, y) whose y starts with u: whose left spine holds u. The longest
        such chain of merges with rising ranks, in bytes of their left parts,
        bounds how far any continuation reaches; the symbol that the border
        is in is added.
        """
        left: dict[int, int] = {}  # the left part of the first merge that makes a symbol
        reach: dict[int, int] = {}  # by left part: the furthest chain so far that ends in it
        far = 0
        for r, (a, b) in enumerate(self.merges):
            at, most = b, 0
            while True:
                most = max(most, reach.get(at, 0))
                if at not in left:
                    break
                at = left[at]
            chain = len(self.bytes_of[a]) + most
            reach[a] = max(reach.get(a, 0), chain)
            left.setdefault(self.result[r], a)
            far = max(far, chain)
        return far + max(map(len, self.bytes_of.values()))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a sequence of symbols: each time the pair of the
        lowest rank, the leftmost of them."""
        rank, none, result = self.rank, self.none, self.result
        ranks = [rank[a].get(b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i] = new = result[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank[ids[i - 1]].get(new, none)
            if i < len(ranks):
                ranks[i] = rank[new].get(ids[i + 1], none)
        return ids

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """The ids of a pre-token's bytes, in lists, each as soon as it is
        stable."""
        at = 0
        while len(data) - at > self.window:
            part = data[at : at + self.window]
            stable, out = len(part) - self.lookahead, []
            for i in self.merge(list(map(self.first.__getitem__, part))):
                stable -= len(self.bytes_of[i])
                if stable < 0:
                    break
                out.append(i)
                at += len(self.bytes_of[i])
            yield out
        yield self.merge(list(map(self.first.__getitem__, data[at:] if at else data)))

    def kept(self, text: str, made) -> tuple[int, ...]:
        """made(text), from the cache if it is there: two generations, of
        which the older goes when the newer is full."""
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = tuple(made(text))
            if len(text) <= CACHE_CHARS:
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
                self.new[text] = found
        return found

    def pre_token(self, text: str) -> Iterator[int]:
        return chain.from_iterable(self.stream(text.encode("utf-8", "surrogatepass")))

    def piece(self, text: str) -> Iterator[int]:
        """Ids of a piece of text between two cuts."""
        found = self.find(text)
        if len(found) == 1:
            return self.pre_token(text)
        return chain.from_iterable(self.kept(t, self.pre_token) for t in found)

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, piece by piece. Between two characters that are
        no white space, a space always starts a pre-token and a line feed is
        one, so texts are cut there and pieces are kept by content."""
        make = self.piece
        for k, span in enumerate(self.added_pattern.split(text) if self.added_pattern else [text]):
            if k % 2:
                yield (self.added[span],)
                continue
            for row, line in enumerate(self.lines(span)):
                if row:
                    yield self.kept("\n", make)
                words = self.cut(line)
                if words[0]:
                    yield self.kept(words[0], make)
                get = self.new.get
                for word in words[1:]:
                    word = " " + word
                    found = get(word)
                    if found is None:
                        found = self.kept(word, make)
                        get = self.new.get
                    yield found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def decoder(self, errors: str = "replace") -> Callable[[Iterable[int], bool], str]:
        """A state machine: step(ids, last) gives the text that is complete
        after these ids. Ids outside the vocabulary give nothing."""
        state, get = codecs.getincrementaldecoder("utf-8")(errors), self.bytes_of.get
        return lambda ids, last=False: state.decode(b"".join([get(i, b"") for i in ids]), last)

    def decode(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        """Text of the ids, given out in parts as code points complete."""
        step, ids = self.decoder(errors), iter(ids)
        while part := list(islice(ids, 4096)):
            yield step(part)
        yield step((), True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the comma-joined ids, SHA-256 of the text that
        the ids decode to)."""
        ids_hash, out_hash, n, step = hashlib.sha256(), hashlib.sha256(), 0, self.decoder()
        pieces = self.pieces(text)
        while part := list(chain.from_iterable(islice(pieces, 2048))):
            ids_hash.update(("," * bool(n) + ",".join([self.digits[i] for i in part])).encode())
            out_hash.update(step(part).encode("utf-8", "surrogatepass"))
            n += len(part)
        out_hash.update(step((), True).encode("utf-8", "surrogatepass"))
        return n, ids_hash.hexdigest(), out_hash.hexdigest()


_BUILT: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    if spec not in _BUILT:
        _BUILT.clear()
        _BUILT[spec] = Tokenizer(spec)
    return _BUILT[spec]


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, make, names: list[str], types: list) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        spec = f.read()  # a vocabulary: its size is fixed, whatever the data
    Tokenizer(spec)  # unsupported files fail here
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value)
        for b in common.slices(batches):
            made = [make(t, x) for x in b.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", *names])

    chosen = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("x"))
    return chosen.mapInArrow(run, "doc_id long, " + schema)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text.

    Null and empty texts have no ids. Rows keep their number; other columns
    are not read.
    """
    return _mapped(docs, path, id_col, text_col, "ids array<int>",
                   lambda t, x: (t.encode(x or ""),), ["ids"], [pa.list_(pa.int32())])


def bpe_decode(docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give an empty text."""
    return _mapped(docs, path, id_col, ids_col, "text string",
                   lambda t, x: ("".join(t.decode(x or ())),), ["text"], [pa.string()])


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and
    its ids decoded again, as hashes of the comma-joined ids and of the text
    in UTF-8. Null and empty texts: 0 tokens, hashes of the empty string.
    Texts of any length are streamed whole. Repeated rows give repeated rows,
    an empty table none; further columns are not read."""
    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda t, x: t.digest(x or ""), ["n_tokens", "ids_sha256", "decoded_sha256"],
                   [pa.int64(), pa.string(), pa.string()])
