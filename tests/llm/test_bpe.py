import hashlib
import random

import public_tokenizers
import pytest
from llm_cases import odd_rows
from tokenizers import Tokenizer as Library

from curbscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a" * 20_000, "ab" * 7000, "-=" * 3000, "\n" * 3000, " " * 2000 + "x", "é" * 6000, "<|endoftext|>x<|endoftext|><|endoftext|>",
       "<|endoftext|", "don't I'LL we'll\x1c\x1d\x85 　x", ""]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def random_texts(n=1500):
    rng = random.Random(2)
    alphabet = list("aAbeéñ ß  \n\t\r'stre.,!0129½\x85　日本語🙂‍﻿\x00") + ["<|endoftext|>", "'ll", " 're", " the", "ing"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_text_equal_the_library(own, library):
    for text in ODD + random_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert "".join(own.decode(ids)) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_like_the_library(own, library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]
        assert "".join(own.decode(ids)) == library.decode(ids, skip_special_tokens=False)


def test_the_window_does_not_change_tokens(own, library, monkeypatch):
    rng = random.Random(6)
    word = "".join(rng.choice("aehinorst") for _ in range(8000))
    monkeypatch.setattr(own, "window", own.lookahead + 130)
    assert [i for part in own.stream(word.encode()) for i in part] == library.encode(word, add_special_tokens=False).ids


def test_a_small_cache_gives_the_same(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    for text in random_texts(100):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_rows(make_docs, library):
    rows = odd_rows()
    got = bpe.bpe_digest(make_docs(rows), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_digest(make_docs([]), PATH).count() == 0


def test_encode_then_decode(make_docs):
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(random_texts(50))])
    back = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text) for r in docs.collect())
