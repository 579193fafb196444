"""Operator 8 on single pieces of any length."""

import random

import pytest

from sparkgauge.llm import duckdb_bpe

P = pytest.importorskip("public_tokenizers")


def test_heap_equals_the_query():
    r = random.Random(2)
    c = duckdb_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    common = [t for t in list(c.token.values())[:3000] if t.isalpha() and t.isascii()]
    words = ["".join(r.choice("etaoin") for _ in range(r.randrange(1, 40))) for _ in range(2000)]
    words += [b"".join(r.choice(common) for _ in range(r.randrange(1, 30))).decode() for _ in range(2000)] + ["a" * k for k in range(1, 60)] + ["é字" * 9, "a" * 999]
    assert [list(c.encode_long(w.encode())) for w in words] == c.encode_words(words).to_pylist()


def test_no_length_is_refused():
    r = random.Random(3)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = ["a" * (2**20 + 5), " " * (2**20 + 1) + "x", "".join(r.choice("etaoinshrdlu") for _ in range(2**20 + 9)) + " short", "字" * 5000]
    n, ids, raw = duckdb_bpe.encode_batch(texts, path, P.PATTERN)
    assert raw == [t.encode() for t in texts] and [x.count(",") + 1 for x in ids] == n
    assert ids[2].rsplit(",", 1)[1] == str(duckdb_bpe.encode_batch([" short"], path, P.PATTERN)[1][0])
