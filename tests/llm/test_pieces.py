"""Operators 5 and 8 against the public libraries, on odd texts."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from sparkgauge.llm import dac_tokens, duckdb_bpe

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, " ", "\n\n x", "a\x1cb \x1d c", "x² ½Ⅷ٣", "it's I'LL 's", "é नमस्ते 日本 🙂🙂", "a" * 1500, " " * 300 + "x", "\x85\x85a", "12345.67", "the the the"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").repartition(3)


def test_encode_equals_tiktoken_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in duckdb_bpe.encode(documents(spark, ODD), path, P.PATTERN).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = plain.encode_ordinary(t or "")
        assert got[i].ids == ",".join(map(str, ids)) and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert duckdb_bpe.encode(documents(spark, ["x"]).where("false"), path, P.PATTERN).count() == 0


def test_files_hold_the_tokenizers_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "ends <|endoftext|> here"]
    got = {r.doc_id: r for r in dac_tokens.round_trip(documents(spark, texts), path, 2, files=3).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert dac_tokens.round_trip(documents(spark, ["x"]).where("false"), path, 2).count() == 0


def test_direct_access_reads_any_token():
    ids = np.random.default_rng(5).integers(0, 2**20, 3000).astype(np.uint32)
    ids[::3] %= 200
    packed = dac_tokens.pack(ids)
    assert (dac_tokens.unpack(*packed[:2]) == ids).all()
    assert all(dac_tokens.token_at(*packed, i) == ids[i] for i in range(0, 3000, 7))
    with pytest.raises(IndexError):
        dac_tokens.token_at(*packed, 3000)
