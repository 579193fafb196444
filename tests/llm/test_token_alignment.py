"""Operator 13 against whole-text encodings, a walk over byte offsets and counts by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from sparkgauge.llm import token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"ab cé.,'\n\r\t    　\x1c\x85 <|>x0A_1２ä漢🙂\x00", "<|endoftext|>", "</s>", "<s>", "<0x0A>", "\r\n", "};\r\n", " the", "don't", "  "]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a, b = libraries()
    letters = token_alignment._byte_of_letter()
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        sides = []
        for ids, spell in (
            (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
            (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(spell(i)), i))
                at = spans[-1][1]
            sides.append(spans if b"".join(map(spell, ids)) == whole else None)
        if None in sides:
            found.append(None)
            continue
        links = [(x[2], y[2]) for x in sides[0] for y in sides[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in sides[0]} & {y[1] for y in sides[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in sides))
            low = cut
        found.append((len(sides[0]), len(sides[1]), groups, links))
    docs = Counter(p for x in found if x for p in set(x[3]))
    best = Counter()
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else
        (x[0], x[1], len(x[2]), len(x[3]), sum(docs[p] == best[p[0]] for p in x[3]), sum(docs[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest())
        for x in found
    ]


def test_units_encode_like_whole_texts():
    r = random.Random(5)
    own = token_alignment.pair(A_PATH, B_PATH)
    a, b = libraries()
    for _ in range(1500):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 30)))
        units = own.units(" " + text)
        assert "".join(units) == " " + text
        assert [i for e in own.a.encode_batch(units, add_special_tokens=False) for i in e.ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in own.encode_b(units) for i in ids] == b.encode(text)


def test_pointers_reach_the_terminal_token():
    r = random.Random(2)
    for _ in range(50):
        total = r.randrange(1, 60)
        ends = [sorted({*r.sample(range(1, total + 1), r.randrange(1, total + 1)), total}) for _ in range(2)]
        a_top, b_top = token_alignment.groups_of(*(np.diff([0, *e]) for e in ends))
        common = sorted(set(ends[0]) & set(ends[1]))
        for side, tops in zip(ends, (a_top, b_top), strict=True):
            assert [ends[0][t] for t in tops] == [next(c for c in common if c >= e) for e in side]


def test_rows_equal_brute_force(spark):
    r = random.Random(9)
    words = ["the", "token", "éclair", "unaffable", "2024", "don't", "x", "naïve", "漢字", "a_b", "};\r\n"]
    texts = [None, "", " ", "\n", "a", "under▁score", "<|endoftext|></s>", "z" * 5000, "same text here", "same text here", " ".join(r.choice(words) for _ in range(3000))]
    texts += ["".join(r.choice([*ALPHABET, *words, " "]) for _ in range(r.randrange(1, 40))) for _ in range(120)]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_a int, pair string").repartition(3)
    got = token_alignment.align(docs, A_PATH, B_PATH, chunk_bytes=300).collect()
    want = [(i, *row) for i, row in zip(ids, brute(texts), strict=True)]
    key = lambda x: tuple(str(v) for v in x)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(((*(x[k] for k in names),) for x in got), key=key) == sorted(want, key=key)
    assert token_alignment.align(docs.where("false"), A_PATH, B_PATH).count() == 0
    assert [tuple(x)[1:] for x in token_alignment.align(docs.where(F.col("text").isNull()), A_PATH, B_PATH).collect()] == [(0, 0, 0, 0, 0, 0, "")]
