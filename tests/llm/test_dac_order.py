"""Operator 5 where ids repeat or are null: the start is the place in the files; and units against whole texts."""

import random

import public_tokenizers

from sparkgauge.llm import dac_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab cé.,'\n\r\t    　\x1c\x85 <|>x0_1２ä漢🙂\x00\x0b", "<|endoftext|>", " the", "don't", "  ", "\r\n", "'ll"]


def test_units_encode_like_whole_texts():
    from tokenizers import Tokenizer

    r = random.Random(8)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(1500)] + [None, "", "z" * 20_000]
    whole = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, dac_tokens.token_ids(texts, PATH), strict=True):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_start_is_the_place_in_the_files(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 2, 7]), " ".join(r.choice(["one", "two", "three words"]) for _ in range(r.randrange(0, 9)))) for _ in range(120)]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, place int").repartition(5)
    target = str(tmp_path / "t")
    dac_tokens.write(docs, target, PATH, 2, files=7)
    got = sorted((x.start, x.n_tokens, x.doc_id, x.ids_crc32) for x in dac_tokens.read(spark, target).collect())
    assert [x[0] for x in got] == [sum(y[1] for y in got[:k]) for k in range(len(got))]
    assert [x[2] for x in got] == sorted([x[0] for x in rows], key=lambda i: (i is not None, i or 0))
    files = sorted((x.f, x.place, x.n_tokens) for x in spark.read.parquet(target).selectExpr("_metadata.file_name as f", "place", "n_tokens").collect())
    assert [x[2] for x in files] == [x[1] for x in got] and len({x[0] for x in files}) > 3


def test_new_units_are_encoded_side_by_side(monkeypatch):
    """As many calls' worth of texts as there are blocks of units, not as there are units; and the ids of each unit alone."""
    r = random.Random(4)
    units = sorted({" " * r.randrange(0, 3) + "".join(r.choice("abcdé漢.'\x00") for _ in range(r.randrange(1, 9))) for _ in range(3000)} | {"  ", "\n", "\n x"})
    made, *more = dac_tokens._tokenizer(PATH)
    alone = [made.encode(u, add_special_tokens=False).ids for u in units]
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return made.encode_batch_fast(texts, **options)

    monkeypatch.setattr(dac_tokens, "_tokenizer", lambda path: (Counted(), *more))
    got = dac_tokens._unit_ids(units, PATH)
    assert [list(memoryview(x).cast("I")) for x in got] == alone
    led = sum(u[0] in " \n" and u.strip() != "" for u in units)
    assert len(asked) == len(units) - led + -(-led // dac_tokens.SIDE_BY_SIDE)
