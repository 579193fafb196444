"""Operators 2, 3, 4, 6 and 10, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkgauge.llm import decontamination, feistel_sharding, language_id, nra_topk, sanitise

WORDS = [a + b for a in ("ka", "to", "mi", "ren", "sul", "vo", "gri") for b in ("na", "pe", "ri", "sto", "lu")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefghij") for _ in range(n))


def test_shards_are_a_permutation(spark):
    rows = [(i % 50 if i % 9 else None, None if i % 11 == 0 else f"text {i}", 3) for i in range(1000)] + [(1, "same", 3)] * 40
    out = feistel_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 16).collect()
    assert sorted(r.place for r in out) == list(range(len(rows))) == sorted(r.row_no for r in out)
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    for n in (1, 2, 3, 5, 16, 17, 99):
        part = feistel_sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 4).collect()
        assert sorted(r.place for r in part) == list(range(n))
    assert feistel_sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_finds_edited_passages(spark):
    items = [(k, prose(100 + k, 40)) for k in range(12)] + [(50, None), (51, "too short"), (None, prose(99, 30))]
    r = random.Random(1)
    edited = items[3][1].upper().split(" ")
    edited[10] = edited[25] = "other"
    docs = [(0, prose(1, 300)), (1, prose(2, 80) + " " + items[0][1] + " " + prose(3, 50)), (2, "* " + " ".join(edited)), (3, None), (4, ""), (5, "too short"), (6, items[5][1][:60]), (7, prose(8, 20) + "\n" + items[14][1])]
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x["items"] for x in decontamination.find_items(d, b).collect()}
    assert got == {0: [], 1: ["0"], 2: ["3"], 3: [], 4: [], 5: [], 6: [], 7: ["None"]}
    kept = decontamination.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [0, 3, 4, 5, 6]
    assert decontamination.find_items(d, b.where("false")).where("size(items) > 0").count() == 0
    assert decontamination.find_items(d.where("false"), b).count() == 0
    # recall of the candidate search on edited items, against exact verification
    found = 0
    looked = decontamination.Items([(str(k), t) for k, t in items[:12]], 0.75)
    for k in range(12):
        w = items[k][1].split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "edit"
        found += looked.find(pa.array([prose(7, 30) + " " + " ".join(w) + " " + prose(6, 30)]))[0] == [k]
    assert found >= 11


def test_stretch_distance():
    assert decontamination.stretch_distance("abcd", "xxabcdxx") == 0
    assert decontamination.stretch_distance("abcd", "xxabxdxx") == 1
    assert decontamination.stretch_distance("abcd", "") == 4


def test_languages(spark):
    r = random.Random(4)
    speak = {"aa": ["kata", "mora", "tana", "rako"], "bb": ["schid", "wunt", "bricht", "gelf"], "cc": ["oueaux", "eillon", "oise", "eurre"]}
    rows = [(i, " ".join(r.choice(speak[lang]) for _ in range(30)), lang) for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (None, rows[0][1], None), (903, rows[0][1] + " " + rows[1][1], None)]
    d = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {x.doc_id: x for x in language_id.identify(d).collect()}
    held = [x for x in rows[:150] if got[x[0]].held_out]
    assert held and sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) >= 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and {p.split(":")[0] for p in got[903].mixture.split(",")} == {"aa", "bb"}
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = language_id.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - 3
    assert {x.lang_pred for x in language_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(d.where("false")).count() == 0


def luhn(s):
    total = 0
    for i, c in enumerate(reversed([int(x) for x in s if x.isdigit()])):
        total += c if i % 2 == 0 else 2 * c - 9 * (c > 4)
    return total % 10 == 0


def base(text):
    digits = lambda m: sum(c in "0123456789" for c in m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text, re.A) if ok(m[0]))


def test_sanitisation(spark):
    r = random.Random(6)
    odd = ["", None, "🙂 a@b.c_d@e.f", "x@y", "300.1.2.3.4.5.6.7 and 1.2.3 4.5.6.7", "4111 1111 1111 1111-1", "4111-1111-1111-1111", "+1 (555) 123-4567 +12", "9" * 400, "a" * 5000 + "@b.cc", "001.02.3.255 256.1.1.1"]
    odd += ["".join(r.choice("0123456789 .-+@ab()_") for _ in range(80)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + k, f"{prose(k, 30)} write to Zorblatt boss@corp.example today {prose(50 + k, 30)}") for k in range(6)] + [(None, "hello again"), (None, "hello again")]
    d = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, email string").repartition(3)
    out = sanitise.sanitise(d)
    got = {x.doc_id: x for x in out.select("*", sanitise.listed(sanitise.KINDS).alias("said")).collect()}
    for i, t in rows:
        assert got[i].said == base(t or ""), (i, t)
    shown = got[1002].sanitised
    assert "Zorblatt" not in shown and "boss@" not in shown and "[EMAIL]" in shown
    assert out.count() == len(rows) and sanitise.sanitise(d.where("false")).count() == 0


def test_sanitisation_far_from_the_entity(spark):
    """A term reveals an entity of its document from any distance; letters of the entity itself are no terms."""
    far = " ".join(prose(90 + k, 60) for k in range(2))
    rows = [(k, f"Quuxington {prose(k, 40)} {far} mail boss@corp.example {prose(50 + k, 20)}") for k in range(6)] + [(100 + k, f"{prose(k, 40)} {far} {prose(50 + k, 20)}") for k in range(12)]
    got = {x.doc_id: x for x in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Quuxington" not in got[k].sanitised and "[EMAIL]" in got[k].sanitised for k in range(6))
    assert all({x.value.lower() for x in [*got[k].term, *got[k].gone]} == {"quuxington", "mail"} for k in range(6))
    assert all(got[100 + k].sanitised == dict(rows)[100 + k] for k in range(12))


def test_topk(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(300, 12)).round(2)
    x[10] = x[11]  # ties
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(300, None, 1), (301, [1.0, None] + [0.0] * 10, 1), (302, [float("nan")] * 12, 1), (303, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (5, rows[5][1], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nra_topk.topk(d, 5, F.col("vec_id") % 50 == 0).collect()}
    e = np.floor(256 * x).astype(int)
    want = {}
    for q in range(0, 300, 50):
        s = e @ e[q]
        best = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        want |= {(q, k + 1): (int(i), int(s[i])) for k, i in enumerate(best)}
    assert got == want
    few = nra_topk.topk(d.where("vec_id in (0, 1, 2)"), 5, F.col("vec_id") % 50 == 0)
    assert few.count() == 2 and nra_topk.topk(d.where("false"), 5, F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import hashlib

    import corpus_pipeline

    item = prose(77, 40)
    keep = [(k, prose(k, 60), "aa", "s", 1) for k in range(8)]
    rows = keep + [
        (20, keep[0][1], "aa", "s", 1),  # a copy: its only line is a repeat, what is left is empty
        (21, prose(21, 30) + " " + item, "aa", "s", 1), (22, "12 34", "aa", "s", 1), (23, None, None, None, None),
        (24, prose(24, 30) + "\n" + keep[1][1], "aa", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {k: t for k, t, *_ in keep} | {20: "", 24: prose(24, 30)}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_nra_reads_for_many_queries_at_once(monkeypatch):
    """Bounds are found once a depth and batch, not once a query; answers are those of all scores."""
    import numpy as np

    monkeypatch.setattr(nra_topk, "BATCH", 16)
    r = np.random.default_rng(2)
    x = r.integers(-9, 9, (400, 6))
    ids = r.permutation(4000)[:400]
    query_ids, q = np.concatenate([ids[:20], np.arange(5000, 5020)]), np.concatenate([x[:20], r.integers(-9, 9, (20, 6))])
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or partition(*a, **k))
    got = sorted(nra_topk.block_topk(ids, x, query_ids, q, 5))
    want = [(int(i), v, -s) for i, own in zip(query_ids, q, strict=True) for s, v in sorted((-int(own @ y), int(v)) for v, y in zip(ids, x, strict=True) if v != i)[:5]]
    assert got == sorted(want) and len(calls) <= 5 * 3
