"""Near sets by runs of neighbours: their pairs, what is shuffled and what stays on disk."""

import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from sparkgauge.operators import joins
from sparkgauge.plans import matching
from sparkgauge.session import stored


def runs(words, n):
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else {tuple(words)}


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        words = rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 90))
        rows.append((k, words))
        if k % 3 == 0:
            rows.append((100 + k, [w if rng.random() < 0.985 else "x" for w in words]))
    return rows + [(200, []), (201, []), (202, ["a", "b"]), (203, ["a", "b"]), (204, ["b", "a"]), (None, ["a", "b"]), (7, ["a", "b"])]


def test_near_runs_equal_all_pairs(spark, monkeypatch):
    """Runs of five words, shorter and empty texts, null and repeated ids, whatever the blocks and the bits."""
    rows = texts(4)
    df = spark.createDataFrame(rows, "id long, w array<string>")
    want = set()
    for (a, x), (b, y) in combinations([r for r in rows if r[0] is not None], 2):
        s, t = runs(x, 5), runs(y, 5)
        if a != b and len(s & t) >= 0.8 * len(s | t):
            want.add((min(a, b), max(a, b), round(len(s & t) / len(s | t), 9)))
    assert len(want) > 12 and {(200, 201, 1.0), (202, 203, 1.0), (7, 202, 1.0)} <= want
    for block, marks in ((joins.BLOCK, joins.MARKS), (3, 1 << 16)):
        monkeypatch.setattr(joins, "BLOCK", block)
        monkeypatch.setattr(joins, "MARKS", marks)
        out = joins.near_sets(df, F.col("w"), 0.8, 5)
        assert {(r.a, r.b, round(r.sim, 9)) for r in out.collect()} == want


def test_only_shared_hashes_are_kept(spark):
    rows = [(k, w) for k, (_, w) in enumerate(texts(5)[:80])]
    got = {r.k: (r.n, len(r.h)) for r in joins.shared_hashes(spark.createDataFrame(rows, "k long, w array<string>"), "k", F.col("w"), 5).collect()}
    sets = {k: runs(w, 5) for k, w in rows}
    common = {k: sum(any(e in t for j, t in sets.items() if j != k) for e in s) for k, s in sets.items()}
    assert got == {k: (len(sets[k]), c) for k, c in common.items() if c} and min(common.values()) == 0


def test_stored_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = blocks.getAllBlocks()
        return {found.apply(i).name() for i in range(found.size()) if found.apply(i).name().startswith("shuffle")}

    before = shuffled()
    assert len(stored(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_sides_read_their_texts_once(spark, tmp_path):
    """Texts meet their class in one stored table that both sides of the assignment and their equal texts read."""
    rows = [(k, f"some words of text number {k % 9} stand here") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    left, right, pairs = matching._sides(spark, str(tmp_path))
    assert sorted(map(tuple, left.collect())) == [(k, k % 9) for k in range(0, 30, 2)]
    assert {(x.a, x.b) for x in pairs.collect()} >= {(k, k) for k in range(9)}
    for side in (left, right, pairs):
        assert "text" not in side._jdf.queryExecution().optimizedPlan().toString()
