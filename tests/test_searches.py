"""Seed search with coverage, overlaps of flag sets and band-matched samples against plain Python."""

import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from sparkgauge.functions.hashing import hash52
from sparkgauge.operators import grouping, stats


def test_seed_search_counts_what_is_missing(spark):
    r = random.Random(3)
    rows = [(f"g{g}" if g else None, r.choice("abc"), r.randrange(90) if r.random() < 0.9 else None) for g in range(12) for _ in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "grp string, f1 string, f2 long")
    shares = {"test": 0.2, "train": 0.8}
    got = {x.seed: x for x in grouping.seed_search(df, "grp", ["f1", "f2"], 20, shares).collect()}
    keys = {g: f"={g}" if g is not None else "null" for g in {x[0] for x in rows}}
    u = {(x.seed, x.k): x.u for x in spark.createDataFrame([(s, k) for s in range(20) for k in keys.values()], "seed long, k string").select("seed", "k", (hash52(F.col("seed"), "k") / float(2**52)).alias("u")).collect()}
    every = {(i, x[i]) for x in rows for i in (1, 2)}
    assert sorted(got) == list(range(20))
    for s in range(20):
        part = {g: "test" if u[s, k] < 0.2 else "train" for g, k in keys.items()}
        missing = sum(len(every - {(i, x[i]) for x in rows if part[x[0]] == p for i in (1, 2)}) for p in shares)
        error = sum(abs(sum(part[x[0]] == p for x in rows) / len(rows) - q) for p, q in shares.items())
        assert got[s].missing == missing and got[s].incomplete == int(missing > 0) and math.isclose(got[s].error, error, abs_tol=1e-12)


def test_flag_overlaps_equal_sets(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), *(r.random() < q if r.random() < 0.95 else None for q in (0.2, 0.5, 0.4, 0.0))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, a boolean, b boolean, c boolean, d boolean")
    names = ["a", "b", "c", "d"]
    sets = {"".join(s): s for n in (2, 3, 4) for s in combinations(names, n)}
    got = {(x.k, x.sets): x for x in stats.flag_overlaps(df, ["k"], {n: F.col(n) for n in names}, sets).collect()}
    assert len(got) == 2 * len(sets)
    for k in "xy":
        own = [x for x in rows if x[0] == k]
        carried = {n: {i for i, x in enumerate(own) if x[1 + names.index(n)]} for n in names}
        for label, s in sets.items():
            expected = len(own)
            for n in s:
                expected *= len(carried[n]) / len(own)
            x = got[k, label]
            assert x.observed == len(set.intersection(*(carried[n] for n in s))) and math.isclose(x.expected, expected, abs_tol=1e-9)
            assert x.enrichment is None if expected == 0 else math.isclose(x.enrichment, x.observed / expected)


def test_band_is_that_of_the_clean_pairs(spark):
    rows = [("me", 2.0, True), ("me", 8.0, True), ("me", 50.0, False), ("a", 1.0, True), ("a", 2.0, True), ("a", 9.0, True), ("b", 0.0, True), ("b", 5.0, False)]
    df = spark.createDataFrame(rows, "who string, x double, fine boolean")
    got = sorted((x.sample, x.who, x.x, x.lo, x.hi) for x in stats.band_matched(df, F.col("who") == "me", F.col("fine"), "x", "who").collect())
    assert [g[:3] for g in got if g[0] == "band"] == [("band", "a", 2.0), ("band", "b", 5.0)] and {g[3:] for g in got} == {(2.0, 8.0)}
    assert sum(g[0] == "all" for g in got) == 5 and sum(g[0] == "above_zero" for g in got) == 4
    none = stats.band_matched(df, F.col("who") == "me", F.lit(False), "x", "who").collect()
    assert {x.sample for x in none} == {"all", "above_zero"}


def test_zero_noise_round_trip(spark):
    """Without noise the methods agree fully; a constant bias shows in the bias and lowers the concordance."""
    rows = [("same", float(i), float(i)) for i in range(20)] + [("shifted", float(i), i + 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "run string, x double, y double")
    ccc = {x.run: x.c for x in df.groupBy("run").agg(stats.ccc("x", "y").alias("c")).collect()}
    ba = {x.run: x for x in stats.bland_altman(df, ["run"]).collect()}
    assert ccc["same"] == 1.0 and ba["same"].bias == 0.0 and ba["same"].inside == 100.0
    assert ccc["shifted"] < 1.0 and ba["shifted"].bias == 2.0 and ba["shifted"].sd == 0.0
