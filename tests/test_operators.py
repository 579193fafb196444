"""Metric cases with known answers."""

import math
import random

from pyspark.sql import functions as F

from sparkgauge.operators import grouping, joins, ranking, resample, series, stats


def test_concordance_identity_shift_scale(spark):
    def of(pairs):
        return spark.createDataFrame(pairs, "x double, y double").agg(stats.ccc("x", "y").alias("c")).first().c

    base = [float(i) for i in range(1, 6)]
    assert math.isclose(of([(a, a) for a in base]), 1.0)
    assert of([(a, a + 10) for a in base]) < 0.2
    assert of([(a, 2 * a) for a in base]) < 1


def test_set_overlap_and_both_empty_rules(spark):
    rows = [(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "a"), (3, 2, "b"), (3, 3, "b"), (4, None, "a")]
    df = spark.createDataFrame(rows, "k int, cell int, side string")
    for empty in (1.0, 0.0):
        got = {r.k: r.iou for r in stats.set_iou(df, "k", "cell", "side", "a", "b", empty).collect()}
        assert got == {1: 1.0, 2: 0.0, 3: 1 / 3, 4: empty}


def test_tost_decides_by_margin(spark):
    df = spark.createDataFrame([("a", 0.01 * (i % 3 - 1)) for i in range(30)], "g string, d double")
    got = {r.margin: (r.equivalent, r.p) for r in stats.tost(df, ["g"], [0.001, 0.05], F.col("d")).collect()}
    assert got[0.05][0] and not got[0.001][0] and got[0.05][1] < 1e-6


def curve(spark, rows, scale=1.0):
    pts = series.points(spark.createDataFrame([(s, t, a * scale) for s, t, a in rows], "series string, tp int, v double"), "v")
    return series.closure(pts)


def test_closure_does_not_feel_a_constant_area_bias(spark):
    rows = [("s", 0, 40.0), ("s", 8, 30.0), ("s", 24, 10.0), ("t", 8, 3.0), ("u", 0, 5.0), ("z", 0, 0.0), ("z", 8, 1.0), ("n", 0, 10.0), ("n", 8, 40.0)]
    plain, scaled = ({(r.series, r.tp): r.closure for r in curve(spark, rows, k).collect()} for k in (1.0, 1.12))
    assert all(a is b is None or math.isclose(a, b, abs_tol=1e-12) for a, b in ((plain[k], scaled[k]) for k in plain))
    reasons = {r.series: r.reason for r in series.plausibility(curve(spark, rows)).collect()}
    assert reasons == {"s": "plausivel", "t": "sem_baseline", "u": "serie_1_ponto", "z": "baseline_zero", "n": "fora_[0,1]+nao_monotonica+salto_absurdo"}


def test_latest_wins_by_priority_then_sequence(spark):
    log = spark.createDataFrame([("a", 1, "ok", 5.0), ("a", 2, "pulada", None), ("b", 1, "pulada", None), ("b", 2, "invalida", None), ("c", 1, "ok", 1.0), ("c", 2, "fechada", None)], "key string, seq int, status string, v double")
    got = {r.key: (r.seq, r.status) for r in series.latest(log, "key", "status", "seq", ["v"]).collect()}
    assert got == {"a": (1, "ok"), "b": (2, "invalida"), "c": (2, "fechada")}


def ap(spark, dets, n_gt):
    d = spark.createDataFrame([("r", float(s), t) for s, t in dets], "run string, score double, tp int")
    t = spark.createDataFrame([("r", n_gt)], "run string, n_gt long")
    return ranking.average_precision(d, t, ["run"]).first().ap


def test_average_precision_cases(spark):
    assert ap(spark, [(1.0, 1)], 1) == 1.0
    assert ap(spark, [], 3) == 0.0
    assert ap(spark, [(0.9, 0)], 0) is None
    assert math.isclose(ap(spark, [(0.9, 1), (0.1, 0)], 1), 1.0)
    assert ap(spark, [(0.9, 0), (0.5, 1)], 1) < 1.0
    assert ap(spark, [(0.9, 1), (0.5, 0), (0.4, 0)], 1) > ap(spark, [(0.9, 0), (0.5, 0), (0.4, 1)], 1)


def test_greedy_matching_uses_each_truth_once(spark):
    rows = [("one", [(0.9, 1, 0.0), (0.8, 2, 0.0)], [0.0]), ("half", [(0.9, 1, 5.0)], [0.0]), ("none", [], [0.0, 1.0]), ("free", [(0.4, 1, 0.0)], [])]
    df = spark.createDataFrame(rows, "item string, dets array<struct<score: double, id: int, x: double>>, truths array<double>")
    gap = lambda d, t: F.abs(d["x"] - t)
    out = ranking.greedy_match(df, "dets", "truths", lambda d, t: F.greatest(F.lit(0.0), 20 - gap(d, t)) / (20 + gap(d, t)), [0.5, 0.75])
    got = {(r["item"], r.threshold): (r.tp, r.n_gt) for r in out.collect()}
    assert got["one", 0.5] == ([1, 0], 1) and got["none", 0.5] == ([], 2) and got["free", 0.5] == ([0], 0)
    assert got["half", 0.5] == ([1], 1) and got["half", 0.75] == ([0], 1)


def test_cluster_interval_is_wider_than_naive_and_repeats(spark):
    rows = [(g, g * 10 + k, float(g % 2)) for g in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "grp long, id long, v double")

    def cluster(seed):
        s = df.groupBy("grp").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).join(ranking.draws(df, "grp", 200, seed), "grp")
        r = resample.limits(s.groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m")), [], "m").first()
        return r.valid, r.lo, r.hi

    naive = resample.bootstrap_mean(df, [], "v", 200, 1).first()
    valid, lo, hi = cluster(1)
    assert valid == 200 and hi - lo > naive.hi - naive.lo
    assert cluster(1) == (valid, lo, hi) != cluster(2)


def test_split_quotas(spark):
    groups = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 23)) for i in range(n)], "k string, s string")
    got = {}
    for r in grouping.split_groups(groups, "k", "s", 1).collect():
        got.setdefault(r.s, []).append(r.partition)
    count = {s: tuple(p.count(x) for x in ("train", "val", "test")) for s, p in got.items()}
    assert count == {"a": (1, 0, 0), "b": (1, 0, 1), "c": (1, 1, 1), "d": (17, 3, 3)}


def test_one_to_one_matching(spark):
    r = random.Random(2)
    pairs = [(a, 100 + b, round(r.random(), 3)) for a in range(12) for b in range(12) if r.random() < 0.5]
    got = {(x.a, x.b) for x in joins.match_one_to_one(spark.createDataFrame(pairs, "a long, b long, sim double"), "a", "b", "sim").collect()}
    want, used = set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if ("a", a) not in used and ("b", b) not in used:
            want.add((a, b))
            used |= {("a", a), ("b", b)}
    assert got == want


def test_near_pairs_equal_all_pairs(spark):
    r = random.Random(3)
    sets = {i: {r.randrange(12) for _ in range(r.randrange(1, 9))} for i in range(40)}
    rows = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, e long")
    got = {(x.a, x.b) for x in joins.near_pairs(rows, "id", "e", 0.6).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-12}


def test_near_sets_shuffle_no_entries(spark):
    """Hashes that meet by chance or by place neither lose nor add pairs, and entries are only read for candidates."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    sets = {0: base[:60], 1: [*base[:57], "x", "y", "z"], 2: base[40:100], 3: [], 4: ["one"], 5: ["one"], 6: base[:48]}
    sets |= {k: rng.sample(base, 30) for k in range(7, 40)}
    rows = spark.createDataFrame([(k, v) for k, v in sets.items()], "id int, e array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    out = joins.near_sets(rows, F.col("e"), 0.8)
    assert {(x.a, x.b) for x in out.collect()} == want and (0, 1) in want and (4, 5) in want
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_greedy_match_finds_each_overlap_once(spark):
    """One look at a pair for all thresholds, and the best free truth of each threshold."""
    calls = []

    def overlap(d, t):
        calls.append(1)
        return 1 / (1 + F.abs(d["q"] - t))

    df = spark.createDataFrame([(1, [(0.9, 1, 1.0), (0.8, 2, 1.2), (0.7, 3, 5.0)], [1.1, 1.0, 9.0])], "item long, dets array<struct<score:double,id:int,q:double>>, truths array<double>")
    got = {r.threshold: (r.tp, r.n_gt) for r in ranking.greedy_match(df, "dets", "truths", overlap, [0.5, 0.95, 0.1]).collect()}
    assert got == {0.5: ([1, 1, 0], 3), 0.95: ([1, 0, 0], 3), 0.1: ([1, 1, 1], 3)} and len(calls) == 1
