"""Replicates as vectors against plain loops over the replicates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import ranking, resample


def plain_ap(rows, n_gt, weight):
    """AP of (group, score, tp) with multiplicities, equal scores together."""
    owed = sum(n * weight.get(g, 0) for g, n in n_gt.items())
    if owed == 0:
        return None
    best = np.zeros(102)
    for score in {s for _, s, _ in rows}:
        over = [(weight.get(g, 0), tp) for g, s, tp in rows if s >= score]
        n, t = sum(w for w, _ in over), sum(w * tp for w, tp in over)
        if n:
            k = t * 100 // owed
            best[: k + 1] = np.maximum(best[: k + 1], t / n)
    return best[:101].sum() / 101


def frames(spark, runs):
    dets = [(run, g, float(s), tp) for run, (rows, _) in runs.items() for g, s, tp in rows]
    owed = [(run, g, n) for run, (_, n_gt) in runs.items() for g, n in n_gt.items()]
    return spark.createDataFrame(dets, "run string, g long, score double, tp int"), spark.createDataFrame(owed, "run string, g long, n_gt long")


def some_runs(seed, n=120, groups=15):
    r = random.Random(seed)
    out = {}
    for run in ("a", "b"):
        rows = [(r.randrange(groups), round(r.gauss(0, 1), 1 if run == "a" else 4), int(r.random() < 0.6)) for _ in range(n)]
        out[run] = (rows, {g: sum(tp for h, _, tp in rows if h == g) + r.randrange(3) for g in range(groups)})
    out["no truths"] = ([(1, 0.5, 0)], {1: 0})
    out["nothing found"] = ([], {0: 2, 1: 1})
    return out


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_replicates_equal_a_loop(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(resample, "CELL_ROWS", cell_rows)
    runs = some_runs(4)
    dets, owed = frames(spark, runs)
    vectors = resample.draw_vectors(owed, "g", 300, 5)
    weights = {x.g: np.frombuffer(x.w, np.uint8) for x in vectors.collect()}
    assert all(sum(int(w[b]) for w in weights.values()) == len(weights) for b in range(300))
    got = {(x.run, x.rep): x.ap for x in resample.replicated_ap(dets, owed, ["run"], "g", vectors).collect()}
    assert len(got) == 300 * len(runs)
    for (run, rep), ap in got.items():
        want = plain_ap(*runs[run], {g: int(w[rep]) for g, w in weights.items()})
        assert (ap is None) == (want is None) and (ap is None or math.isclose(ap, want, abs_tol=1e-12)), (run, rep)


def test_weights_of_one_give_average_precision(spark):
    dets, owed = frames(spark, some_runs(8))
    got = {x.run: x.ap for x in resample.replicated_ap(dets, owed, ["run"], "g", resample.unit_vectors(owed, "g")).collect()}
    want = {x.run: x.ap for x in ranking.average_precision(dets, owed.groupBy("run").agg(F.sum("n_gt").alias("n_gt")), ["run"]).collect()}
    assert got.keys() == want.keys() and all(got[k] is want[k] or math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_cluster_interval_of_ap_is_wider_than_naive_and_repeats(spark):
    r = random.Random(1)
    rows = []
    for g in range(25):  # a group is all easy or all hard
        easy = r.random() < 0.5
        rows += [(g, g * 12 + k, r.random() + (1 if easy else 0), int(r.random() < (0.95 if easy else 0.2))) for k in range(12)]
    dets = spark.createDataFrame([("x", *x) for x in rows], "run string, g long, item long, score double, tp int")

    def interval(unit, seed):
        owed = dets.groupBy("run", unit).agg(F.count(F.lit(1)).alias("n_gt"))
        out = resample.limits(resample.replicated_ap(dets, owed, ["run"], unit, resample.draw_vectors(dets, unit, 400, seed)), ["run"], "ap").first()
        return out.valid, out.lo, out.hi

    valid, lo, hi = interval("g", 3)
    _, naive_lo, naive_hi = interval("item", 3)
    assert valid == 400 and hi - lo > 1.5 * (naive_hi - naive_lo)
    assert interval("g", 3) == (valid, lo, hi) != interval("g", 4)


def test_mean_of_resampled_rows(spark):
    r = random.Random(6)
    values = [round(r.gauss(10, 3), 1) for _ in range(3000)] + [7.5] * 3000
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 2.0), (None, 3.0)], "k string, v double").repartition(3)
    got = {x.k: x for x in resample.bootstrap_mean(df, ["k"], "v", 2000, 1).collect()}
    half = 1.96 * np.std(values) / math.sqrt(len(values))
    a = got["a"]
    assert a.valid == 2000 and math.isclose(a.obs, np.mean(values), rel_tol=1e-12)
    assert math.isclose(a.hi - a.lo, 2 * half, rel_tol=0.12) and math.isclose((a.hi + a.lo) / 2, a.obs, abs_tol=half / 5)
    # a single row is drawn at least once in 63 of 100 replicates
    assert got["b"].lo == got["b"].hi == 2.0 and 0.55 < got["b"].valid / 2000 < 0.7 and got[None].obs == 3.0
    assert {x.k: x for x in resample.bootstrap_mean(df.repartition(1), ["k"], "v", 2000, 1).collect()}["b"] == got["b"]
    assert resample.bootstrap_mean(df.where("false"), ["k"], "v", 50, 1).count() == 0


def test_poisson_table():
    for mean in (1, 7, 1024):
        cdf = resample.poisson_cdf(mean)
        draws = np.searchsorted(cdf, (np.arange(200_000) + 0.5) / 200_000, "right")
        assert math.isclose(draws.mean(), mean, rel_tol=1e-3) and math.isclose(draws.var(), mean, rel_tol=1e-2)


def test_draws_in_windows_are_those_of_the_hash(spark, monkeypatch):
    """Each task draws whole replicates for all groups, in one byte a group and replicate: no row a draw."""
    import hashlib

    keys = list(range(3, 40))
    groups = spark.createDataFrame([(k,) for k in keys], "g int")
    want = {k: [0] * 12 for k in keys}
    for rep in range(12):
        for i in range(len(keys)):
            text = f"11|{len(str(rep))}:{rep}|{len(str(i))}:{i}"
            want[keys[int(hashlib.md5(text.encode()).hexdigest()[:13], 16) % len(keys)]][rep] += 1
    for room in (1 << 20, 3 * len(keys), 1):
        monkeypatch.setattr(resample, "DRAWN_BYTES", room)
        drawn = resample.draw_vectors(groups, "g", 12, 11)
        assert "explode" not in drawn._jdf.queryExecution().toString().lower()
        assert {r.g: list(r.w) for r in drawn.collect()} == want
    assert resample.draw_vectors(groups.where("false"), "g", 12, 11).count() == 0


def test_replicated_pairs_without_a_row_a_draw(spark, monkeypatch):
    """Medians, means and concordance of the drawn pairs, from vectors of draws, over many cells and equal values."""
    monkeypatch.setattr(resample, "CELL_ROWS", 8)
    r = random.Random(4)
    rows = [(i, round(r.gauss(10, 3), 4), round(r.gauss(11, 3), 4)) for i in range(120)] + [(i, 5.0, 6.5) for i in range(120, 180)] + [(180, None, None)]
    pairs = spark.createDataFrame(rows, "user long, x double, y double")
    vectors = resample.draw_vectors(pairs, "user", 500, 3).localCheckpoint()
    drawn = {x.user: np.frombuffer(x.w, np.uint8) for x in vectors.collect()}
    assert all(sum(w[k] for w in drawn.values()) == 181 for k in (0, 499))
    got = {x.rep: x for x in resample.replicated_pairs(pairs, "user", vectors).collect()}
    assert sorted(got) == list(range(500))
    for rep in range(0, 500, 7):
        x, y = (np.array([row[k] for row in rows[:-1] for _ in range(drawn[row[0]][rep])]) for k in (1, 2))
        ccc = 2 * np.cov(x, y, bias=True)[0, 1] / (x.var() + y.var() + (x.mean() - y.mean()) ** 2)
        assert np.allclose([got[rep].med, got[rep].bias, got[rep].ccc], [np.median(y - x), (y - x).mean(), ccc], rtol=1e-9, atol=1e-9)
    assert resample.replicated_pairs(pairs.where("false"), "user", vectors).count() == 0
