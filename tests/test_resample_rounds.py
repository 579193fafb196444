"""Resampling in rounds and joined cells: nothing that grows is broadcast, and what is shuffled follows the rows."""

import random

from pyspark.sql import functions as F

from sparkgauge.operators import resample


def test_draws_are_not_broadcast(spark):
    groups = spark.createDataFrame([(k,) for k in range(300)], "g long")
    vectors = resample.draw_vectors(groups, "g", 1000, 3)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {len(x.w) for x in vectors.collect()} == {1000}


def test_cells_are_joined_in_order(spark):
    rng = random.Random(2)
    sizes = {k: rng.choice([1, 2, 3, 40, 9000]) for k in range(90)}
    points = spark.createDataFrame(list(sizes.items()), "cell long, c int").select(F.lit("r").alias("run"), "cell", F.explode(F.sequence(F.lit(1), "c")).alias("i"))
    got = sorted((x.old, x.new, x.n, x._parts) for x in resample._joined_cells(points.withColumn("old", F.col("cell")), ["run"]).groupBy("old", F.col("cell").alias("new"), "_parts").agg(F.count("i").alias("n")).collect())
    assert {x[0]: x[2] for x in got} == sizes and [x[1] for x in got] == sorted(x[1] for x in got)
    own = {}
    for old, new, n, parts in got:
        own.setdefault(new, []).append(n)
        assert parts == -(-n // resample.CELL_ROWS)
    assert all(len(v) == 1 or sum(v) <= resample.CELL_ROWS for v in own.values()) and len(own) < len(sizes) * 2 / 3


def test_rounds_of_replicates_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    dets = spark.createDataFrame([(k % 2, rng.randrange(20), rng.random(), rng.randrange(2)) for k in range(400)], "run int, g int, score double, tp int")
    truths = dets.select("run", "g").distinct().withColumn("n_gt", F.lit(12))
    vectors = resample.draw_vectors(dets, "g", 1000, 4).persist()
    replicas = lambda: sorted(map(tuple, resample.replicated_ap(dets, truths, ["run"], "g", vectors).collect()))
    whole = replicas()
    rounds = []
    one = resample._ap_round
    monkeypatch.setattr(resample, "_ap_round", lambda *x: rounds.append(x[-1]) or one(*x))
    monkeypatch.setattr(resample, "ROUND_BYTES", 1)
    assert replicas() == whole and rounds == [0, 250, 500, 750] and len(whole) == 2000


def test_partial_sums_meet_by_cell(spark, monkeypatch):
    """A block gets a row for each cell, or each part of one, besides the moments of the tasks."""
    rng = random.Random(6)
    pairs = spark.createDataFrame([(k, 0.0, rng.choice([0.5, rng.random()])) for k in range(3000)], "g long, x double, y double").repartition(16)
    seen = []
    put = resample.stored
    monkeypatch.setattr(resample, "CELL_ROWS", 512)
    monkeypatch.setattr(resample, "stored", lambda df: seen.append(put(df)) or seen[-1])
    got = resample.replicated_pairs(pairs, "g", resample.unit_vectors(pairs, "g")).collect()
    values = sorted(x.y for x in pairs.collect())
    assert len(got) == 1 and abs(got[0].med - (values[1499] + values[1500]) / 2) < 1e-12
    sums = next(df for df in seen if df.columns == ["cell", "block", "n", "m"])
    points = next(df for df in seen if "_parts" in df.columns)
    assert sums.where("cell is not null").count() <= points.select("cell", "_parts").distinct().agg(F.sum("_parts")).first()[0]
