"""Order statistics, hashing, components: the cases that a narrow implementation gets wrong."""

import math

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import beta
from sparkgauge.functions.hashing import hash52
from sparkgauge.operators import ordering
from sparkgauge.operators.components import components


def test_percentiles_keep_null_keys_empty_groups_and_infinities(spark):
    rows = [(None, 1.0, 1), (None, 3.0, 1), ("a", 1.0, 2), ("a", 5.0, 1), ("a", float("nan"), 1), ("a", 10.0, 1), ("b", None, 1), ("c", float("inf"), 1), ("c", float("-inf"), 1), ("c", 0.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {r.g: r.m for r in ordering.percentiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 7.5, "b": None, "c": 0.0}
    weighted = {r.g: r.m for r in ordering.percentiles(df.where("g = 'a' and not isnan(v)"), ["g"], "v", {"m": 0.5}, weight="w").collect()}
    assert weighted == {"a": 3.0}
    with pytest.raises(ValueError):
        ordering.percentiles(df, ["g"], "v", {"m": 0.5}, rule="liner")
    with pytest.raises(ValueError):
        ordering.percentiles(df, ["g"], "w", {"m": 0.5}, weight="v")


@pytest.mark.parametrize("shape", ["one", "dates", "ids", "heavy"])
def test_order_equals_windows_and_spreads(spark, shape):
    value = {"one": F.lit(3.0), "dates": F.lit(1.7e9) + F.col("id") * 60.0, "ids": F.col("id").cast("double"), "heavy": F.exp(F.col("id") / 40.0)}[shape]
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), value.alias("v"))
    got = {r.g: (r.a, r.b) for r in ordering.percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    assert all(math.isclose(x, y, rel_tol=1e-9) for g in want for x, y in zip(got[g], want[g], strict=True))
    ranked = ordering.rank_rows(df, ["g"], "v", ["id"], "rn").collect()
    for g in range(3):
        rows = sorted((r.v, r.id, r.rn) for r in ranked if r.g == g)
        assert [x[2] for x in rows] == list(range(1, len(rows) + 1))
    if shape != "one":
        most = ordering.cells(ordering._group(df, ["g"]), "v").groupBy("_g", "_cell").count().agg(F.max("count")).first()[0]
        assert most <= 0.02 * 4000


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), (None, 5.0)], "g string, v double")
    got = sorted((str(r.g), str(r.v), r.r) for r in ordering.average_ranks(df, ["g"], "v", "r").collect())
    assert got == [("None", "5.0", 1.0), ("a", "1.0", 1.0), ("a", "2.0", 2.5), ("a", "2.0", 2.5), ("a", "None", None)]


def test_hash_tells_parts_apart(spark):
    rows = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string").select(hash52(1, "x", "y").alias("h"))
    assert df.distinct().count() == len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {1000 + k: 1000 for k in range(1, 40)}


def test_tails(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    assert math.isclose(value(beta.t_tail(F.lit(2.0), F.lit(10))), 0.036694, abs_tol=1e-6)
    assert math.isclose(value(beta.t_tail(F.lit(-1.0), F.lit(3))), 1 - 0.195501, abs_tol=1e-6)
    assert math.isclose(value(beta.sign_test(F.lit(8), F.lit(2))), 0.109375, abs_tol=1e-9)
    assert value(beta.sign_test(F.lit(5), F.lit(5))) == 1.0
    assert math.isclose(value(beta.normal_tail(F.lit(1.96))), 0.0249979, abs_tol=1e-6)
