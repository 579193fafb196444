"""Doubles bit by bit as the SQL has them: ties of rounding, order of sums, quotients by zero, quantiles between two values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import sparkgauge.plans.agreement  # noqa: F401
import sparkgauge.plans.curves  # noqa: F401
from sparkgauge.functions.numbers import ordered_sum, quotient, rounded
from sparkgauge.operators.ordering import percentiles
from sparkgauge.plans.registry import ORACLES, QUERIES


def folder_of(spark, path, rows):
    """events of (event_id, user_id, value), all of the first week."""
    ts = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(i, ts, u, "view", v) for i, u, v in rows], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.repartition(3).write.parquet(f"{path}/events.parquet")
    return str(path)


def twin(d, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"create table events as select * from '{d}/events.parquet/*.parquet' order by event_id")
    return con.sql(ORACLES[name])


def same(spark, d, name):
    want = twin(d, name)
    got = sorted((tuple(r) for r in QUERIES[name](spark, d).select(*want.columns).collect()), key=repr)
    plain = lambda rows: [tuple(None if v != v else float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows]
    assert plain(got) == plain(sorted(want.fetchall(), key=repr))


def test_rounding_reads_the_double(spark):
    values = [0.7846615, 0.1234565, -0.0489125, 0.5102125, 1.0000005, 2.5e-7, float("inf"), None]
    duckdb = pytest.importorskip("duckdb")
    want = [duckdb.sql(f"select round({v!r}::double, 6)").fetchall()[0][0] if v is not None and v < 1e300 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(rounded("v").alias("v")).collect()
    assert [r.v for r in rows] == want


def test_sum_order(spark):
    rows = [(i, v) for i, v in enumerate([0.1, 0.2, 0.3, 1e16, -1e16, 0.7])]
    df = spark.createDataFrame([*rows, (9, None)], "i int, v double").repartition(4)
    total = 0.0
    for _, v in rows:
        total += v
    assert df.agg(ordered_sum("v", "i").alias("s")).first().s == total
    assert df.where("v is null").agg(ordered_sum("v", "i").alias("s")).first().s is None


def test_quotient_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double")
    assert [str(r.q) for r in df.select(quotient(F.col("a"), F.col("b")).alias("q")).collect()] == ["inf", "-inf", "nan", "0.25", "None"]


def test_quantile_between_two_values(spark):
    df = spark.createDataFrame([(v,) for v in (0.0703, 0.2251, 0.8483)], "v double")
    assert percentiles(df, [], "v", {"p": 0.05}).first().p == 0.0703 * (1 - 0.05 * 2) + 0.2251 * (0.05 * 2)


@pytest.mark.parametrize("name", ["d12_sign_test", "d13_wilcoxon", "d16_negatives", "d19_envelope", "d23_clean_pairs", "d28_identical_share", "q9_ratio_qc"])
def test_means_and_medians_that_meet(spark, tmp_path, name):
    # equal steps: mean and median agree but for the last bit of the sum
    rows = [(5 * (7 * u + k), u, round(1.1 * u + 0.13 * ((3 * k) % 7), 2)) for u in range(1, 40) for k in range(7)]
    same(spark, folder_of(spark, tmp_path, rows), name)


@pytest.mark.parametrize("name", ["d14_error_report", "d27_substitution_effect"])
def test_medians_of_zero(spark, tmp_path, name):
    rows = [(5 * (3 * u + k), u, 0.0 if u < 4 or u == 10 else 10.0 * u + k * k) for u in range(1, 21) for k in range(3)]
    rows += [(5 * 100 + 5 * k, 20, v) for k, v in enumerate((0.0, 0.0, 0.0, 0.0, 7.0))]
    same(spark, folder_of(spark, tmp_path, rows), name)
