"""Guards, quarantine, frozen tables, run logs and names: what must pass and what must not."""

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import grouping, joins, parse, series


def test_synthetic_records_are_refused(spark):
    made = F.col("made")
    df = lambda *flags: spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, made boolean")
    assert joins.guarded_records(df(False, None, False), made).count() == 3
    assert joins.guarded_records(df(), made).count() == 0
    for flags in ((True, True), (True, False)):
        with pytest.raises(Exception, match="synthetic"):
            joins.guarded_records(df(*flags), made).collect()
        assert joins.guarded_records(df(*flags), made, allow=True).count() == 2


def test_quarantine_stops_at_protected_rows(spark):
    df = spark.createDataFrame([(1, "es"), (2, "en"), (3, "es"), (4, None), (None, "es")], "k int, lang string")
    used = spark.createDataFrame([(3,), (3,), (2,), (None,)], "k int")
    bad, why = F.col("lang") == "es", F.concat(F.lit("out:"), "lang")
    got = {x.k: (x.place, x.reason) for x in joins.quarantine(df, bad, why, used, "k", strict=False).collect()}
    assert got == {1: ("quarantine", "out:es"), 2: ("kept", None), 3: ("protected", "out:es"), 4: ("kept", None), None: ("quarantine", "out:es")}
    with pytest.raises(Exception, match="out of scope"):
        joins.quarantine(df, bad, why, used, "k").collect()
    assert joins.quarantine(df, bad, why, used.where("k = 2"), "k").count() == 5


def test_frozen_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "s string, v int")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), (None, 1)], "s string, n long")
    got = {x.s: (x.n, x.expected, x.matches) for x in joins.freeze(df, "s", ["v"], expected).collect()}
    assert got == {"a": (2, 2, True), "b": (1, 2, False), "c": (0, 1, False), None: (1, 1, True)}
    again = {x.s: x.digest for x in joins.freeze(df.orderBy(F.desc("v")), "s", ["v"], expected).collect()}
    assert again == {x.s: x.digest for x in joins.freeze(df, "s", ["v"], expected).collect()}


def test_candidate_groups_keep_every_row(spark):
    asks = spark.createDataFrame([(1, "h", "en"), (2, "h", None), (3, "x", "en")], "id int, host string, lang string")
    answers = spark.createDataFrame([(10, "h", "en"), (11, "h", "en"), (12, "y", "en")], "id int, host string, lang string")
    got = {x.id: (x.asks, x.n_asks, x.n_answers, x.first_answer) for x in joins.candidate_groups(asks, answers, "id", ["host", "lang"]).collect()}
    assert got == {1: (True, 1, 2, 10), 2: (True, 0, 0, None), 3: (True, 1, 0, None), 10: (False, 1, 2, 10), 11: (False, 1, 2, 10), 12: (False, 0, 1, 12)}


def test_conservation_can_fail(spark):
    total = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    for used, good in (([1, 2], True), ([1, 9], False), ([1, 1], False), ([], True)):
        got = grouping.conservation(total, spark.createDataFrame([(k,) for k in used], "k int"), "k").first()
        assert got.conserved == good and got.total == got.labelled + got.excluded == 3


def test_run_logs(spark):
    """Healthy, one coincidence, three in a row, interrupted, and not-a-number from the sixth epoch on."""
    def log(name, epochs=20, equal=(), lost=()):
        return [(name, e, float("nan") if e in lost else 0.5 - 0.01 * e, 0.3 + 0.01 * e, 0.3 + 0.01 * e if e in equal else 0.45 + 0.01 * e) for e in range(1, epochs + 1)]

    rows = log("healthy") + log("once", equal=(9,)) + log("three", equal=(9, 10, 11)) + log("short", epochs=7) + log("lost", lost=range(6, 21))
    df = spark.createDataFrame(rows, "run string, epoch int, loss double, iou double, dice double")
    got = {x.run: x for x in series.run_log(df, "run", "epoch", ["loss", "iou", "dice"], ("iou", "dice"), 20).collect()}
    assert {k: x.rejected for k, x in got.items()} == {"healthy": False, "once": False, "three": True, "short": True, "lost": True}
    assert (got["three"].degenerate, got["once"].degenerate, got["short"].stopped_early, got["lost"].nonfinite, got["lost"].first_nonfinite) == (3, 0, True, 15, 6)


def test_numeric_order(spark):
    rows = [("a", 0, 1, 1), ("a", 0, 2, 2), ("a", 1, 5, 1), ("a", 1, 6, 2), ("a", 1, 7, 3), ("b", 0, 1, 2), ("b", 0, 2, 1), ("b", 1, 1, 2), ("c", 0, 1, 1)]
    df = spark.createDataFrame(rows, "u string, tp int, seen int, snap int")
    got = {x.u: (x.timepoints, x.pos_consistent, x.temporal_equals_numeric) for x in series.numeric_order(df, "u", "tp", "seen", "snap").collect()}
    assert got == {"a": (2, True, True), "b": (2, True, False)}


def test_names_and_coordinates(spark):
    names = ["Snap-007 (3).TIF", "HUVEC_snap_12_24h.png", "snap 5", "A_Well  B2 (1).tif", "plain", "Snapshot"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.k for x in df.select(parse.norm_key(F.col("n")).alias("k")).collect()] == ["snap-7", "snap-12", "snap-5", "a well b2", "plain", "snapshot"]
    got = spark.range(1).select(parse.normalise_coords(F.array(F.lit(-4.0), F.lit(5.0), F.lit(30.0), F.lit(10.0), F.lit(None).cast("double")), F.lit(20.0), F.lit(10.0)).alias("c")).first().c
    assert got.coords == [0.0, 0.5, 1.0, 1.0, None] and got.clamped == 2
