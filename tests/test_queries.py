"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import pytest

import sparkgauge.plans.agreement  # noqa: F401
import sparkgauge.plans.curves  # noqa: F401
import sparkgauge.plans.evaluation  # noqa: F401
import sparkgauge.plans.matching  # noqa: F401
import sparkgauge.plans.parsing  # noqa: F401
import sparkgauge.plans.splitting  # noqa: F401
from sparkgauge.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# the widest of each family; the driver compares them all
SOME = ["split_audit", "g3_fused_groups", "q2_plausibility", "q3_frame_flags", "q5_series_decision", "j3_recover_source", "j8_near_duplicates", "d8_bland_altman", "d15_stratified_error", "r2_average_precision", "r12_bootstrap_difference", "s5_label_lines", "g15_best_split", "j8_similar_vectors", "d24_enrichment", "d10_tost", "q13_run_check", "s2_polygons", "x1_log_stream"]


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(None if type(v).__name__ in ("NAType", "NaTType") else v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLES[name]).to_df())


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["stage", "key_name", "n_values", "overlapping", "missing", "verdict"]
    assert set(e.oracle_sql()) <= set(e.queries())
