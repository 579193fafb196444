"""The candidate search lists its pairs."""

import random

import sparkgauge.plans.matching  # noqa: F401
from sparkgauge.operators import joins
from sparkgauge.plans.registry import QUERIES


def test_candidates_are_listed(spark, monkeypatch):
    """Every pair of a group, whatever the cells: repeated and null keys, null components, rows without a candidate."""
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), r.choice(["h", "h", "i", None]), r.choice(["en", "en", "de", None])) for _ in range(120)] + [(99, "only", "en")]
    df = spark.createDataFrame(rows, "id int, host string, lang string")
    answering = [x for x in rows if x[0] is None or x[0] % 3]
    expected = []
    for x in rows:
        own = [y[0] for y in answering if None not in (*x, *y) and y[1:] == x[1:] and y[0] != x[0]]
        expected += [(*x, c) for c in own or [None]]
    for size in (joins.CELL, 2):
        monkeypatch.setattr(joins, "CELL", size)
        got = joins.with_candidates(df, df.where("id is null or id % 3 <> 0"), "id", ["host", "lang"]).select("id", "host", "lang", "cand")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_candidate_search_lists_the_pairs(spark, tmp_path):
    """What the search by remainders of the key (0 asks, 1 answers) listed, and all others."""
    hosts = ["http://a.example.com/en/", "https://b.example.com/en/", "https://b.example.org/en/", "http://none.test/en/", "ftp://c.example.com/en/", "https://b.example.com/"]
    rows = [(i, f"{hosts[i % 7 % 6]}{i}" if i % 13 else None) for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(x.page_id, x.cand) for x in QUERIES["j14_candidate_search"](spark, str(tmp_path)).collect()}
    group = lambda url: ("com" if "example.com" in url else "org" if "example.org" in url else "") if url and "/en/" in url else None
    pairs = {(a, b) for a, x in rows for b, y in rows if a != b and group(x) is not None and group(x) == group(y) and y.startswith("http")}
    assert {p for p in got if p[1] is not None} == pairs and {p[0] for p in got} == set(range(80))
    assert any(a % 10 == 0 and b % 10 == 1 and rows[a][1].startswith("https") for a, b in pairs)
