"""The pivot join against all pairs."""

import math
import random
from fractions import Fraction

import pytest

from sparkgauge.operators import vectors


def brute(rows, threshold):
    q = {}
    for i, v, block in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault((block, tuple(math.floor(256 * x) for x in v)), []).append(i)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905

    def similar(a, b):
        d, top, bottom = dot(a, b), threshold.numerator, threshold.denominator
        return d > 0 and (bottom * d) ** 2 >= top * top * dot(a, a) * dot(b, b)

    links = {k: sum(k != o and k[0] == o[0] and similar(k[1], o[1]) for o in q) for k in q}
    out = []
    for i, v, block in rows:
        k = (block, tuple(math.floor(256 * x) for x in v)) if v is not None and all(x is not None and math.isfinite(x) for x in v) else None
        out.append((i, min((x for x in q[k] if x is not None), default=None), links[k]) if k else (i, None, 0))
    return sorted(out, key=str)


@pytest.mark.parametrize(("threshold", "noise"), [(Fraction(2, 5), 0.5), (Fraction(999, 1000), 0.02), (Fraction(1), 0.0)])
def test_equals_all_pairs(spark, monkeypatch, threshold, noise):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    r = random.Random(11)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(260):
        c = r.choice(centres)
        rows.append((i if i % 31 else None, [x + r.gauss(0, noise) for x in c], r.choice(["a", "a", "b", None])))
    rows += [(1000 + i, rows[5][1], "a") for i in range(40)] + [(5, rows[9][1], "a"), (5, rows[10][1], "b")]
    rows += [(2000, None, "a"), (2001, [None] * 12, "a"), (2002, [float("nan")] * 12, "a"), (2003, [0.0] * 12, "a"), (2004, [0.0] * 12, "a"), (2005, [], "a"), (2006, rows[3][1][:4], "a")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "id long, v array<double>, grp string, n_links int").repartition(3)
    got = vectors.similar_vectors(df, "id", "v", "grp", threshold)
    assert got.columns == ["id", "class_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, threshold)
    assert vectors.similar_vectors(df.where("false"), "id", "v", "grp", threshold).count() == 0


def test_threshold_must_be_above_zero(spark):
    with pytest.raises(ValueError):
        vectors.similar_vectors(spark.createDataFrame([], "id long, v array<double>, grp string"), "id", "v", "grp", Fraction(0))
