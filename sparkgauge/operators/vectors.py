"""Similarity join of vectors by metric pivots.

Vectors are compared as whole numbers (256 times a component, rounded down), so that a pair is similar or not on every engine.  Their
distance on the unit sphere is a metric, so two vectors within r of each other lie within r of each other seen from any pivot.  The
distances to two pivots of a block cut it into rings of width r, and only rings that touch meet; the distances to further pivots
skip pairs of chunks that lie apart; what is left is checked exactly.

Equal vectors are one class, whose members never meet.  A ring of any size is cut into chunks of bounded rows, and each pair of
chunks is a task of its own, which sends out a count a class and no pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.functions.hashing import hash52
from sparkgauge.session import stored

PIVOTS = 6
CHUNK = 1024
SLACK = 1e-6  # far more than the distances' rounding


def whole(vector: str) -> Column:
    """256 times each component, rounded down; null for a vector with a null or non-finite component."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def classes(df: DataFrame, id_col: str, vector: str, block: str) -> DataFrame:
    """id, key, class_id, block, q: a class is the rows of a block with one vector, class_id the smallest id among them.

    ``key`` tells classes apart, also where ids repeat; it, class_id and q are null where the vector is undefined.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(block).alias("block"), whole(vector).alias("q"))
    rows = rows.withColumn("key", F.when(F.col("q").isNotNull(), F.md5(F.to_json(F.struct("block", "q")).cast("binary"))))
    least = rows.where(F.col("q").isNotNull()).groupBy("key").agg(F.min("id").alias("class_id"))
    return rows.join(least, "key", "left").select("id", "key", "class_id", "block", "q")


def similar_classes(found: DataFrame, threshold: Fraction) -> DataFrame:
    """key, n_links of the classes of ``classes`` that are similar to another one of their block: cosine of ``threshold`` or more."""
    top, bottom = threshold.numerator, threshold.denominator
    radius = float(np.sqrt(2 - 2 * float(threshold))) + SLACK
    one = found.where(F.col("q").isNotNull()).groupBy("key").agg(F.first("block").alias("block"), F.first("q").alias("q"))
    one = one.withColumn("n", _dot(F.col("q"), F.col("q"))).where("n > 0")
    one = stored(one.withColumn("block", F.to_json(F.struct("block"))))
    pivots = one.groupBy("block").agg(F.array(*[F.min_by(F.struct("q", "n"), hash52(s, "key")) for s in range(PIVOTS)]).alias("p"))
    away = F.transform("p", lambda p: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * _dot(F.col("q"), p["q"]) / F.sqrt(F.col("n").cast("double") * p["n"]))))
    placed = one.join(pivots, "block").withColumn("away", away).drop("p")
    ring = lambda k: F.floor(F.col("away")[k] / radius)
    placed = placed.withColumn("ring", F.struct(ring(0).alias("i"), ring(1).alias("j")))
    rings = placed.groupBy("block", "ring").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = stored(placed.join(rings, ["block", "ring"]).withColumn("chunk", hash52("chunk", "key") % F.col("chunks")))
    # a table of chunks: which of them meet, each pair once
    nodes = placed.groupBy("block", "ring", "chunk").agg(*[f(F.col("away")[k]).alias(f"{n}{k}") for k in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    key = lambda: F.struct("ring", "chunk")
    near = F.struct((F.col("ring.i") + F.col("s.i")).alias("i"), (F.col("ring.j") + F.col("s.j")).alias("j"))
    left = nodes.select(F.col("block").alias("lb"), key().alias("u"), F.col("ring"), F.explode(steps).alias("s"), *[F.col(f"{n}{k}").alias(f"l{n}{k}") for k in range(PIVOTS) for n in ("lo", "hi")]).withColumn("near", near)
    right = nodes.select(F.col("block").alias("rb"), F.col("ring").alias("rr"), key().alias("v"), *[f"{n}{k}" for k in range(PIVOTS) for n in ("lo", "hi")])
    touch = left.join(right, (F.col("lb") == F.col("rb")) & (F.col("near") == F.col("rr"))).where(F.col("u") <= F.col("v"))
    for k in range(PIVOTS):
        touch = touch.where((F.col(f"llo{k}") <= F.col(f"hi{k}") + radius) & (F.col(f"lo{k}") <= F.col(f"lhi{k}") + radius))
    # a chunk that meets itself comes once
    touch = touch.select(F.col("lb").alias("block"), "u", "v")
    sides = touch.select("block", "u", "v", F.col("u").alias("at"), F.lit(0).alias("side")).unionByName(
        touch.where(F.col("u") != F.col("v")).select("block", "u", "v", F.col("v").alias("at"), F.lit(1).alias("side"))
    )
    sent = placed.withColumn("at", key()).select("block", "at", "key", "q", "n").join(sides, ["block", "at"])

    def counted(table: pa.Table) -> pa.Table:
        own, other = (table.filter(pa.compute.equal(table.column("side"), s)) for s in (0, 1))
        itself = other.num_rows == 0
        other = own if itself else other
        a, b = (_matrix(t.column("q")) for t in (own, other))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
        na, nb = (t.column("n").to_numpy() for t in (own, other))
        dot = np.rint(a @ b.T).astype(np.int64)  # exact: sums of whole numbers below 2**53
        # dot / sqrt(na nb) >= top / bottom in whole numbers of any size
        close = (dot > 0) & ((bottom * dot.astype(object)) ** 2 >= top * top * na.astype(object)[:, None] * nb.astype(object)) if _large(na, nb, bottom) else (
            (dot > 0) & ((bottom * dot) ** 2 >= top * top * na[:, None] * nb)
        )
        if itself:
            np.fill_diagonal(close, False)
        ids = [own.column("key")] + ([] if itself else [other.column("key")])
        links = [close.sum(axis=1)] + ([] if itself else [close.sum(axis=0)])
        links = np.concatenate(links).astype(np.int64)
        ids = pa.concat_arrays([c for x in ids for c in x.chunks])
        some = np.flatnonzero(links)
        return pa.table([ids.take(pa.array(some)), pa.array(links[some])], names=["key", "n_links"])

    parts = sent.groupBy("block", "u", "v").applyInArrow(counted, "key string, n_links bigint")
    return parts.groupBy("key").agg(F.sum("n_links").alias("n_links"))


def _large(na: np.ndarray, nb: np.ndarray, bottom: int) -> bool:
    return float(na.max()) * float(nb.max()) * bottom * bottom >= 2.0**62


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = rows.flatten().to_numpy()
    return out


def similar_vectors(df: DataFrame, id_col: str, vector: str, block: str, threshold: Fraction) -> DataFrame:
    """id, class_id, n_links: one row a row of ``df``.

    Rows of a block with equal vectors are a class, named by its smallest id; n_links counts the other classes of the block whose
    cosine with it is ``threshold`` or more (above 0).  Vectors that are null, hold null or non-finite components, or are 0 throughout are
    similar to nothing; the first two have no class.  Shorter vectors count as padded with 0.  A null block is a block like any other.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    found = stored(classes(df, id_col, vector, block))
    links = similar_classes(found, threshold)
    return found.join(links, "key", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
