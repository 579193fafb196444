"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row number ``r`` in [0, N) goes to place ``p = permute(r)``; its shard is ``p mod shards`` and its
slot ``p div shards``.  Places are a bijection of [0, N), so shard sizes differ by one row at most and
slots have no gaps, and anybody who knows (N, seed, rounds) can compute a row's place alone.

Row numbers come without a global sort: rows fall into even hash buckets, each bucket gets the number of
rows in earlier buckets as its offset, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 20_000
WALK_LIMIT = 64


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square domain a x b that holds n places."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _rounds(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    """One pass of the generalised Feistel network over [0, a*b); even number of rounds."""
    left, right = F.pmod(x, F.lit(a)), F.call_function("div", x, F.lit(a))
    for j in range(rounds):
        side = a if j % 2 == 0 else b
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(j)), F.lit(side)), F.lit(side))
    return left + right * F.lit(a)


def permute(x: Column, n: int, seed: int = 17, rounds: int = 4) -> Column:
    """Place of row number ``x``: passes repeat until the value lies in [0, n) (cycle walking).

    A walk meets every place outside [0, n) once at most, so ``a*b - n + 1`` passes always end it;
    beyond ``WALK_LIMIT`` passes (chance below 2**-64 per row for the domains where that is less) the row fails loudly.
    """
    if rounds < 2 or rounds % 2:
        raise ValueError("rounds must be even")
    a, b = sides(n)
    walk = min(a * b - n + 1, WALK_LIMIT)
    one = _rounds(x, a, b, seed, rounds)
    if walk == 1:
        return one
    again = F.aggregate(
        F.sequence(F.lit(2), F.lit(walk)), F.col("_once"),
        lambda y, _: F.when(y < F.lit(n), y).otherwise(_rounds(y, a, b, seed, rounds)),
    )
    return F.when(F.col("_once") < F.lit(n), F.col("_once")).otherwise(again)


def number_rows(df: DataFrame, keys: list[Column], rows: int, name: str) -> DataFrame:
    """Global row numbers 0.. in an order fixed by the key columns alone (ties are equal rows)."""
    bits = max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET))))
    df = df.withColumn("_h", F.xxhash64(*keys))
    df = df.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each ROWS_PER_BUCKET rows: coarse groups first, so that no task orders them all
    counts = counts.withColumn("_c", F.shiftright("_b", 12))
    coarse = counts.groupBy("_c").agg(F.sum("_n").alias("_cn"))
    base = coarse.select("_c", F.coalesce(F.sum("_cn").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_in", inside).join(base, "_c").select("_b", (F.col("_base") + F.col("_in")).alias("_offset"))
    order = Window.partitionBy("_b").orderBy("_h", *keys)
    return (
        df.join(offsets, "_b")
        .withColumn(name, (F.col("_offset") + F.row_number().over(order) - 1).cast("bigint"))
        .drop("_h", "_b", "_offset")
    )


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards: doc_id, size, text_crc32, row_no, place, shard, slot.

    A null text has size 1 and the crc32 of the empty text (0); null ids and repeated rows are rows like any
    other (rows equal in id and text may swap places); an empty table gives an empty result.  Other columns
    of the input are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
    )
    n = rows.count()
    numbered = number_rows(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n, "row_no")
    a, b = sides(n)
    placed = numbered.withColumn("_once", _rounds(F.col("row_no"), a, b, seed, rounds))
    placed = placed.withColumn("place", permute(F.col("row_no"), n, seed, rounds))
    placed = placed.withColumn("place", F.when(F.col("place") < n, F.col("place")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint")))
    return placed.drop("_once").withColumns({
        "shard": F.pmod(F.col("place"), F.lit(shards)).cast("int"),
        "slot": F.call_function("div", F.col("place"), F.lit(shards)).cast("bigint"),
    })
