"""Doubles as SQL engines that follow C++ treat them: rounding, ordered means, quotients by zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(c: Column | str, places: int = 6) -> Column:
    """The whole number nearest to ``c * 10**places`` (halves away from zero) over ``10**places``, as C++ engines round.

    Spark's ``round`` to decimal places reads the decimal text of a double, so that a double a bit below a tie goes up there and
    down here; to whole numbers the two agree.  Infinities and NaN stay as they are.
    """
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = float(10**places)
    return F.round(v * scale, 0) / scale


def ordered_sum(value: Column | str, order: Column | str) -> Column:
    """Aggregate: the sum of the non-null values added one after another in the order of ``order``; null without a value.

    A sum of doubles depends on its order in the last bit, and comparisons and ties on that bit.  This one is the same for any
    partitions.  It holds the values of a group together, so it is for small groups.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    o = F.col(order) if isinstance(order, str) else order
    held = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v")))))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x["v"]))


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` of doubles by IEEE 754: a zero divisor gives an infinity of the signs, or NaN for 0 / 0, not an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull() | F.isnan(a) | (a == 0), F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))
