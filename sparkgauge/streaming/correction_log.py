"""The correction log as a stream (X1): the outcome that counts of each key, kept as state while rows arrive.  NaN counts as null.

Priority and order are those of the batch operator (W1): a resolved outcome beats a skipped one, of equal ones the later row counts.  A
key whose outcome changes is written to the sink with a number that rises; the last of a key is its outcome.  State lies in the
stream's checkpoint and the sink logs its batches, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparkgauge import vocabulary as v


def _order(priority, seq, rest) -> tuple:
    """Nulls first, then by value: how structs compare in the batch operator."""
    return tuple((x is not None, x if x is not None else 0) for x in (priority, seq, *rest))


def changes(log: DataFrame, key: str, status: str, seq: str, values: Sequence[str]) -> DataFrame:
    """key, version, seq, status, values...: a row each time that the outcome of a key changes; ``log`` is a stream."""
    columns = [key, seq, status, *values]
    fields = {f.name: f for f in log.schema}
    out = StructType([fields[key], StructField("version", IntegerType()), *[StructField(c, fields[c].dataType) for c in columns[1:]]])
    state = StructType([StructField("version", LongType()), *[StructField(c, fields[c].dataType) for c in columns[1:]]])
    rank = dict(v.STATUS_PRIORITY)
    # a column of whole numbers with nulls arrives as floats
    whole = [int if fields[c].dataType.typeName() in ("byte", "short", "integer", "long") else (lambda x: x) for c in columns[1:]]

    def update(group, frames, held: GroupState):
        version, best = 0, None
        if held.exists:
            version, *best = (None if pd.isna(x) else x for x in held.get)
        order = None if best is None else _order(rank.get(best[1], 0), best[0], best[1:])
        start = order
        for frame in frames:
            for row in frame[columns[1:]].itertuples(index=False):
                row = [None if pd.isna(x) else whole[i](x) for i, x in enumerate(row)]
                own = _order(rank.get(row[1], 0), row[0], row[1:])
                if order is None or own > order:
                    order, best = own, row
        if order != start:
            version += 1
            held.update((version, *best))
            yield pd.DataFrame({key: [group[0]], "version": [version], **{c: [x] for c, x in zip(columns[1:], best, strict=True)}})

    return log.select(*columns).groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def follow(log: DataFrame, key: str, status: str, seq: str, values: Sequence[str], folder: str) -> None:
    """Read all that ``log`` has now, and write the changes below ``folder``; a later call goes on from there."""
    made = changes(log, key, status, seq, values)
    made.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, key: str, folder: str) -> DataFrame:
    """key, seq, status, values...: the outcome that counts, from the changes below ``folder``."""
    rows = spark.read.parquet(f"{folder}/changes")
    rest = [c for c in rows.columns if c not in (key, "version")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return last.select(key, *[f"r.{c}" for c in rest])
