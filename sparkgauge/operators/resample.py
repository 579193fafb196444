"""Resampled intervals (R9-R13) with the replicates as a vector.

No row is copied once per replicate.  A group's multiplicities over all replicates are one vector of B bytes (``draw_vectors``), shared
by all runs and arms; weighted sums and weighted running sums are vector sums over it.  Average precision is not linear in the
weights, so its replicates carry them into the running counts of the ranked detections: the detections of a run are cut into cells by
score (bounded rows, any number of cells a run), each cell's totals are added up, running totals over the cells give each cell what
lies before it, and each cell goes through its own detections once.  What a cell keeps is, by replicate and whole per cent of recall,
the best precision; these meet per run and block of replicates.

The cost is B bytes for each cell and group that meet, and one pass of B numbers over the distinct (run, score, group).

Medians go the same way: totals of the cells tell in which cell a replicate's middle lies, and only those cells are gone through again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from sparkgauge.functions.hashing import hash52
from sparkgauge.operators.ordering import cells, rank_rows
from sparkgauge.session import arrow_rows, stored

REPLICATES = 5000
BLOCK = 250  # replicates that meet in one task
CELL_ROWS = 4096  # rows of detections that a task ranks at once
PRIME = 2147483647
DRAWN_BYTES = 32 << 20  # a task's counts of draws
DRAWS = 1 << 16  # drawn at once
HELD_SUMS = 2_500_000  # sums that a task holds of either kind
ROUND_BYTES = 1 << 30  # weights that meet cells in one round of replicates, unless a round has one block
PART = 1024  # equal rows that draw their Poisson count together


def draw_vectors(groups: DataFrame, group: str, replicates: int, seed) -> DataFrame:
    """group, w: how often each replicate draws the group, a byte a replicate (a group drawn 256 times or more fails).

    Draw i of replicate b takes group number hash(seed, b, i) mod G; groups are numbered in the order of their key.
    """
    numbered = stored(rank_rows(groups.select(F.col(group).alias("_key")).where(F.col("_key").isNotNull()).distinct(), [], "_key", [], "_no"))
    n = numbered.count()
    if not n:
        return numbered.select(F.col("_key").alias(group), F.lit(b"").alias("w"))
    # replicates that a task draws: it counts them in so many bytes a group, and ranges are cut between replicates
    per = max(k for k in range(1, min(replicates, BLOCK, max(DRAWN_BYTES // n, 1)) + 1) if replicates % k == 0)
    windows = groups.sparkSession.range(0, replicates // per, 1, replicates // per)

    def counted(batches):
        for window in (x for batch in batches for x in batch.column("id").to_pylist()):
            held = np.zeros((n, per), np.uint8)
            for at in range(0, n, DRAWS):
                parts = [b"|%d:%d" % (len(str(i)), i) for i in range(at, min(at + DRAWS, n))]
                for k in range(per):
                    rep = window * per + k
                    # the numbers of ``hash52(seed, rep, i)``: the first 52 bits
                    head = f"{seed}|{len(str(rep))}:{rep}".encode()
                    bits = np.frombuffer(b"".join([md5(head + x).digest() for x in parts]), ">u8")[::2] >> 12
                    drawn, times = np.unique(bits % n, return_counts=True)
                    total = held[drawn, k] + times
                    if (total > 255).any():
                        raise ValueError("a group is drawn more than 255 times in a replicate")
                    held[drawn, k] = total
            for at in range(0, n, 4096):
                rows = held[at : at + 4096]
                yield pa.record_batch([pa.array(np.arange(at, at + len(rows)) + 1, pa.int64()), pa.array([window] * len(rows), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["no", "at", "w"])

    parts = windows.mapInArrow(counted, "no bigint, at int, w binary").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("p"))
    drawn = parts.select("no", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["w"])).alias("w"))
    # by merge: the planner takes what Python draws for a small table and would broadcast it
    return numbered.join(drawn.hint("merge"), F.col("_no") == F.col("no")).select(F.col("_key").alias(group), "w")


def unit_vectors(groups: DataFrame, group: str, replicates: int = 1) -> DataFrame:
    """Weights of 1 for every group: the statistic as observed."""
    return groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("w", F.lit(bytes([1] * replicates)))


def _weights(table: pa.Table, name: str = "w") -> np.ndarray:
    """Rows of a column of byte vectors as a matrix."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _blocks(*vectors: np.ndarray):
    for at in range(0, vectors[0].shape[-1], BLOCK):
        yield at // BLOCK, [v[..., at : at + BLOCK] for v in vectors]


def _totals(points: DataFrame, vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., block, t, n: weighted sums of ``t`` and ``n`` of points (by..., grp, t, n), a vector of 64-bit numbers a block.

    Sums meet within a task first, so that a hot key sends one row a task.
    """

    def partial(batches):
        held: dict = {}

        def out():
            rows = [(*key, block, t.tobytes(), n.tobytes()) for key, (a, b) in held.items() for block, (t, n) in _blocks(a, b)]
            held.clear()
            columns = list(zip(*rows, strict=True))
            return pa.table([*map(pa.array, columns[: len(by)]), pa.array(columns[-3], pa.int32()), pa.array(columns[-2], pa.binary()), pa.array(columns[-1], pa.binary())], names=[*by, "block", "t", "n"]).to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = pa.Table.from_batches([batch.slice(at, 256)])
                w = _weights(rows).astype(np.int64)
                keys = list(zip(*(rows.column(k).to_pylist() for k in by), strict=True))
                t, n = rows.column("t").to_numpy(), rows.column("n").to_numpy()
                order = sorted(range(len(keys)), key=lambda i: keys[i])
                for i in order:
                    if keys[i] not in held:
                        held[keys[i]] = [np.zeros(w.shape[1], np.int64), np.zeros(w.shape[1], np.int64)]
                    a, b = held[keys[i]]
                    a += w[i] * t[i]
                    b += w[i] * n[i]
                if len(held) * w.shape[1] > HELD_SUMS:
                    yield from out()
        if held:
            yield from out()

    def added(table: pa.Table) -> pa.Table:
        sums = [np.sum([np.frombuffer(x, np.int64) for x in table.column(k).to_pylist()], axis=0).tobytes() for k in ("t", "n")]
        return pa.table([*(table.column(k).slice(0, 1) for k in [*by, "block"]), *(pa.array([x], pa.binary()) for x in sums)], names=[*by, "block", "t", "n"])

    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{keys}, block int, t binary, n binary"
    parts = points.join(vectors, "grp").select(*by, "t", "n", "w").mapInArrow(partial, schema)
    return parts.groupBy(*by, "block").applyInArrow(added, schema)


def _joined_cells(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """``points`` with neighbouring small cells of a key as one, of ``CELL_ROWS`` rows at most.

    Larger ones, of equal values, stay alone; ``_parts`` says in how many parts of so many rows to take them.
    """
    half = max(CELL_ROWS // 2, 1)
    sizes = points.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.select(*by, "cell", (F.call_function("div", before, F.lit(half)) * 2 + F.when(F.col("_n") > half, 1).otherwise(0)).alias("_at"), F.ceil(F.col("_n") / CELL_ROWS).alias("_parts"))
    return points.join(at, [*by, "cell"]).drop("cell").withColumnRenamed("_at", "cell")


def _before(table: pa.Table) -> pa.Table:
    """What lies before each cell of one run and block of replicates."""
    order = np.argsort(table.column("cell").to_numpy())
    table = table.take(order)
    columns = []
    for k in ("t", "n"):
        sums = np.cumsum([np.frombuffer(x, np.int64) for x in table.column(k).to_pylist()], axis=0)
        before = np.vstack([np.zeros_like(sums[:1]), sums[:-1]])
        columns.append(pa.array([x.tobytes() for x in before], pa.binary()))
    return pa.table([table.column("run"), table.column("cell"), table.column("block"), *columns], names=["run", "cell", "block", "t", "n"])


def _best(points: pa.Table, sides: pa.Table) -> pa.Table:
    """run, block, k, p: the best precision of one cell's detections where recall has reached k per cent, by replicate.

    ``sides`` holds the groups' weights (block null) and, a block of replicates, what lies before the cell and the truths.
    """
    sides = sides.rename_columns([c.removeprefix("of_") for c in sides.column_names])
    of_group = sides.filter(pa.compute.is_null(sides.column("block")))
    w = _weights(of_group)
    place = {g: i for i, g in enumerate(of_group.column("grp").to_pylist())}
    points = points.sort_by([("v", "ascending")])
    v, t, n = (points.column(k).to_numpy() for k in ("v", "t", "n"))
    row = np.array([place[g] for g in points.column("grp").to_pylist()])
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    run = points.column("run")[0].as_py()
    out: list[tuple] = []
    rest = sides.filter(pa.compute.is_valid(sides.column("block")))
    for block, t0, n0, truths in zip(*(rest.column(k).to_pylist() for k in ("block", "t", "n", "truths")), strict=True):
        own = w[:, block * BLOCK : (block + 1) * BLOCK][row].astype(np.int64)
        ct = np.cumsum(np.add.reduceat(own * t[:, None], starts), axis=0) + np.frombuffer(t0, np.int64)
        cn = np.cumsum(np.add.reduceat(own * n[:, None], starts), axis=0) + np.frombuffer(n0, np.int64)
        gt = np.frombuffer(truths, np.int64)
        live = np.broadcast_to(gt > 0, ct.shape) & (cn > 0)
        k = np.where(live, ct * 100 // np.maximum(gt, 1), 0)
        p = np.where(live, ct / np.maximum(cn, 1), 0.0)
        low, high = int(k.min()), int(k.max())
        best = np.zeros((high - low + 1, k.shape[1]))
        np.maximum.at(best, (k - low, np.broadcast_to(np.arange(k.shape[1]), k.shape)), p)
        out += [(run, block, low + i, x.tobytes()) for i, x in enumerate(best) if x.any()]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["run", "block", "k", "p"])


def _precision(best: pa.Table, truths: pa.Table) -> pa.Table:
    """run, rep, ap of one run and block: mean over 101 recalls of the best precision from there on; null without truths."""
    run, block, raw = (truths.column(f"of_{k}")[0].as_py() for k in ("run", "block", "truths"))
    gt = np.frombuffer(raw, np.int64)
    held = np.zeros((101, len(gt)))
    for k, p in zip(best.column("k").to_pylist(), best.column("p").to_pylist(), strict=True):
        # a run may find a truth more than once
        held[min(k, 100)] = np.maximum(held[min(k, 100)], np.frombuffer(p, np.float64))
    ap = np.maximum.accumulate(held[::-1], axis=0).sum(axis=0) / 101
    rep = np.arange(len(gt)) + block * BLOCK
    return pa.table([pa.array([run] * len(gt)), pa.array(rep, pa.int32()), pa.array(ap, pa.float64(), mask=gt == 0)], names=["run", "rep", "ap"])


def replicated_ap(dets: DataFrame, truths: DataFrame, by: Sequence[str], group: str, vectors: DataFrame) -> DataFrame:
    """by..., rep, ap: average precision of every run in every replicate.

    ``dets``: by..., group, score, tp; ``truths``: by..., group, n_gt, a row for each group that a run has, with or without detections;
    ``vectors``: group, w.  Equal scores count together.  A replicate without truths has a null, one with truths and no detection 0.
    Detections and truths of groups without a vector, and null scores, take no part.
    """
    run = F.to_json(F.struct(*by)).alias("run")
    vectors = stored(vectors.select(F.col(group).cast("string").alias("grp"), "w"))
    grp = F.col(group).cast("string").alias("grp")
    named = truths.select(*by).distinct().withColumn("_run", run)
    kept = truths.select(run, grp, F.col("n_gt").cast("bigint").alias("t")).groupBy("run", "grp").agg(F.sum("t").alias("t")).withColumn("n", F.lit(0).cast("bigint"))
    kept = stored(kept)
    points = dets.where(F.col("score").isNotNull()).groupBy(run, grp, (-F.col("score").cast("double")).alias("v")).agg(F.sum("tp").cast("bigint").alias("t"), F.count(F.lit(1)).alias("n"))
    points = points.join(vectors.select("grp"), "grp").withColumn("_g", F.col("run"))
    points = stored(_joined_cells(cells(points, "v", CELL_ROWS).withColumnRenamed("_cell", "cell").drop("_g"), ["run"]).drop("_parts"))
    drawn = vectors.agg(F.max(F.octet_length("w"))).first()[0] or 0
    blocks = -(-drawn // BLOCK)
    per = max(1, blocks // max(1, -(-points.count() * drawn // ROUND_BYTES))) * BLOCK
    rounds = [_ap_round(points, kept, vectors.select("grp", F.expr(f"substring(w, {at + 1}, {per})").alias("w")), at) for at in range(0, max(drawn, 1), per)]
    return named.join(reduce(DataFrame.unionByName, rounds).withColumnRenamed("run", "_run"), "_run").drop("_run")


def _ap_round(points: DataFrame, kept: DataFrame, vectors: DataFrame, first: int) -> DataFrame:
    """run, rep, ap of the replicates from ``first`` that ``vectors`` hold.  Stored, so that what one round shuffles is deleted before the next."""
    total = stored(_totals(kept, vectors, ["run"]).select("run", "block", F.col("t").alias("truths")))
    sums = _totals(points.groupBy("run", "cell", "grp").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), vectors, ["run", "cell"])
    before = sums.groupBy("run", "block").applyInArrow(_before, "run string, cell bigint, block int, t binary, n binary").join(total, ["run", "block"])
    needed = points.select("run", "cell", "grp").distinct().join(vectors, "grp")
    blank = lambda kind, *names: [F.lit(None).cast(kind).alias(k) for k in names]
    sides = needed.select("run", "cell", "grp", "w", *blank("int", "block"), *blank("binary", "t", "n", "truths")).unionByName(
        before.select("run", "cell", *blank("string", "grp"), *blank("binary", "w"), "block", "t", "n", "truths")
    ).select(*[F.col(k).alias(f"of_{k}") for k in ("run", "cell", "grp", "w", "block", "t", "n", "truths")])
    best = points.groupBy("run", "cell").cogroup(sides.groupBy("of_run", "of_cell")).applyInArrow(_best, "run string, block int, k int, p binary")
    ap = best.groupBy("run", "block").cogroup(total.select(*[F.col(k).alias(f"of_{k}") for k in ("run", "block", "truths")]).groupBy("of_run", "of_block")).applyInArrow(_precision, "run string, rep int, ap double")
    return stored(ap.withColumn("rep", F.col("rep") + first))


def _pair_sums(batches):
    """cell, block, n, m: a task's weights of each cell and, without a cell, its weighted sums of x, y, xx, yy, xy and y - x."""
    held: dict[int, np.ndarray] = {}
    moments = None

    def out():
        rows = [(cell, block, n.tobytes(), None) for cell, total in held.items() for block, (n,) in _blocks(total)]
        held.clear()
        return rows

    def batch_of(rows):
        cells_, blocks, n, m = zip(*rows, strict=True)
        return pa.record_batch([pa.array(cells_, pa.int64()), pa.array(blocks, pa.int32()), pa.array(n, pa.binary()), pa.array(m, pa.binary())], names=["cell", "block", "n", "m"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = pa.Table.from_batches([batch.slice(at, 256)])
            w = _weights(rows).astype(float)
            cell, x, y, v = (rows.column(k).to_numpy() for k in ("cell", "x", "y", "v"))
            part = np.stack([x, y, x * x, y * y, x * y, v]) @ w
            moments = part if moments is None else moments + part
            for c in np.unique(cell):
                total = w[cell == c].sum(axis=0).astype(np.int64)
                held[int(c)] = held[int(c)] + total if int(c) in held else total
            if len(held) * w.shape[1] > HELD_SUMS:
                yield batch_of(out())
    if moments is not None:
        rows = out()
        yield batch_of(rows + [(None, block, b"", m.tobytes()) for block, (m,) in _blocks(moments)])


def _pair_places(table: pa.Table) -> pa.Table:
    """Of one block: rep, bias and ccc of every replicate, and for either middle place its cell and its place there."""
    block = table.column("block")[0].as_py()
    own = table.filter(pa.compute.is_valid(table.column("cell"))).sort_by([("cell", "ascending")])
    cell = own.column("cell").to_numpy()
    n = np.stack([np.frombuffer(x, np.int64) for x in own.column("n").to_pylist()])
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.cumsum(np.add.reduceat(n, starts, axis=0), axis=0)
    total = ends[-1]
    parts = [np.frombuffer(x, np.float64).reshape(6, -1) for x in table.column("m").to_pylist() if x is not None]
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my, xx, yy, xy, bias = np.sum(parts, axis=0) / total
        ccc = 2 * (xy - mx * my) / (xx - mx * mx + yy - my * my + (mx - my) ** 2)
    columns = {"rep": np.arange(len(total)) + block * BLOCK, "bias": bias, "ccc": ccc}
    for name, place in (("lo", (total - 1) // 2), ("hi", total // 2)):
        at = np.minimum((ends <= place).sum(axis=0), len(starts) - 1)
        before = np.where(at > 0, ends[at - 1, np.arange(len(total))], 0)
        columns |= {f"{name}_cell": cell[starts][at], f"{name}_place": place - before}
    return pa.table(columns).filter(pa.array(total > 0))


def _pair_values(points: pa.Table, wanted: pa.Table) -> pa.Table:
    """rep, end, value: the value at each wanted place of one cell."""
    points = points.sort_by([("v", "ascending")])
    reps = wanted.column("rep").to_numpy()
    values = np.zeros(0)
    if points.num_rows and len(reps):
        w, v = _weights(points), points.column("v").to_numpy()
        # replicate by replicate: their running weights are not held together
        values = v[[np.searchsorted(np.cumsum(w[:, rep], dtype=np.int64), place, "right") for rep, place in zip(reps, wanted.column("place").to_numpy(), strict=True)]]
    return pa.table([wanted.column("rep").slice(0, len(values)), wanted.column("end").slice(0, len(values)), pa.array(values, pa.float64())], names=["rep", "end", "value"])


def replicated_pairs(pairs: DataFrame, group: str, vectors: DataFrame) -> DataFrame:
    """rep, med, bias, ccc: median and mean of y - x and the concordance of x and y in every replicate.

    ``pairs``: group, x, y; ``vectors``: group, w.  A group stands as often as a replicate draws it; pairs with a null, and groups without a
    vector, take no part, and a replicate that draws no pair has no row.  A median between two values is their mean.
    """
    vectors = stored(vectors.select(F.col(group).cast("string").alias("grp"), "w"))
    points = pairs.select(F.col(group).cast("string").alias("grp"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = points.withColumn("v", F.col("y") - F.col("x")).where(F.col("v").isNotNull()).join(vectors.select("grp"), "grp").withColumn("_g", F.lit(0))
    points = stored(_joined_cells(cells(points, "v", CELL_ROWS).withColumnRenamed("_cell", "cell"), ["_g"]).drop("_g"))
    # the rows of a cell meet before they are summed, so that a block has a row for each of its cells and not for each task as well
    weighted = points.join(vectors, "grp").repartition("cell", F.pmod(F.xxhash64("grp"), F.col("_parts"))).select("cell", "x", "y", "v", "w")
    with arrow_rows(pairs.sparkSession, 512):
        sums = stored(weighted.mapInArrow(_pair_sums, "cell bigint, block int, n binary, m binary"))
    places = stored(sums.groupBy("block").applyInArrow(_pair_places, "rep bigint, bias double, ccc double, lo_cell bigint, lo_place bigint, hi_cell bigint, hi_place bigint"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"{k}_cell").alias("cell"), F.col(f"{k}_place").alias("place")) for k in ("lo", "hi")]))
    wanted = places.select("rep", ends.alias("e")).select("rep", "e.*")
    # equal values are a cell of any size, and need no look at their weights
    spans = stored(points.join(F.broadcast(wanted.select("cell").distinct()), "cell").groupBy("cell").agg(F.min("v").alias("value"), F.max("v").alias("_most")))
    alike = F.col("value").eqNullSafe(F.col("_most"))
    plain = wanted.join(spans.where(alike), "cell").select("rep", "end", "value")
    mixed = spans.where(~alike).select("cell")
    searched = points.join(F.broadcast(mixed), "cell").join(vectors, "grp").select("cell", "v", "w")
    asked = wanted.join(F.broadcast(mixed), "cell").select(F.col("cell").alias("of_cell"), "rep", "end", "place")
    found = searched.groupBy("cell").cogroup(asked.groupBy("of_cell")).applyInArrow(_pair_values, "rep bigint, end string, value double")
    at = lambda k: F.max(F.when(F.col("end") == k, F.col("value")))
    med = plain.unionByName(found).groupBy("rep").agg(at("lo").alias("_lo"), at("hi").alias("_hi"))
    mean = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * 0.5 + F.col("_hi") * 0.5)
    return places.select("rep", "bias", "ccc").join(med, "rep").select("rep", mean.alias("med"), "bias", "ccc")


def limits(reps: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """by..., valid, lo, hi: percentile limits over the replicates of each key; undefined ones are dropped and the valid ones counted."""
    return reps.groupBy(*by).agg(F.count(value).alias("valid"), F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"))


def poisson_cdf(mean: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable up to where a draw of 31 bits cannot tell them from 1."""
    k = np.arange(int(mean + 12 * mean**0.5 + 20))
    logs = k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])
    return np.cumsum(np.exp(logs))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, replicates: int = REPLICATES, seed=7, alpha: float = 0.05) -> DataFrame:
    """By..., obs, valid, lo, hi: percentile limits of the mean of ``value`` when single rows are resampled (Poisson weights).

    Equal rows (by, value) collapse to one with a count c, whose weight in a replicate is Poisson(c): equal rows need not be told apart.
    Counts above ``PART`` draw in parts.  The draw of a row in replicate b is ``(x a + z) mod p`` over p = 2**31 - 1, with x from the row's
    hash and a, z from those of (seed, b), so it is the same on every engine.  Nulls and NaN take no part; a key without values has no row.
    """
    keys = [F.col(k) for k in by]
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / PART).cast("bigint")), lambda i: F.struct(i.alias("i"), F.least(F.col("_c") - i * PART, F.lit(PART)).cast("int").alias("c")))
    rows = kept.select(F.to_json(F.struct(*keys)).alias("run"), "_v", F.explode(parts).alias("p")).select(
        "run", F.col("_v").alias("v"), F.col("p.c").alias("c"), (hash52(seed, F.bround(F.col("_v") * 1e6).try_cast("bigint"), F.col("p.i")) % PRIME).alias("x"),
    )
    spark = df.sparkSession
    # B rows of two numbers
    lines = spark.range(replicates).select((hash52(seed, F.lit("a"), "id") % (PRIME - 1) + 1).alias("a"), (hash52(seed, F.lit("z"), "id") % PRIME).alias("z")).toArrow()
    a, z = lines.column("a").to_numpy(), lines.column("z").to_numpy()

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)]).sort_by([("run", "ascending"), ("c", "ascending")])
                run, c, v, x = (part.column(k).to_numpy(zero_copy_only=False) for k in ("run", "c", "v", "x"))
                w = np.empty((len(c), replicates), np.int64)
                for k in np.unique(c):
                    own = c == k
                    u = (x[own, None] * a + z) % PRIME / PRIME
                    w[own] = np.searchsorted(poisson_cdf(int(k)), u, "right")
                cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                for s, e in zip(cuts, [*cuts[1:], len(run)], strict=True):
                    total, weight = held.setdefault(run[s], [np.zeros(replicates), np.zeros(replicates, np.int64)])
                    total += v[s:e] @ w[s:e]
                    weight += w[s:e].sum(axis=0)
        if held:
            yield from pa.table([pa.array(list(held)), pa.array([t.tobytes() for t, _ in held.values()], pa.binary()), pa.array([n.tobytes() for _, n in held.values()], pa.binary())], names=["run", "t", "n"]).to_batches()

    def finished(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("t").to_pylist()], axis=0)
        weight = np.sum([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()], axis=0)
        stat = total[weight > 0] / weight[weight > 0]
        lo, hi = np.quantile(stat, [alpha / 2, 1 - alpha / 2]) if len(stat) else (None, None)
        return pa.table([table.column("run").slice(0, 1), pa.array([len(stat)], pa.int64()), pa.array([lo], pa.float64()), pa.array([hi], pa.float64())], names=["run", "valid", "lo", "hi"])

    found = rows.mapInArrow(partial, "run string, t binary, n binary").groupBy("run").applyInArrow(finished, "run string, valid bigint, lo double, hi double")
    named = kept.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("obs")).withColumn("_run", F.to_json(F.struct(*keys)))
    return named.join(found.withColumnRenamed("run", "_run"), "_run").drop("_run")
