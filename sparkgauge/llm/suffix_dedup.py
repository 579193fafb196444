"""Removal of repeated substrings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.  Suffixes are not sorted as a whole: only
those that can matter are put in buckets.

1. Sampled suffixes.  In every ``length``-byte window the q-grams of least hash are its anchors, so equal windows have equal
   anchors; anchors (about one byte in 38) go to the bucket of their q-gram, and buckets of one text position end there.
2. Refinement.  An anchor of a shared bucket brings the bytes that windows over it can reach.  There, the suffixes' initial
   8-gram buckets are refined by sorting on pairs of bucket identifiers, a suffix's own and that of the suffix h bytes
   later, which doubles the depth; each step reuses the identifiers of the step before, down to depth ``length``.  A
   suffix alone in its bucket is settled, and so is one whose later offset is.  Bytes are compared, not hashes.
3. Windows that share a bucket at full depth are equal; all but the first are repeats.

A text that equals an earlier one is a repeat as a whole and takes no part in 1 to 3, so a large group of copies costs a row
a copy; equal contexts are settled inside a task before the rest is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkgauge.llm.textcodes import chunks, prefix_sums, span_hash, utf8

NO_ID = -(2**63)
GRAM = 25
CONTEXTS = 8_000  # refined at a time, unless one bucket has more


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the q-grams that are least in some window that lies inside one document."""
    n, gram = len(buf), min(GRAM, length)
    width = length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    h = span_hash(prefix_sums(buf), at, at + gram) | np.uint64(1)
    least = _slide(h, width, np.minimum)  # of the window that starts here
    inside = np.zeros(n - length + 1, bool)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= length:
            inside[lo : hi - length + 1] = True
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = _slide(np.concatenate([pad, least, pad]), width, np.maximum)  # of the windows over a q-gram
    chosen = np.flatnonzero(h == best[: len(h)])
    return chosen, h[chosen]


def refine(buf: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the window of ``length`` bytes at each offset of each context (row: context, column: offset); -1: alone or none."""
    depth = min(8, length)
    plan = [depth]
    while plan[-1] < length:
        plan.append(min(2 * plan[-1], length))
    reach = int(size.max()) if len(size) else 0
    offset = np.arange(max(reach - depth + 1, 1))
    fits = offset[None, :] + depth <= size[:, None]
    place = (start[:, None] + offset[None, :])[fits]
    if depth == 8:  # eight bytes from every offset as one number; the buffer goes on for as many
        key = np.ndarray((len(buf) - 7,), ">u8", buffer=buf, strides=(1,))[place].astype(np.uint64)
    else:
        key = np.zeros(len(place), np.uint64)
        for k in range(depth):
            key = (key << np.uint64(8)) | buf[place + k]
    bucket = np.full(fits.shape, -1, np.int64)
    bucket[fits] = _shared(key)
    for old, new in zip(plan[:-1], plan[1:], strict=True):
        step = new - old
        columns = max(reach - new + 1, 1)
        own, later = bucket[:, :columns], bucket[:, step : step + columns]
        if later.shape[1] < columns:
            return np.full((len(start), 1), -1, np.int64)
        live = (own >= 0) & (later >= 0)
        most = int(bucket.max()) + 2
        bucket = np.full(own.shape, -1, np.int64)
        bucket[live] = _shared(own[live] * most + later[live])
    return bucket


def _shared(key: np.ndarray) -> np.ndarray:
    """Number of each key's bucket; -1 for a key that occurs once."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    alone = np.append(new[1:], True) & new if len(key) else new
    out = np.empty(len(key), np.int64)
    out[order] = np.where(alone, -1, number)
    return out


def repeats(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of the bytes of each context's document that its repeated windows cover; lo = hi: none.

    ``doc`` orders the documents, ``start`` is a context's first byte in its document.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    at = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    bucket = refine(buf, at, size, length)
    row, offset = np.nonzero(bucket >= 0)
    lo, hi = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    if not len(row):
        return lo, hi
    b, begin = bucket[row, offset], start[row] + offset
    order = np.lexsort((begin, doc[row], b))
    row, begin, b = row[order], begin[order], b[order]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))  # the first window of each bucket
    again = (doc[row] != doc[row[lead]]) | (begin != begin[lead])
    row, begin = row[again], begin[again]
    if not len(row):
        return lo, hi
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    have, at = np.unique(row, return_index=True)
    lo[have] = begin[at]
    hi[have] = begin[np.append(at[1:], len(row)) - 1] + length
    return lo, hi


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """h, x1, pos, known: anchors of every text; texts that a chunk holds twice are read once.

    Of the anchors that share a q-gram within a chunk two look for others in its bucket, the rest are ``known`` to be shared:
    a q-gram that a third of the documents hold fills its bucket with two rows a chunk.
    """

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            x1 = batch.column("x1").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(np.diff(offsets)):
                _, once = np.unique(x1[lo:hi], return_index=True)
                own = offsets[lo : hi + 1]
                pos, h = anchors(buf[own[0] : own[-1]], own - own[0], length)
                owner = np.searchsorted(own - own[0], pos, side="right") - 1
                keep = np.isin(owner, once)
                pos, h, owner = pos[keep], h[keep], owner[keep]
                order = np.argsort(h, kind="stable")
                known = np.zeros(len(h), bool)
                known[order[2:]] = (h[order[2:]] == h[order[1:-1]]) & (h[order[2:]] == h[order[:-2]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(x1[lo:hi][owner]), pa.array((pos - (own - own[0])[owner]).astype(np.int32)), pa.array(known)],
                    names=["h", "x1", "pos", "known"],
                )

    return rows.select("text", "x1").mapInArrow(run, "h bigint, x1 bigint, pos int, known boolean")


def _context_rows(rows: DataFrame, length: int) -> DataFrame:
    """h, context, id, x1, start; rows of equal contexts but the first are settled: their context is null and they say lo, hi."""
    gram = min(GRAM, length)
    back = length - gram

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                buf, offsets = utf8(part.column("text"))
                ids, x1 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x1"))
                found: list[tuple] = []
                for d, places in enumerate(part.column("places").to_pylist()):
                    text = buf[offsets[d] : offsets[d + 1]]
                    pos = np.array([p for p in places if p + gram <= len(text)], np.int64)
                    if not len(pos):
                        continue
                    raw = text.tobytes()
                    names = span_hash(prefix_sums(text), pos, pos + gram).view(np.int64)
                    for p, name in zip(pos.tolist(), names.tolist(), strict=True):
                        start = max(0, p - back)
                        found.append((int(ids[d]), int(x1[d]), start, p - start, name, raw[start : p + length]))
                found.sort()
                first: set[tuple[int, bytes]] = set()
                out: list[tuple] = []
                for own, x, start, lead, name, context in found:
                    if (lead, context) not in first:
                        first.add((lead, context))
                        out.append((name, context, own, x, start, None, None))
                    elif len(context) >= length:
                        out.append((name, None, own, x, start, start, start + len(context)))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "context", "id", "x1", "start", "lo", "hi"])

    return rows.mapInArrow(run, "h bigint, context binary, id bigint, x1 bigint, start int, lo int, hi int")


def _interval_rows(contexts: DataFrame, length: int) -> DataFrame:
    """id, x1, lo, hi from contexts that are sorted by h, id, x1, start; settled rows pass."""

    def settled(table: pa.Table) -> pa.RecordBatch:
        done = np.asarray(table.column("context").is_null())
        ids, x1, start = (table.column(c).to_numpy() for c in ("id", "x1", "start"))
        lo, hi = (table.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        open_ = np.flatnonzero(~done)
        if len(open_):
            name = np.lexsort((x1[open_], ids[open_]))
            changed = np.ones(len(open_), np.int64)
            changed[1:] = (ids[open_][name][1:] != ids[open_][name][:-1]) | (x1[open_][name][1:] != x1[open_][name][:-1])
            doc = np.empty(len(open_), np.int64)
            doc[name] = np.cumsum(changed)
            lo[open_], hi[open_] = repeats(table.column("context").take(pa.array(open_)).to_pylist(), doc, start[open_].astype(np.int64), length)
        some = np.flatnonzero(hi > lo)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(x1[some]), pa.array(lo[some].astype(np.int32)), pa.array(hi[some].astype(np.int32))], names=["id", "x1", "lo", "hi"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            while held.num_rows > CONTEXTS:
                h = held.column("h").to_numpy()
                cut_at = int(np.searchsorted(h, h[CONTEXTS], side="left")) or int(np.searchsorted(h, h[0], side="right"))
                if cut_at == held.num_rows:
                    break  # one bucket, which may go on
                yield settled(held.slice(0, cut_at).combine_chunks())
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield settled(held.combine_chunks())

    return contexts.mapInArrow(run, "id bigint, x1 bigint, lo int, hi int")


def dedup_substrings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes that stay).

    One row per input row.  A null text counts as empty, a null id comes before all others.  Rows that repeat an id with the
    same text are one document and get the same result; with other texts they are ordered by the hash of the text.  Texts shorter than
    ``length`` stay; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text"),
        F.xxhash64(text).alias("x1"), F.xxhash64(text, F.lit(1)).alias("x2"), F.octet_length(text).alias("n"),
    )
    firsts = rows.groupBy("x1", "x2", "n").agg(F.min("id").alias("first"))
    copies = rows.select("id", "x1", "x2", "n").where(F.col("n") >= length).join(firsts, ["x1", "x2", "n"]).where("id <> first")
    copies = copies.select("id", "x1", F.lit(0).alias("lo"), F.col("n").cast("int").alias("hi"))

    place = Window.partitionBy("h")
    point = F.xxhash64("x1", "pos")
    found = _anchor_rows(rows.where(F.col("n") >= length), length).withColumn("h", F.when(F.col("known"), point).otherwise(F.col("h")))
    shared = found.repartition("h").withColumns({"least": F.min(point).over(place), "most": F.max(point).over(place)})
    places = shared.where("known or least <> most").groupBy("x1").agg(F.collect_set("pos").alias("places"))  # of one text
    wanted = firsts.join(places, "x1").select(F.col("first").alias("id"), "x1", "places")
    dealt = rows.select("id", "x1", "text")
    contexts = _context_rows(dealt.join(wanted, ["id", "x1"]).select("id", "x1", "text", "places"), length)
    spread = F.when(F.col("context").isNull(), F.xxhash64("id", "start")).otherwise(F.col("h"))  # settled rows need no bucket
    found = _interval_rows(contexts.withColumn("h", spread).repartition("h").sortWithinPartitions("h", "id", "x1", "start"), length)
    spans = found.union(copies).groupBy("id", "x1").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def run(batches):
        for batch in batches:
            ids, texts, lists = (batch.column(c) for c in ("id", "text", "spans"))
            out = []
            for own, t, cuts in zip(ids.to_pylist(), texts.to_pylist(), lists.to_pylist(), strict=True):
                raw = t.encode()
                kept, n_spans, end = [], 0, 0
                last = -1
                for s in sorted(cuts or (), key=lambda s: (s["lo"], s["hi"])):
                    if s["lo"] > last or last < 0:
                        kept.append(raw[end : s["lo"]])
                        n_spans += 1
                    last = end = max(end, s["hi"])
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((None if own == NO_ID else own, len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            most = 6 if keep_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:most], kinds, strict=False)], names=names[:most])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    return dealt.join(spans, ["id", "x1"], "left").select("id", "text", "spans").mapInArrow(run, schema)
