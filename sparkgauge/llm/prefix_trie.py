"""Prefix trie of conversations by truncation peeling.

A conversation is the path of its turns' digests.  Peeling starts at the greatest depth: the conversations that end there and the
nodes that survive from one turn deeper are merged, those with one prefix become a node, the node's figures are the sums over what it
merged, and the last turn is stripped.  So each node is discovered and aggregated in one pass over the depths, and nothing is read
twice.

On Spark, conversations are range-partitioned and sorted by (path, conv_id), so that everything below a prefix lies side by side, and a
prefix that a third of all conversations share is spread over many partitions.  Each chunk of a partition (bounded rows and bytes) is
peeled by itself.  Only the prefixes of a chunk's first and last path can go on in a neighbour; the nodes on them ("border nodes", at
most twice the depth a chunk) are added up over the chunks.  Where two neighbours share a prefix of m turns, they count its nodes
twice: as children of each other, as a leaf if the first chunk ends with exactly that prefix, and in what sharing saves; one
correction for each neighbourhood, a sum along one path, puts that right.  No round runs over all data, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sparkgauge.llm.textcodes import utf8
from sparkgauge.session import stored

CHUNK_ROWS = 50_000
CHUNK_TURNS = 1_000_000
DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()
KIN = 100  # a conversation starts with turns of the first of its hundred
HEADS = 6  # and takes fewer than so many of them

NODE = StructType([
    *[StructField(k, LongType()) for k in ("chunk", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    StructField("ends", StringType()),  # the digest of an inner node's ends, the joined ids of a border node's
    StructField("key", BinaryType()),  # border nodes only
    StructField("parent", BinaryType()),  # the parent's key, where it is a border node
    # one row a partition, for the neighbourhood of partitions; depth is null there
    StructField("first_path", BinaryType()), StructField("last_path", BinaryType()), StructField("first_sizes", ArrayType(IntegerType())),
])
FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (a digest a turn), sizes (code points of each turn's text) of every conversation as it is rebuilt.

    The first h turns are those of conversation ``c - c % 100``, the others its own after its first h; h is crc32(decimal c) % 6.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).alias("size"))
    told = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn")).where(F.col("conv_id").isNotNull())

    def listed(rows: DataFrame) -> DataFrame:
        turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
        return rows.groupBy("conv_id").agg(turns.alias("turns"))

    first_of_kin: Column = F.col("conv_id") - F.col("conv_id") % KIN
    heads = listed(told.where(F.col("conv_id") % KIN == 0)).select(F.col("conv_id").alias("kin"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = listed(told).join(heads, first_of_kin == F.col("kin"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.when(F.col("head").isNull() | (h == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    turns = F.concat(head, F.slice("turns", h + 1, F.size("turns")))
    return own.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.size").alias("sizes")
    )


def shared_turns(blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each path and the one before it, in turns; -1 for the first.

    ``blocks`` holds the digests of all paths as rows of numbers, ``at`` where each path starts and the last one ends.
    """
    depth = np.diff(at)
    shared = np.full(len(depth), -1, np.int64)
    shared[1:] = 0
    live = np.arange(1, len(depth))
    k = 0
    while len(live):
        live = live[(depth[live] > k) & (depth[live - 1] > k)]
        live = live[(blocks[at[live] + k] == blocks[at[live - 1] + k]).all(axis=1)]
        k += 1
        shared[live] = k
    return shared


def prefix_keys(path: bytes) -> list[bytes]:
    """Digest of every prefix of a path, by depth."""
    h = hashlib.md5(usedforsecurity=False)
    keys = [h.digest()]
    for k in range(0, len(path), DIGEST):
        h.update(path[k : k + DIGEST])
        keys.append(h.digest())
    return keys


def peel(ids: np.ndarray, at: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> dict[str, list]:
    """Nodes of the trie of one chunk of paths, sorted by (path, id).

    Columns by name: depth, conv_id, parent_conv_id (-1 place where unknown, see ``parent``), the figures, ends, and ``key`` and
    ``parent`` as +depth for a node on the first path, -depth - 1 for one on the last path only, None for inner ones.
    """
    n, depth = len(ids), np.diff(at)
    shared = shared_turns(blocks, at)
    by_depth = np.argsort(depth, kind="stable")
    ended_at = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    out: dict[str, list] = {k: [] for k in ("depth", "conv_id", "parent_conv_id", *FIGURES, "ends", "border", "parent")}
    alive = {k: np.zeros(0, np.int64) for k in ("first", "n", "least", "leaves", "saved")}  # the nodes one turn deeper
    waiting: dict | None = None  # their rows, but for the parent
    for d in range(int(depth.max()), -1, -1):
        ended = by_depth[ended_at[d] : ended_at[d + 1]]
        ones, none = np.ones(len(ended), np.int64), np.zeros(len(ended), np.int64)
        order = np.argsort(np.concatenate([alive["first"], ended]), kind="stable")
        fresh = {"first": ended, "n": ones, "least": ids[ended], "leaves": none, "saved": none}
        merged = {k: np.concatenate([alive[k], fresh[k]])[order] for k in alive}
        child = order < len(alive["first"])
        starts = np.flatnonzero(shared[merged["first"]] < d) if d else np.array([0])
        first, total = merged["first"][starts], np.add.reduceat(merged["n"], starts)
        least, children = np.minimum.reduceat(merged["least"], starts), np.add.reduceat(child.astype(np.int64), starts)
        leaves = np.where(children == 0, 1, np.add.reduceat(merged["leaves"], starts))
        saved = np.add.reduceat(merged["saved"], starts)
        if d:
            saved += (total - 1) * sizes[at[first] + d - 1]
        border = np.zeros(len(starts), np.int64)
        if depth[n - 1] >= d:
            border[-1] = 2
        if depth[0] >= d:
            border[0] = 1
        if waiting is not None:
            group = np.cumsum(np.bincount(starts, minlength=len(child)))[np.flatnonzero(child)] - 1
            _settle(out, waiting, least[group], border[group])
        ends: list[str | None] = [None] * len(starts)
        if len(ended):
            place = np.flatnonzero(~child)
            group = np.searchsorted(starts, place, "right") - 1
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for g, a, b in zip(group[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
                ends[g] = ",".join(map(str, merged["least"][place[a:b]].tolist()))
        waiting = {"depth": np.full(len(starts), d), "conv_id": least, "n_convs": total, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "border": border}
        alive = {"first": first, "n": total, "least": least, "leaves": leaves, "saved": saved}
    _settle(out, waiting, np.full(1, -1), np.zeros(1, np.int64))
    return out


def _settle(out: dict[str, list], rows: dict, parent: np.ndarray, parent_border: np.ndarray) -> None:
    for k, v in (rows | {"parent_conv_id": parent, "parent": parent_border}).items():
        out[k].append(v)


def _correction(path: bytes, follower: bytes, sizes: list[int]) -> list[tuple]:
    """(depth, key, children, leaves, saved) to add for the nodes that two neighbouring chunks share.

    ``path`` is the last of the first chunk, ``follower`` the first of the next with the ``sizes`` of its turns.
    """
    most = min(len(path), len(follower)) // DIGEST
    m = next((k for k in range(most) if path[k * DIGEST : (k + 1) * DIGEST] != follower[k * DIGEST : (k + 1) * DIGEST]), most)
    ended = -1 if len(path) == m * DIGEST else 0
    below = np.cumsum(np.array([0, *sizes[:m]], np.int64)[::-1])[::-1].tolist()  # the root's turn has no text
    return [(d, key, -1 if d < m else 0, ended, below[d]) for d, key in enumerate(prefix_keys(follower[: m * DIGEST]))]


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    schema = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.list_(pa.int32()))) for f in NODE])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _corrections(chunk: int, found: list[tuple]) -> pa.RecordBatch:
    depth, key, children, leaves, saved = map(list, zip(*found, strict=True))
    return _rows({"chunk": [chunk] * len(depth), "depth": depth, "key": key, "n_convs": [0] * len(depth), "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _chunk_nodes(chunk: int, table: pa.Table) -> tuple[pa.RecordBatch, bytes, bytes, list[int]]:
    """Node rows of a chunk, its first and last path and the sizes of the first."""
    ids = table.column("conv_id").to_numpy()
    raw, offsets = utf8(table.column("path"))
    blocks, at = raw.view(np.uint64).reshape(-1, 2) if len(raw) else np.zeros((0, 2), np.uint64), offsets // DIGEST
    sizes = table.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
    first, last = raw[: offsets[1]].tobytes(), raw[offsets[-2] :].tobytes()
    got = peel(ids, at, blocks, sizes)
    flat = {k: np.concatenate(v) for k, v in got.items() if k != "ends"}
    keys = {1: prefix_keys(first), 2: prefix_keys(last)}
    sha = lambda x: EMPTY if x is None else hashlib.sha256(x.encode()).hexdigest()
    ends = [e for part in got["ends"] for e in part]
    depth, border, parent = (flat[k].tolist() for k in ("depth", "border", "parent"))
    rows = {k: flat[k] for k in ("depth", "conv_id", *FIGURES)} | {
        "chunk": np.full(len(depth), chunk), "ends": [e if b else sha(e) for e, b in zip(ends, border, strict=True)],
        "key": [keys[b][d] if b else None for d, b in zip(depth, border, strict=True)],
        "parent": [keys[b][d - 1] if b else None for d, b in zip(depth, parent, strict=True)],
        "parent_conv_id": pa.array(flat["parent_conv_id"], pa.int64(), mask=(flat["parent"] > 0) | (flat["depth"] == 0)),
    }
    return _rows(rows), first, last, sizes[: at[1]].tolist()


def _peeled(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the chunks of a partition, corrections between them, and one row for the partition itself."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    partition: tuple | None = None
    last = None
    parts: list[pa.RecordBatch] = []

    def flush():
        nonlocal chunk, partition, last, parts
        rows, first, after, sizes = _chunk_nodes(chunk, pa.Table.from_batches(parts))
        yield rows
        if last is not None:
            yield _corrections(chunk, _correction(last, first, sizes))
        partition, last, chunk, parts = partition or (first, sizes), after, chunk + 1, []

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, chunk_rows - sum(p.num_rows for p in parts))
            parts.append(part)
            start += part.num_rows
            if sum(p.num_rows for p in parts) >= chunk_rows or sum(len(p.column("sizes").flatten()) for p in parts) >= CHUNK_TURNS:
                yield from flush()
    if parts:
        yield from flush()
    if partition:
        yield _rows({"chunk": [chunk], "first_path": [partition[0]], "first_sizes": [partition[1]], "last_path": [last]})


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _corrections(row["chunk"], _correction(row["before"], row["first_path"], row["first_sizes"]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined pieces of each key; rows come sorted by key and chunk and are held one at a time."""
    key, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done])], names=["ended_key", "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["ended_key", "ends_sha256"])


def trie(paths: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the trie of
    (conv_id, path, sizes), one row a conversation; see ``rebuilt``."""
    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = stored(dealt.mapInArrow(lambda batches: _peeled(batches, chunk_rows), NODE))
    nodes = found.where(F.col("depth").isNotNull())
    # one row a partition meets here, never a row of data
    neighbours = found.where(F.col("depth").isNull()).withColumn("before", F.lag("last_path").over(Window.orderBy("chunk"))).where(F.col("before").isNotNull())
    fixes = neighbours.select("chunk", "before", "first_path", "first_sizes").mapInArrow(_between, NODE)
    shared = nodes.where(F.col("key").isNotNull())
    border = stored(
        shared.unionByName(fixes).groupBy("key").agg(
            F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *[F.sum(k).alias(k) for k in FIGURES]
        )
    )
    pieces = shared.where(F.col("ends").isNotNull()).select("key", "chunk", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_digests, "ended_key binary, ends_sha256 string")
    named = border.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256"]
    on_border = border.join(ends, F.col("key") == F.col("ended_key"), "left").join(named, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    inner = nodes.where(F.col("key").isNull()).withColumn("ends_sha256", F.col("ends"))
    # children of border nodes ask for the parent by chunk as well, so that no key is hot
    of_chunk = shared.where(F.col("conv_id").isNotNull()).select("chunk", F.col("key").alias("parent")).join(named, "parent")
    asking = inner.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(of_chunk, ["chunk", "parent"])
    settled = inner.where(F.col("parent").isNull())
    return settled.select(columns).unionByName(asking.select(columns)).unionByName(on_border.select(columns))


def conversation_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The trie of the rebuilt conversations, a row a node, in no order.

    Turns are ordered by turn, null first, and those that tie by the digest of role and text; repeated rows are turns of their own.
    A null role or text is empty.  Rows of a null id belong to no conversation and are left out.  Other columns are not read; an
    empty table has no nodes.  A conversation's digests (20 bytes a turn) are one row, its texts are not; what ends at a node is
    hashed as a stream.
    """
    rows = conversations.select(*[F.col(c).alias(n) for c, n in ((id_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    return trie(rebuilt(rows), chunk_rows)
