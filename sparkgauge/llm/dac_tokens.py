"""Token ids in directly addressable codes (DAC), written and read as Spark tables.

An id is cut into 8-bit chunks, the lowest first.  Level 0 holds the first chunk of every id; a
continuation bitmap says which ids go on, and level 1 holds the second chunk of those alone, and so on.  A rank
directory over each bitmap (the number of set bits before every 512th position) makes the place of an id's next chunk a
matter of one directory read and a count over at most 512 bits, so any id is read without decoding a block.

One row of the table is one document: ``doc_id, place, n_tokens, levels`` (one binary per level), ``bitmaps`` and
``ranks``.  The files of the table are ranges of doc_id in ascending order, each file sorted.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkgauge.llm.pieces import WHITE, Memory
from sparkgauge.session import checkpoint_folder

RANK_STEP = 512
WORDS_KEPT = 1_000_000
# White space and what follows it: the tokenizer's split before its merges never joins a character and white space behind it.
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SIDE_BY_SIDE = 1000  # units that are encoded as one text
LEADS = re.compile(f"[{WHITE}]+[^{WHITE}]")


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, bitmaps, rank directories) of a sequence of unsigned ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint64)
    while True:
        levels.append((rest & np.uint64(255)).astype(np.uint8).tobytes())
        more = rest > 255
        if not more.any():
            return levels, bitmaps, ranks
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32)
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        rest = rest[more] >> np.uint64(8)


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a sequence."""
    upper = None
    for k in range(len(levels) - 1, -1, -1):
        own = np.frombuffer(levels[k], np.uint8).astype(np.uint64)
        if upper is not None:
            more = np.unpackbits(np.frombuffer(bitmaps[k], np.uint8), count=len(own), bitorder="little").astype(bool)
            own[more] |= upper << np.uint64(8)
        upper = own
    return upper


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at position ``i`` by rank alone; no other id is decoded."""
    if not 0 <= i < len(levels[0]):
        raise IndexError(i)
    value = 0
    for k in range(len(levels)):
        value |= levels[k][i] << (8 * k)
        if k == len(bitmaps) or not bitmaps[k][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_STEP
        before = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(bitmaps[k][block * RANK_STEP // 8 : (i >> 3) + 1], "little")
        i = before + (bits & ((1 << (i - block * RANK_STEP)) - 1)).bit_count()
    return value


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    special = [t.content for t in made.get_added_tokens_decoder().values()]
    vocabulary = made.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token)  # byte-level tokens have a character for each byte
    return made, special, Memory(WORDS_KEPT), sizes


def _unit_ids(units: list[str], path: str) -> list[bytes]:
    """The ids of each unit, as little-endian 32-bit integers.

    Units that begin with white space and go on are encoded side by side, as in a text; the tokens' bytes tell where each unit ends.
    """
    made, _, _, sizes = _tokenizer(path)
    encode = lambda texts: [np.array(e.ids, "<u4") for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    out: dict[str, bytes] = {}
    led = [u for u in units if LEADS.match(u)]
    groups = [led[k : k + SIDE_BY_SIDE] for k in range(0, len(led), SIDE_BY_SIDE)]
    for group, ids in zip(groups, encode(["".join(g) for g in groups]), strict=True):
        ends = np.cumsum(sizes[ids])
        want = np.cumsum([len(u.encode()) for u in group])
        cuts = np.searchsorted(ends, want)
        if len(ends) and ends[-1] == want[-1] and (ends[cuts] == want).all():
            raw, at = ids.tobytes(), (4 * (cuts + 1)).tolist()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
    rest = [u for u in units if u not in out]
    out.update(zip(rest, [ids.tobytes() for ids in encode(rest)], strict=True))
    return [out[u] for u in units]


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text; units that were met before are not encoded again.

    A text's ids are its units' ids, as the tokenizer never joins two of them.  A text that holds the string of a special token is
    encoded as a whole.
    """
    made, special, memory, _ = _tokenizer(path)
    units = [None if any(s in t for s in special) else UNITS.findall(t) for t in (t or "" for t in texts)]
    known = memory.young
    every = set().union(*filter(None, units))
    new = every.difference(known)  # by the few units of these texts, not by all that are known
    if new:
        # where the memory turns over, all that is looked up next must be young
        memory.learn(every if len(known) + len(new) > memory.kept // 2 else new, lambda words: _unit_ids(words, path))
        known = memory.young
    return [
        np.array(made.encode(text, add_special_tokens=False).ids, "<u4") if own is None else np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4")
        for text, own in zip(texts, units, strict=True)
    ]


def encode(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place, n_tokens, levels, bitmaps, ranks: each whole text's ids and ``end_id``, packed.

    Rows keep their order, and ``place`` numbers those of a partition.  A null or empty text has the end id alone; null ids and repeated
    rows are rows like any other; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        binaries, place = pa.list_(pa.binary()), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                gc.disable()  # many small objects and no cycles
                try:
                    ids = [np.append(x, np.uint32(end_id)) for x in token_ids(part.column("text").to_pylist(), path)]
                    packed = [pack(x) for x in ids]
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.arange(place, place + len(ids))), pa.array([len(x) for x in ids], pa.int64()), *(pa.array([p[k] for p in packed], binaries) for k in range(3))],
                    names=["doc_id", "place", "n_tokens", "levels", "bitmaps", "ranks"],
                )
                place += len(ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, place bigint, n_tokens bigint, levels array<binary>, bitmaps array<binary>, ranks array<binary>")


def write(docs: DataFrame, target: str, path: str, end_id: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the table as files that are ranges of doc_id (nulls first) and, among the rows of one id, of the text's hash, each sorted.

    So an id that a third of all rows share is many files.  Texts are dealt out before they are encoded: finding the ranges reads its
    input once more.
    """
    by = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    rows = docs.select(id_col, text_col)
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    encode(dealt.sortWithinPartitions(*by), path, end_id, id_col, text_col).write.mode("error").parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents that lie before in the files: file totals are summed over the files' order, and rows of one
    file are summed in the order that they were written in.
    """
    table = spark.read.parquet(target).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))

    def run(batches):
        for batch in batches:
            levels, bitmaps = batch.column("levels").to_pylist(), batch.column("bitmaps").to_pylist()
            ids = [unpack(x, y) for x, y in zip(levels, bitmaps, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("doc_id"), batch.column("place"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                names=["file", "doc_id", "place", "n_tokens", "ids_crc32"],
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    rows = table.select("file", "doc_id", "place", "levels", "bitmaps").mapInArrow(run, f"file int, doc_id {kind}, place bigint, n_tokens bigint, ids_crc32 bigint")
    totals = table.groupBy("file").agg(F.sum("n_tokens").alias("_n"))  # one row for each file
    base = totals.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, "file").select(
        "doc_id", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).cast("bigint").alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, end_id: int, files: int | None = None, **columns: str) -> DataFrame:
    """Encode, write to a folder of its own below the shared checkpoint folder, and read the files back.

    An empty input writes a table without rows and reads an empty result.
    """
    spark = docs.sparkSession
    target = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, target, path, end_id, files, **columns)
    return read(spark, target)
