"""Byte-level BPE by recursive queries: DuckDB contracts the words of each partition.

A word starts as one (word, position, token) row per byte.  A recursive query joins these rows with the
merge table, finds each word's pair of least rank (the leftmost of equals), contracts it, and stops when no
word has a pair left.  An ordered aggregation puts the ids of a word in a list and its tokens' bytes in a
string, which is how ids are decoded.  Words repeat, so a worker remembers what it has encoded, up to
``WORDS_KEPT`` words; forgetting changes no result.

A step of the query contracts one pair of a word and gives all of its rows again, so its work grows with the square of a
word's bytes.  Words of more than ``LONG_BYTES`` bytes are therefore contracted outside DuckDB, by the same rule with a heap of
pairs, in n log n steps; no length is refused.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkgauge.llm.pieces import Memory, splitter

WORDS_KEPT = 800_000
WORDS_PER_QUERY = 50_000
BYTES_PER_QUERY = 1_000_000
LONG_BYTES = 4096  # positions of shorter words fit the 20 bits that they have in the packed number

# (position, next position and rank are packed in one number, so that one min() finds the leftmost pair)
ENCODE = """
with recursive step(w, pos, np, id, nxt, live) as (
  select w, pos, lead(pos) over d, id, lead(id) over d, true from start_rows
  window d as (partition by w order by pos)
  union all
  select s.w, s.pos,
    case when s.pos = b.at then b.after_pos else s.np end,
    case when s.pos = b.at then b.made else s.id end,
    case when s.pos = b.at then b.after_id when s.np = b.at then b.made else s.nxt end,
    b.w is not null
  from step s left join (
    select c.w, (c.best // 1099511627776)::int as made, ((c.best // 1048576) % 1048576)::int as at,
      (c.best % 1048576)::int as gone, g.np as after_pos, g.nxt as after_id
    from (
      select q.w, min(m.made::bigint * 1099511627776 + q.pos::bigint * 1048576 + q.np) as best
      from step q join merges m on m.l = q.id and m.r = q.nxt where q.live group by q.w
    ) c join step g on g.w = c.w and g.pos = c.best % 1048576 and g.live
  ) b on b.w = s.w
  where s.live and (b.w is null or s.pos <> b.gone)
)
select w, list(id order by pos) as ids from step where not live group by w order by w
"""
DECODE = """
select i.w, string_agg(v.hex, '' order by i.pos) as hex
from id_rows i join vocabulary v on v.id = i.id group by i.w order by i.w
"""


def _positions(sizes: np.ndarray) -> dict:
    """Columns w and pos of the rows of words with so many tokens each."""
    w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    pos = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return {"w": w, "pos": pos.astype(np.int32)}


def _long(word: str) -> bool:
    return len(word) * 4 > LONG_BYTES and len(word.encode()) > LONG_BYTES


class Codec:
    """Merge table and vocabulary of one rank file, held in a DuckDB of the worker's own process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = splitter(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.merged = {a << 32 | b: c for a, b, c in zip(left, right, made, strict=True)}
        self.token = {rank: token for token, rank in ranks.items()}
        int32 = pa.int32()
        self._table("merges", {"l": pa.array(left, int32), "r": pa.array(right, int32), "made": pa.array(made, int32)})
        self._table("vocabulary", {"id": pa.array(ranks.values(), int32), "hex": pa.array([t.hex() for t in ranks])})
        self.memory = Memory(WORDS_KEPT)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    def _query(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table()

    def encode_words(self, words: list[str]) -> pa.ListArray:
        """Ids of each word (pieces of the pattern, not empty, of ``LONG_BYTES`` at most)."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self._table("start_rows", _positions(sizes) | {"id": self.single[np.frombuffer(b"".join(raw), np.uint8)]})
        return self._query(ENCODE).column("ids").combine_chunks()

    def decode_words(self, ids: pa.ListArray) -> list[bytes]:
        sizes = np.diff(ids.offsets.to_numpy())
        self._table("id_rows", _positions(sizes) | {"id": ids.flatten()})
        return [bytes.fromhex(x) for x in self._query(DECODE).column("hex").to_pylist()]

    def encode_long(self, raw: bytes) -> array:
        """Ids of one word of any length: the pair of least rank, the leftmost of equals, is contracted until none is left."""
        ids, n, merged = array("i", self.single[np.frombuffer(raw, np.uint8)].tolist()), len(raw), self.merged
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [made << 40 | i for i in range(n - 1) if (made := merged.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = divmod(heapq.heappop(heap), 1 << 40)
            if ids[i] < 0 or (j := after[i]) == n or merged.get(ids[i] << 32 | ids[j]) != made:
                continue  # one of its tokens has been contracted since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (rank := merged.get(ids[at] << 32 | ids[after[at]])) is not None:
                    heapq.heappush(heap, rank << 40 | at)
        return array("i", (x for x in ids if x >= 0))

    def facts(self, words: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids in decimal joined by commas, decoded bytes."""
        out, at = [], 0
        while at < len(words):
            end, size = at, 0
            if _long(words[at]):
                long = self.encode_long(words[at].encode())
                out.append((len(long), ",".join(map(str, long)), b"".join(map(self.token.__getitem__, long))))
                at += 1
                continue
            while end < len(words) and end - at < WORDS_PER_QUERY and size < BYTES_PER_QUERY and not _long(words[end]):
                size += len(words[end])
                end += 1
            ids = self.encode_words(words[at:end])
            out += [(len(own), ",".join(map(str, own)), raw) for own, raw in zip(ids.to_pylist(), self.decode_words(ids), strict=True)]
            at = end
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_batch(texts: list[str | None], path: str, pattern: str) -> tuple[list[int], list[str], list[bytes]]:
    """Per text: number of ids, ids in decimal joined by commas, bytes that the ids decode to."""
    c = codec(path, pattern)
    out: tuple[list, list, list] = ([], [], [])
    at = 0
    while at < len(texts):
        split, size = [], 0
        while at < len(texts) and size < BYTES_PER_QUERY:
            split.append(c.split(texts[at] or ""))
            size += len(texts[at] or "")
            at += 1
        known = c.memory.young
        new = {w for words in split for w in words if w not in known}
        if new:
            c.memory.learn(new if len(new) + len(known) <= WORDS_KEPT // 2 else set().union(*split), c.facts)
            known = c.memory.young
        for words in split:
            found = [known[w] for w in words]
            out[0].append(sum(x[0] for x in found))
            out[1].append(",".join([x[1] for x in found]))
            out[2].append(b"".join([x[2] for x in found]))
    return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text: doc_id, n_tokens, ids (decimal, comma-joined), ids_sha256, decoded_sha256.

    One row per input row, in no order.  A null or empty text has no ids and the digests of the empty string;
    null ids and repeated rows are kept as they are; other columns of the input are not read.
    ``keep_ids=False`` leaves the long ``ids`` strings out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = "doc_id {}, n_tokens bigint, ids_sha256 string, decoded_sha256 string".format(rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, ids, raw = encode_batch(part.column("text").to_pylist(), path, pattern)
                columns = [
                    part.column("doc_id").cast(ids_type), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids)] if keep_ids else [])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return rows.mapInArrow(run, fields + (", ids string" if keep_ids else ""))
