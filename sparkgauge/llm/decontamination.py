"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of overlapping word pairs.  The CGK embedding walks along such a sequence with shared random
bits: at step j it writes the symbol under its pointer and moves on if the symbol's j-th random bit says so.  Two
sequences within a small edit distance get embeddings within a small Hamming distance, because the walks
meet again after an edit.  Every word of every document starts an item-sized window; each repetition samples two positions of
the embedding, and a window is a candidate where both sampled symbols equal an item's.  The walk stops early for windows whose
first sampled symbol is no item's.  A candidate goes on if its embedding and the item's agree on some
more symbols than were sampled, and is then verified exactly: an item is found where a stretch of the normalised text
lies within edit distance ``(1 - similarity) * length`` of it, in characters.

A repetition finds a window with e edited pairs among the first w with probability near ((1 - e/w)**2) or more; ``WALKS *
SAMPLES`` repetitions at two anchors bring recall to 0.95 for one word in ten edited.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkgauge.llm.textcodes import FOLD, Words, chunks, mix, utf8

WALKS, SAMPLES = 2, 8
CLASSES = (4, 8, 16, 32, 64)  # embedding positions that are sampled, by item size
BLOCK_BYTES = 4_000_000  # of benchmark text that one pass holds
FILTER_BITS = 18
MIN_WORDS = 5

# bytes between words: all ASCII characters but letters and digits
GAP = np.zeros(256, bool)
GAP[[b for b in range(128) if not chr(b).isalnum()]] = True


def _symbols(words: Words, walk: int | None = None) -> np.ndarray:
    """Hash of each overlapping word pair (a document's last word stands alone), with 64 zeros behind."""
    nxt = np.append(words.hash[1:], np.uint64(0))
    last = words.first[1:] - 1
    nxt[last[np.diff(words.first) > 0]] = 0
    pair = mix(words.hash + mix(nxt, 5))
    return np.concatenate([pair if walk is None else mix(pair, 200 + walk), np.zeros(64, np.uint64)])


def _embedding(pairs: np.ndarray, bits: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` positions of the embeddings of the windows at ``at``, and where a symbol is written first."""
    out, fresh = np.empty((size, len(at)), np.uint64), np.ones((size, len(at)), bool)
    for j in range(size):
        out[j] = pairs[at]
        moved = _walk(bits, at, j, j + 1)
        if j + 1 < size:
            fresh[j + 1] = moved != at
        at = moved
    return out, fresh


def _walk(bits: np.ndarray, at: np.ndarray, start: int, end: int) -> np.ndarray:
    for j in range(start, end):
        at = at + ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return at


def _plan(walk: int) -> list[tuple[int, int, int]]:
    """(class, first position, second position) of the walk's repetitions."""
    draws = np.random.Generator(np.random.PCG64(1000 + walk))
    return sorted({(c, int(draws.integers(0, c // 2)), int(draws.integers(c // 2, c))) for c in CLASSES for _ in range(SAMPLES)}, key=lambda x: x[1])


class Items:
    """One block of benchmark items, ready to be looked for."""

    def __init__(self, rows: list[tuple[str, str | None]], similarity: float):
        self.similarity = similarity
        self.ids, self.text, self.size = [], [], []
        kept = []
        for name, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), GAP)
            if len(words.hash) >= MIN_WORDS:
                self.ids.append(str(name))
                self.text.append(_normalised(raw, words, 0, len(words.hash)))
                self.size.append(len(words.hash))
                kept.append(words)
        # (first symbol, second symbol) of each repetition -> (item, anchor)
        self.tables = []
        for walk in range(WALKS):
            found: dict[tuple[int, int, int], list] = {r: [] for r in _plan(walk)}
            for k, words in enumerate(kept):
                pairs, bits = _symbols(words), _symbols(words, walk)
                for anchor in sorted({0, self.size[k] // 2} if self.size[k] >= 16 else {0}):
                    fit = max(c for c in CLASSES if c <= self.size[k] - anchor)
                    for rep in found:
                        if rep[0] == fit:
                            one = _walk(bits, np.array([anchor]), 0, rep[1])
                            two = _walk(bits, one, rep[1], rep[2])
                            found[rep].append((pairs[one[0]], pairs[two[0]], k, anchor, _embedding(pairs, bits, np.array([anchor]), fit)[0][:, 0]))
            self.tables.append([(rep, *self._table(hits)) for rep, hits in found.items() if hits])

    @staticmethod
    def _table(hits: list) -> tuple[np.ndarray, ...]:
        first, second = (np.array([h[k] for h in hits], np.uint64) for k in (0, 1))
        often = np.zeros(1 << FILTER_BITS, bool)
        often[first >> np.uint64(64 - FILTER_BITS)] = True
        key = mix(first) ^ second
        order = np.argsort(key)
        return often, key[order], np.array([h[2] for h in hits])[order], np.array([h[3] for h in hits])[order], np.array([h[4] for h in hits])[order]

    def find(self, column: pa.Array) -> list[list[int]]:
        """Items found in each text."""
        buf, offsets = utf8(column)
        out: list[list[int]] = []
        for lo, hi in chunks(np.diff(offsets), 1_000_000):
            own = offsets[lo : hi + 1]
            part = buf[own[0] : own[-1]]
            words = Words(part, own - own[0], GAP)
            found: list[set[int]] = [set() for _ in range(hi - lo)]
            for doc, item, start in self._candidates(words):
                if item not in found[doc] and self._verified(part, words, doc, item, start):
                    found[doc].add(item)
            out += [sorted(x) for x in found]
        return out

    def _candidates(self, words: Words) -> list[tuple[int, int, int]]:
        pairs = _symbols(words)
        short = (pairs >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
        owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        hits = []
        for walk, table in enumerate(self.tables):
            bits = _symbols(words, walk)
            at, step = np.arange(len(owner)), 0
            for (size, one, two), often, keys, item, anchor, embedded in table:
                at, step = _walk(bits, at, step, one), one
                alive = np.flatnonzero(often[short[at]])
                if not len(alive):
                    continue
                first = at[alive]
                key = mix(pairs[first]) ^ pairs[_walk(bits, first, one, two)]
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                some = np.flatnonzero(high > low)
                if not len(some):
                    continue
                entry = np.concatenate([np.arange(low[x], high[x]) for x in some])
                start = np.repeat(alive[some], (high - low)[some])
                written, fresh = _embedding(pairs, bits, start, size)
                same = ((written.T == embedded[entry]) & fresh.T).sum(axis=1)
                good = same >= 2 + size // 16
                hits += [(int(owner[s]), int(item[k]), int(s - anchor[k])) for s, k in zip(start[good], entry[good], strict=True)]
        return sorted(set(hits))

    def _verified(self, buf: np.ndarray, words: Words, doc: int, item: int, start: int) -> bool:
        lowest, end = int(words.first[doc]), int(words.first[doc + 1])
        text, spare = self.text[item], math.ceil(self.size[item] * (1 - self.similarity)) + 2
        window = _normalised(buf, words, max(lowest, start - spare), min(end, start + self.size[item] + spare))
        most = allowed(text, self.similarity)
        return text in window or stretch_distance(text, window, most) <= most


def allowed(item: str, similarity: float) -> int:
    return math.floor(len(item) * (1 - similarity) + 1e-9)


def _normalised(buf: np.ndarray, words: Words, lo: int, hi: int) -> str:
    folded = FOLD[buf[words.start[lo] : words.end[hi - 1]]] if hi > lo else buf[:0]
    return " ".join(x for x in folded.tobytes().decode("utf-8", "replace").translate(_BLANKS).split(" ") if x)


_BLANKS = {b: " " for b in range(128) if GAP[b]}


def stretch_distance(item: str, text: str, most: int | None = None) -> int:
    """Least edit distance between ``item`` and any stretch of ``text``; once it is known to be over ``most``, any such number."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    along = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, np.int64)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != c))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - along) + along
        if most is not None and i % 16 == 0 and row.min() > most:
            return int(row.min())
    return int(row.min())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple]]:
    """The benchmark in blocks of bounded bytes, fetched one after another."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    return [[(r["item"], r["text"]) for r in rows.where(block == k).collect()] for k in range(parts)]


def find_items(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, items: the ids (as text) of the benchmark items found in each whole text.

    One row per input row.  A null or empty text holds nothing; items of fewer than ``MIN_WORDS`` words, null ones included, are not
    looked for; an item with a null id shows as null text 'None'; repeated items show once for each row; an empty benchmark finds nothing.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<string>").alias("items"))
    for rows in _blocks(benchmark, item_col, item_text_col):
        out = out.mapInArrow(_finder(rows, similarity), out.schema)
    return out.select("doc_id", "items")


def _finder(rows: list[tuple], similarity: float):
    def run(batches):
        items = Items(rows, similarity)
        for batch in batches:
            found = items.find(batch.column("text"))
            old = batch.column("items").to_pylist()
            new = pa.array([a + [items.ids[k] for k in b] for a, b in zip(old, found, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), new], names=["doc_id", "text", "items"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns as they are."""
    for rows in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_cleaner(rows, similarity, text_col), docs.schema)
    return docs


def _cleaner(rows: list[tuple], similarity: float, text_col: str):
    def run(batches):
        items = Items(rows, similarity)
        for batch in batches:
            yield batch.filter(pa.array([not x for x in items.find(batch.column(text_col))], pa.bool_()))

    return run
