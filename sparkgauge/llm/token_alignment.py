"""Alignment of two tokenizations of the same texts by pointer jumping.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model.  Both cut the same bytes, space + text.
Every token points to the token of the other side that reaches farthest to the right among those it overlaps, which is the one that
covers its last byte; a token of A that ends where a token of B ends points to itself.  Doubling the pointers of a whole batch
(``next = next[next]``) until nothing changes takes each token to the terminal token of its component in a logarithmic number of
steps, and tokens with one terminal are one group.

Neither tokenizer joins a character and white space after it, but for the white space that B's vocabulary glues to it, which is
looked up.  So texts are cut there into units, groups and links lie within a unit, and a worker aligns each distinct unit once and
remembers it (a bounded memory, which changes no result).

Corpus counts take two passes.  Documents are read in chunks of bounded bytes; a chunk writes what it holds as one row: the units of
its documents, the id pairs of its units and the number of its documents that hold each pair linked.  Pair counts are added up over
the chunks, joined back to the chunks that hold the pair, and each chunk sums them over its documents.  No pair is shuffled once per
document or link, and no table of pairs is broadcast.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sparkgauge.llm.pieces import WHITE, Memory
from sparkgauge.session import stored

CHUNK_BYTES = 2_000_000
UNITS_KEPT = 350_000
NO_TOKENS = (-1, 0, 0, 0, b"", "")


def groups_of(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal token (an index into A) of each token of A and of B.

    Arguments are the byte lengths of the tokens of both sides, which cover the same bytes; none is 0.
    """
    a_end, b_end, n = np.cumsum(a_len), np.cumsum(b_len), len(a_len)
    right = np.searchsorted(b_end, a_end)  # the token of B over the last byte
    at_end = b_end[right] == a_end if n else np.zeros(0, bool)
    succ = np.concatenate([np.where(at_end, np.arange(n), n + right), np.searchsorted(a_end, b_end)])
    while True:
        doubled = succ[succ]
        if np.array_equal(doubled, succ):
            return succ[:n], succ[n:]
        succ = doubled


def links_of(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (token of A, token of B) of all overlaps, in order."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first, last = np.searchsorted(b_end, a_end - a_len, "right"), np.searchsorted(b_end, a_end)
    n = last - first + 1
    a = np.repeat(np.arange(len(a_len)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and what is known of the units met so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_of_letter()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.marked = [f"{i}{m}" for i in range(len(self.a_bytes)) for m in ",|"] + [f"{i}{m}" for i in range(len(self.b_bytes)) for m in ",;"]
        self.marked_b, self.marked_size = 2 * len(self.a_bytes), np.array([len(x) for x in self.marked], np.int64)
        self.blank = [self.b.piece_to_id("▁")]
        white = re.compile(f"[{WHITE}]")
        spelled = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # white space that a piece holds behind something else than white space or behind its first blank
        glue = {q for p in spelled for o, q in zip(p, p[1:]) if white.match(q) and (not white.match(o) or (o == " ") != (q == " "))}
        every = f"[{WHITE}]"
        cut = "(?:(?![" + re.escape("".join(sorted(glue))) + "])" + every + ")" if glue else every
        other = f"[^{WHITE}]"
        # white space, the rest, and on until white space that B never glues
        self.units = re.compile(f"{every}*{other}+(?:(?!{cut}){every}+{other}*)*|{every}+").findall
        self.known = Memory(UNITS_KEPT)

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units; B adds a blank of its own, which is the unit's first or goes again."""
        got = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # without text B adds no blank either
        return [self.blank if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, got, strict=True)]

    def facts(self, units: list[str]) -> list[tuple[int, int, int, int, bytes, str]]:
        """Per unit: numbers of tokens of A and B, of groups and links, id pairs of the links (a << 32 | b), the groups as text."""
        out: list = []
        for at in range(0, len(units), 50_000):
            out += self._facts(units[at : at + 50_000])
        return out

    @staticmethod
    def _faithful(raw: list[bytes], sides: list[tuple]) -> list[int]:
        """Units whose tokens join to their bytes on every side: all at once where nothing differs, else one by one."""
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        same = True
        for ids, spelled, size in sides:
            flat = list(chain.from_iterable(ids))
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            same = same and np.array_equal(_sums(size[flat] if flat else np.zeros(0, np.int64), ends), sizes) and b"".join(map(spelled.__getitem__, flat)) == whole
        if same:
            return list(range(len(raw)))
        return [k for k, u in enumerate(raw) if all(b"".join(map(spelled.__getitem__, ids[k])) == u for ids, spelled, _ in sides)]

    def _facts(self, units: list[str]) -> list[tuple[int, int, int, int, bytes, str]]:
        a_ids = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        b_ids = self.encode_b(units)
        raw = [u.encode() for u in units]
        good = self._faithful(raw, [(a_ids, self.a_bytes, self.a_size), (b_ids, self.b_bytes, self.b_size)])
        out: list = [NO_TOKENS] * len(units)
        if not good:
            return out
        if len(good) < len(units):
            a_ids, b_ids = [a_ids[k] for k in good], [b_ids[k] for k in good]
        a_n, b_n = np.fromiter(map(len, a_ids), np.int64, len(good)), np.fromiter(map(len, b_ids), np.int64, len(good))
        a = np.fromiter(chain.from_iterable(a_ids), np.int64, int(a_n.sum()))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_n.sum()))
        a_top, b_top = groups_of(self.a_size[a], self.b_size[b])
        la, lb = links_of(self.a_size[a], self.b_size[b])
        raw = (a[la] << 32 | b[lb]).tobytes()
        a_at = np.concatenate([[0], np.cumsum(a_n)])
        link_at = np.searchsorted(la, a_at).tolist()
        top_at = np.concatenate([[0], np.cumsum(a_top == np.arange(len(a)))])[a_at].tolist()
        # the groups as one text: tokens by group, those of A first, each with the mark that follows it
        order = np.argsort(np.concatenate([a_top * 2, b_top * 2 + 1]), kind="stable")
        last_a, last_b = np.diff(a_top, append=-1) != 0, np.diff(b_top, append=-1) != 0
        word = np.concatenate([a * 2 + last_a, self.marked_b + b * 2 + last_b])[order]
        text = "".join(map(self.marked.__getitem__, word.tolist()))
        text_at = np.concatenate([[0], np.cumsum(self.marked_size[word])])[np.concatenate([[0], np.cumsum(a_n + b_n)])].tolist()
        for j, (k, n_a, n_b) in enumerate(zip(good, a_n.tolist(), b_n.tolist(), strict=True)):
            l0, l1 = link_at[j], link_at[j + 1]
            out[k] = (n_a, n_b, top_at[j + 1] - top_at[j], l1 - l0, raw[8 * l0 : 8 * l1], text[text_at[j] : text_at[j + 1] - 1])
        return out


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that end (exclusive) at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def chunk_row(tokenizers: Pair, texts: list[str | None]) -> dict:
    """What a chunk of texts holds; see ``CHUNK``."""
    cuts = [tokenizers.units(" " + text) if text else [] for text in texts]
    index = dict.fromkeys(chain.from_iterable(cuts))
    index = dict(zip(index, range(len(index)), strict=True))
    own = [list(map(index.__getitem__, cut)) for cut in cuts]
    memory = tokenizers.known
    new = index.keys() - memory.young.keys()
    if new:
        # what is looked up next must be young, also where the memory turns over
        memory.learn(set(index) if len(memory.young) + len(new) > memory.kept // 2 else new, tokenizers.facts)
    known = [memory.young[u] for u in index]
    bad = {k for k, n in enumerate(map(itemgetter(0), known)) if n < 0}
    shas = []
    spelled = list(map(itemgetter(5), known)).__getitem__
    for d, ids in enumerate(own):
        if bad and not bad.isdisjoint(ids):
            own[d] = ids = []
        shas.append(hashlib.sha256(";".join(map(spelled, ids)).encode()).hexdigest() if ids else "")
    ends = np.cumsum([len(x) for x in own]).astype(np.int32)
    units = np.fromiter(chain.from_iterable(own), np.int32, int(ends[-1]) if len(ends) else 0)
    facts = np.stack([np.fromiter(map(itemgetter(k), known), np.int64, len(known)) for k in range(4)], axis=1)
    codes = np.frombuffer(b"".join(map(itemgetter(4), known)), np.int64)
    ids, at = np.unique(codes, return_inverse=True)
    link_end = np.cumsum(facts[:, 3])
    # documents that hold a pair: distinct units of a document first, then distinct pairs
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    held = _distinct(doc * max(len(known), 1) + units) if len(units) else np.zeros(0, np.int64)
    held_doc, held_unit = np.divmod(held, max(len(known), 1))
    n = facts[held_unit, 3]
    first = link_end[held_unit] - n
    link = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    met = _distinct(np.repeat(held_doc, n) * max(len(ids), 1) + at[link]) if len(ids) else np.zeros(0, np.int64)
    docs = np.bincount(met % max(len(ids), 1), minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
    per_doc = {name: _sums(facts[units, k], ends) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    used = docs > 0  # units of texts without tokens count for nothing
    return per_doc | {
        "groups_sha256": shas, "unit": _packed(units), "unit_end": _packed(ends), "link": _packed(at), "link_end": _packed(link_end), "place": np.flatnonzero(used), "pair": ids[used], "docs": docs[used],
    }


LONGS = ArrayType(LongType(), False)
# One row a chunk.  Per document: doc_id to groups_sha256.  unit: the units of all documents, unit_end where each document's end;
# link: the pairs of the links of each distinct unit, link_end where each unit's end; place, pair, docs: the pairs that documents
# hold, their numbers in link, their id pairs, and the number of the chunk's documents that hold them.
PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK = ["unit", "unit_end", "link", "link_end"]
PAIRS = ["place", "pair", "docs"]


def chunked(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of (doc_id, text): ``chunk`` and the columns listed above.  No text row is in two chunks."""
    from pyspark.sql.types import BinaryType, StringType

    schema = StructType(
        [StructField("chunk", LongType()), StructField("doc_id", ArrayType(docs.schema["doc_id"].dataType)), *[StructField(k, LONGS) for k in PER_DOC], StructField("groups_sha256", ArrayType(StringType()))]
        + [StructField(k, BinaryType()) for k in CHUNK] + [StructField(k, LONGS) for k in PAIRS]
    )

    def run(batches):
        from pyspark import TaskContext

        tokenizers, made = pair(a_path, b_path), 0
        base = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        size, ids_type = 0, None

        def row():
            nonlocal made, ids, texts, size
            gc.disable()  # a chunk makes hundreds of thousands of small objects and no cycles
            try:
                got = chunk_row(tokenizers, texts)
            finally:
                gc.enable()
            columns = [pa.array([base + made], pa.int64()), pa.array([ids], pa.list_(ids_type))]
            columns += [pa.array([got[k]], pa.list_(pa.int64())) for k in PER_DOC] + [pa.array([got["groups_sha256"]], pa.list_(pa.string()))]
            columns += [pa.array([got[k]], pa.binary()) for k in CHUNK] + [pa.array([got[k]], pa.list_(pa.int64())) for k in PAIRS]
            made, ids, texts, size = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 8
                if size >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, schema)


def _totals(chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """Rows of the documents of one chunk (one row of ``chunks``) with the sums of their links' counts."""
    unit, ends, link, link_end = (_unpacked(chunks.column(k)[0].as_py()) for k in CHUNK)
    place = counts.column("place").to_numpy()
    size = int(max(link.max(initial=-1), place.max(initial=-1))) + 1
    sums = []
    for name in ("best", "n"):
        value = np.zeros(size, np.int64)
        value[place] = counts.column(name).to_numpy()
        sums.append(pa.array(_sums(_sums(value[link], link_end)[unit], ends), pa.int64()))
    of = {k: chunks.column(k).chunk(0).flatten() for k in ("doc_id", *PER_DOC, "groups_sha256")}
    return pa.table([of["doc_id"], *[of[k] for k in PER_DOC], *sums, of["groups_sha256"]], names=["doc_id", *PER_DOC, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input row, in no order.

    A text that is null or empty, or whose tokens do not join to the bytes of space + text, has no tokens: zeros and an empty
    ``groups_sha256``; it adds to no count.  Null ids and rows that repeat an id are documents of their own.  An empty table gives no
    rows; other columns are not read.  A chunk's row grows with its longest text; no text is cut.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = stored(chunked(rows, a_path, b_path, chunk_bytes))
    held = chunks.select(F.col("chunk").alias("of_chunk"), F.explode(F.arrays_zip(*PAIRS)).alias("p")).select("of_chunk", *[f"p.{k}" for k in PAIRS])
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    # an id of A has at most as many pairs as B has ids
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("bigint"))
    needed = held.select("of_chunk", "place", "pair").join(counts, "pair").select("of_chunk", "place", "n", "best")
    out = StructType([
        StructField("doc_id", rows.schema["doc_id"].dataType), *[StructField(k, LongType()) for k in [*PER_DOC, "n_best", "count_sum"]],
        StructField("groups_sha256", chunks.schema["groups_sha256"].dataType.elementType),
    ])
    return chunks.drop(*PAIRS).groupBy("chunk").cogroup(needed.groupBy("of_chunk")).applyInArrow(_totals, out)
