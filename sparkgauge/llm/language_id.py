"""Language identification by mixture inference.

A document is a mixture of languages: each of its hashed byte trigrams was drawn from one of them.  Expectation
maximisation estimates the mixture proportions from the languages' trigram likelihoods; languages are added in
the order of their proportions as long as the likelihood, less a penalty for each language, grows.
Trigram counts come from all labelled training documents; the model has ``2**CODE_BITS`` numbers for each language,
whatever the size of the corpus, so it can be sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.textcodes import FOLD, chunks, utf8

CODE_BITS = 15
SMOOTHING = 0.5
ROUNDS = 10
CHUNK = 500_000
UNKNOWN = "und"

# bytes that stand for a letter or a part of one; all others count as a blank
_CLASS = FOLD.copy()
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigram_codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of every trigram of the documents, each with a blank before and behind it; runs of blanks count once."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(buf) + 2 * len(sizes), 32, np.uint8)
    padded[np.arange(len(buf)) + 2 * doc + 1] = _CLASS[buf]
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (owner[1:] != owner[:-1])
    padded, owner = padded[keep].astype(np.uint32), owner[keep]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - CODE_BITS)
    inside = owner[:-2] == owner[2:]
    return owner[:-2][inside], code[inside].astype(np.int64)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``folds``, is 0 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, code, n over whole texts; summed in each task before anything is shuffled."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi in chunks(np.diff(offsets), CHUNK):
                own = offsets[lo : hi + 1]
                doc, code = trigram_codes(buf[own[0] : own[-1]], own - own[0])
                for name in set(langs[lo:hi]):
                    add = np.bincount(code[(langs[lo:hi] == name)[doc]], minlength=1 << CODE_BITS)
                    total[name] = total[name] + add if name in total else add
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "code", "n"])

    return docs.select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the likelihood of each code in each of them."""
    given = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = count_trigrams(given, text_col, lang_col).toPandas()  # 2**CODE_BITS rows a language at most
    names = sorted(rows["lang"].unique())
    counts = np.zeros((1 << CODE_BITS, len(names)))
    counts[rows["code"].to_numpy(), np.searchsorted(names, rows["lang"].to_numpy())] = rows["n"].to_numpy()
    counts += SMOOTHING
    return names, counts / counts.sum(axis=0)


def _em(p: np.ndarray, n: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` rounds, and the log-likelihood of each document."""
    total = np.add.reduceat(n, first)[:, None]
    for _ in range(rounds):
        part = p * share[doc]
        part *= (n / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total
    return share, np.add.reduceat(n * np.log((p * share[doc]).sum(axis=1)), first)


def infer(doc: np.ndarray, code: np.ndarray, docs: int, model: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions (documents x languages) over each document's chosen language set; a row of zeros has no trigram."""
    out = np.zeros((docs, model.shape[1]))
    if not len(doc) or not model.shape[1]:
        return out
    key, n = np.unique((doc << CODE_BITS) | code, return_counts=True)
    n = n.astype(float)
    doc, code = key >> CODE_BITS, key & ((1 << CODE_BITS) - 1)
    have, first = np.unique(doc, return_index=True)
    p = model[code]
    size = np.diff(np.append(first, len(doc)))
    price = penalty * np.log(np.add.reduceat(n, first) + 1)
    langs = model.shape[1]
    share, _ = _em(p, n, np.repeat(np.arange(len(have)), size), first, np.full((len(have), langs), 1 / langs), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, chosen = np.full(len(have), -np.inf), np.zeros((len(have), langs))
    live = np.arange(len(have))  # documents that the last language helped
    for k in range(1, langs + 1):
        rows = np.isin(np.repeat(np.arange(len(have)), size), live)
        own = np.repeat(np.arange(len(live)), size[live])
        start = np.cumsum(size[live]) - size[live]
        allowed = rank[live] < k
        seed = np.where(allowed, np.maximum(share[live], 1e-3), 0)
        fitted, fit = _em(p[rows], n[rows], own, start, seed / seed.sum(axis=1, keepdims=True), ROUNDS if k > 1 else 0)
        value = fit - k * price[live]
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], fitted[better]
        live = live[better]
        if not len(live):
            break
    out[have] = chosen
    return out


def _predictor(names: list[str], model: np.ndarray, penalty: float):
    """Function from (texts, whether each has a letter) to (language, score, proportions as text)."""

    def predict(texts: pa.Array, letters: pa.Array):
        buf, offsets = utf8(texts)
        shares = np.zeros((len(texts), len(names)))
        for lo, hi in chunks(np.diff(offsets), CHUNK):
            own = offsets[lo : hi + 1]
            doc, code = trigram_codes(buf[own[0] : own[-1]], own - own[0])
            shares[lo:hi] = infer(doc, code, hi - lo, model, penalty)
        known = np.array(letters.fill_null(False).to_pylist(), bool) & (shares.sum(axis=1) > 0)
        best = shares.argmax(axis=1) if len(names) else np.zeros(len(texts), int)
        lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, shares.max(axis=1) if len(names) else 0, 0.0).clip(0, 1)
        mixture = [",".join(f"{names[j]}:{s[j]:.4f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if k else "" for s, k in zip(shares, known, strict=True)]
        return lang, score, mixture

    return predict


def identify(docs: DataFrame, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture (``lang:share`` in falling order) of every whole text.

    ``und`` with score 0: the text is null, empty or has no letter, or there was nothing to learn from.  Equal
    shares go to the first language by name.  Null ids and repeated rows are rows like any other; other columns are not read.
    """
    predict = _predictor(*train(docs, id_col, text_col, lang_col), penalty)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"),
        F.col(text_col).rlike(r"\p{L}").alias("letters"),
    )

    def run(batches):
        for batch in batches:
            lang, score, mixture = predict(batch.column("text"), batch.column("letters"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "mixture"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture string")


def keep_identified(docs: DataFrame, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language can be told, with all their columns as they are; ``und`` rows go."""
    predict = _predictor(*train(docs, id_col, text_col, lang_col), penalty)
    flag = "_letters"
    while flag in docs.columns:
        flag += "_"
    rows = docs.withColumn(flag, F.col(text_col).rlike(r"\p{L}"))

    def run(batches):
        for batch in batches:
            lang, _, _ = predict(batch.column(text_col), batch.column(flag))
            yield batch.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_())).select(docs_columns)

    docs_columns = docs.columns
    return rows.mapInArrow(run, docs.schema)
