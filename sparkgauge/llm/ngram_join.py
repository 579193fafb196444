"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows are documents, columns are hashed word n-grams.  The product of the incidence matrix with its transpose is
accumulated block of columns by block of columns (the shuffle by column), and only over the columns that can matter: in one
global column order (frequent columns last) a document needs its first ``n - ceil(t n) + 1`` columns, since two sets with
Jaccard t share one of those.  Accumulated counts below the bound that the two sizes imply are discarded;
what is left is verified on the whole texts.

The result is connectivity, so a group of copies need not be multiplied out: documents with equal sets are
one class; then the documents that share a minimum hash are compared with one hub of theirs and joined where they
link.  The product then leaves out entries inside a component, which cannot change the result.

A column that more than ``HOT`` documents have among their first ones takes part by its place in them only: where it is the first
column that two documents share, both go on for at least as long as their overlap must be.  ``reach`` is the largest size of the
other set that this allows.  Before the product, each document of a hot column is compared with the document of its size band, and
of the next smaller band, in which the column stands foremost, so that documents that share a passage and link are one component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.llm.textcodes import Words, chunks, mix, shingle_hashes, utf8
from sparkgauge.operators.components import components
from sparkgauge.session import arrow_rows, cut, stored

HUB_ROUNDS, HUBS = 3, 6
HOT = 32  # columns that more documents have among their first ones are joined by reach
FREQUENT_SHARE = 5e-4  # columns of a larger share of the documents are ordered last
NO_ID = -(2**63)
PAIR_ROWS = 128  # pairs of whole texts that a worker holds at a time
BROADCAST_IDS = 200_000  # ids of texts to fetch that are broadcast; more are shuffled


def _sets(batch_text: pa.Array, n: int):
    """Per chunk: (first row, rows, document of each entry, entry), entries distinct and sorted by document, then hash."""
    buf, offsets = utf8(batch_text)
    for lo, hi in chunks(np.diff(offsets)):
        own = offsets[lo : hi + 1]
        h, first = shingle_hashes(Words(buf[own[0] : own[-1]], own - own[0]), n)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield lo, hi - lo, doc[new], h[new]


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def sketches(rows: DataFrame, n: int) -> DataFrame:
    """id, n_shingles, two order-free hashes of the set, and minimum hashes of several orders."""
    hubs = HUB_ROUNDS * HUBS

    def run(batches):
        for batch in batches:
            for lo, count, doc, h in _sets(batch.column("text"), n):
                size = np.bincount(doc, minlength=count)
                sums = np.zeros((2, count), np.uint64)
                least = np.zeros((count, hubs), np.uint64)
                have = np.flatnonzero(size)
                if len(have):
                    at = np.searchsorted(doc, have)
                    for k in range(2):
                        sums[k][have] = np.add.reduceat(mix(h, 31 + k), at)
                    for k in range(hubs):
                        least[have, k] = np.minimum.reduceat(mix(h, 51 + k), at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, count), pa.array(size.astype(np.int64)), _long(sums[0]), _long(sums[1]),
                     pa.FixedSizeListArray.from_arrays(_long(least.ravel()), hubs).cast(pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "s1", "s2", "least"],
                )

    return rows.mapInArrow(run, "id bigint, n_shingles bigint, s1 bigint, s2 bigint, least array<bigint>")


def frequent_columns(rows: DataFrame, n: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of more than ``FREQUENT_SHARE`` of the documents and their order among themselves.

    Bounded whatever the corpus: such columns number at most the mean set size / FREQUENT_SHARE.  A task counts its own
    documents and passes on what is frequent among them, so a column near the limit may be missed,
    which costs time and changes no result: every order of the columns is valid.
    """

    def run(batches):
        found: list[np.ndarray] = []
        seen = 0

        def counted(parts):
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            most = c >= max(4, FREQUENT_SHARE / 2 * seen)
            return pa.RecordBatch.from_arrays([_long(h[most]), pa.array(c[most].astype(np.int64))], names=["h", "c"])

        held = 0
        for batch in batches:
            for _, count, _, h in _sets(batch.column("text"), n):
                found.append(h)
                held += len(h)
                seen += count
                if held > 4_000_000:
                    yield counted(found)
                    found, held, seen = [], 0, 0
        if found:
            yield counted(found)

    counts = rows.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= max(16, FREQUENT_SHARE / 2 * docs)).toPandas().sort_values("h")
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (1 + np.log2(top["c"].to_numpy(float)).astype(np.int64))[order]


def incidence(rows: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, id, n_shingles, reach: the entries of each document's first columns.  Equal sets of one chunk are entered once.

    ``reach`` is the size of the largest set that can link where nothing before this entry is shared: the n - k entries from place k on
    must be at least percent / (100 + percent) of both sizes together.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, rank = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, count, doc, h in _sets(batch.column("text"), n):
                if not len(h):
                    continue
                size = np.bincount(doc, minlength=count)
                start = np.cumsum(size) - size
                total = np.zeros(count, np.uint64)
                have = np.flatnonzero(size)
                total[have] = np.add.reduceat(mix(h, 31), start[have])
                own_ids = ids[lo : lo + count]
                order = np.lexsort((own_ids, total))
                keep = np.zeros(count, bool)  # of documents with one set, the smallest id
                keep[order[np.concatenate([[True], total[order][1:] != total[order][:-1]])]] = True
                place = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    place = np.where(often[at] == h, rank[at], 0)
                order = np.lexsort((h, place, doc))
                prefix = size - (percent * size + 99) // 100 + 1
                first = (np.arange(len(h)) - start[doc] < prefix[doc]) & keep[doc]
                place = (np.arange(len(h)) - start[doc])[first]
                h, doc = h[order][first], doc[first]
                reach = (size[doc] - place) * (100 + percent) // percent - size[doc]
                yield pa.RecordBatch.from_arrays(
                    [_long(h), pa.array(own_ids[doc]), pa.array(size[doc].astype(np.int32)), pa.array(reach.astype(np.int32))], names=["h", "id", "n_shingles", "reach"]
                )

    return rows.mapInArrow(run, "h bigint, id bigint, n_shingles int, reach int")


def _reached(a: str, b: str) -> Column:
    return (F.col(f"n_shingles{a}") <= F.col(f"reach{b}")) & (F.col(f"n_shingles{b}") <= F.col(f"reach{a}"))


def _near(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def met_in_columns(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs of entries of one column that lie in different components and whose sizes, or in a hot column whose reach, let them link."""
    side = lambda x: entries.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n_shingles", "component", "reach", "hot", "n_hot")])
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & _near("n_shingles_a", "n_shingles_b", percent)
    return side("a").join(side("b"), "h").where(apart & (~F.col("hot_a") | _reached("_a", "_b")))


def foremost_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each entry of a hot column with the foremost entry of its size band and of the next smaller one: two rows an entry at most."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n_shingles")
    hot = entries.where("hot").withColumn("band", band)
    order = F.struct((F.col("reach") / F.col("n_shingles")).alias("part"), "id", "n_shingles", "reach", "component")
    hubs = hot.groupBy("h", "band").agg(F.max(order).alias("hub"))
    hubs = hubs.select("h", "band", *[F.col(f"hub.{c}").alias(f"{c}_hub") for c in ("id", "n_shingles", "reach", "component")])
    met = hot.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(hubs, ["h", "band"])
    met = met.where((F.col("component") != F.col("component_hub")) & _reached("", "_hub"))
    return met.select(F.least("id", "id_hub").alias("a"), F.greatest("id", "id_hub").alias("b")).distinct()


def linked(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link: 100 * intersection >= percent * union."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ends = stored(ends)
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)
    texts = rows.join(ends, "id", "left_semi")
    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                # the two texts of a pair share a row number, so that one sort finds what they share
                sides = [[(doc + lo, h) for lo, _, doc, h in _sets(part.column(c), n)] for c in ("ta", "tb")]
                rows_, h = (np.concatenate([x[k] for side in sides for x in side]) for k in (0, 1))
                order = np.lexsort((h, rows_))
                rows_, h = rows_[order], h[order]
                same = np.bincount(rows_[1:][(rows_[1:] == rows_[:-1]) & (h[1:] == h[:-1])], minlength=part.num_rows)
                union = np.bincount(rows_, minlength=part.num_rows) - same
                good = (100 * same >= percent * union) & (union > 0)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a bigint, b bigint")


def _with_component(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (id, ...) with column component; a node without a label is its own."""
    named = labels.select(F.col("node").alias("id"), "component")
    return nodes.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the components of the links 100 * intersection >= percent * union.

    Words are split at ASCII white space and A-Z is folded; a text with fewer than n words has one shingle, its whole
    sequence; a null text or one without words has none and links with nothing.  One row for each distinct id: rows that repeat
    an id are versions of one document, any version's links count, and n_shingles is the largest.  A null id
    counts as the smallest id; its component_id is null.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    known = cut(sketches(rows, n))
    total = known.count()
    full = known.where(F.col("n_shingles") > 0)
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep"))
    member = full.join(classes, ["s1", "s2", "n_shingles"]).select("id", "rep", "n_shingles", "least")
    edges = member.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    reps = member.where(F.col("id") == F.col("rep")).select("id", "n_shingles", "least")

    # hubs: in each group of one minimum hash the first document by a hash order, which the slots of a round share
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("least")[k].alias("value")) for k in range(HUB_ROUNDS * HUBS)])
    keyed = reps.select("id", "n_shingles", F.explode(slots).alias("key"))
    order = F.xxhash64("id", F.call_function("div", F.col("key.slot"), F.lit(HUBS)))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("hub"), F.col("n_shingles").alias("size"))).alias("h"))
    met = keyed.join(hubs, "key").where((F.col("id") != F.col("h.hub")) & _near("n_shingles", "h.size", percent))
    met = met.select(F.least("id", "h.hub").alias("a"), F.greatest("id", "h.hub").alias("b")).distinct()
    # only pairs whose minimum hashes often agree are worth their texts here; the product below finds the others
    own = lambda c: reps.select(F.col("id").alias(c), F.col("least").alias(f"least_{c}"))
    agree = F.size(F.filter(F.zip_with("least_a", "least_b", lambda x, y: x == y), lambda x: x))
    promising = lambda pairs: stored(pairs.join(own("a"), "a").join(own("b"), "b").where(100 * agree >= (percent - 30) * HUB_ROUNDS * HUBS).select("a", "b"))
    spark = docs.sparkSession
    met = promising(met)
    with arrow_rows(spark, PAIR_ROWS):
        links = cut(linked(met, rows, n, percent))
    labels = components(links)

    frequent = frequent_columns(rows, n, total)
    entries = incidence(rows, n, percent, frequent).repartition("h")
    column = Window.partitionBy("h")
    entries = entries.withColumns({"lo": F.min("id").over(column), "hi": F.max("id").over(column), "docs": F.count(F.lit(1)).over(column)}).where("lo < hi")
    entries = entries.select("h", "id", "n_shingles", "reach", (F.col("docs") > HOT).alias("hot")).join(reps.select("id"), "id", "left_semi")
    entries = entries.withColumn("n_hot", F.count(F.when(F.col("hot"), 1)).over(Window.partitionBy("id")).cast("int"))
    entries = cut(_with_component(entries, labels))
    met = promising(foremost_pairs(entries, percent))
    with arrow_rows(spark, PAIR_ROWS):
        links = cut(links.union(linked(met, rows, n, percent)))
    labels = components(links)
    entries = _with_component(entries.drop("component"), labels)
    several = entries.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    entries = cut(entries.join(several, "h", "left_semi"))
    product = met_in_columns(entries, percent).groupBy("id_a", "id_b", "n_shingles_a", "n_shingles_b", "n_hot_a", "n_hot_b").agg(F.count(F.when(~F.col("hot_a"), 1)).alias("overlap"))
    # of a document's entries after its first columns at most ceil(t n) - 1 can be shared, and hot columns are not counted
    need = F.ceil((F.col("n_shingles_a") + F.col("n_shingles_b")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    rest = F.ceil(F.greatest("n_shingles_a", "n_shingles_b") * F.lit(percent) / 100.0 - 1e-9) - 1 + F.least("n_hot_a", "n_hot_b")
    pairs = stored(product.where(F.col("overlap") + rest >= need).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    with arrow_rows(spark, PAIR_ROWS):
        links = links.union(cut(linked(pairs, rows, n, percent))).union(edges)
    labels = components(links)
    sizes = known.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _with_component(sizes, labels).select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, with all their columns as they are (a null id is the smallest)."""
    out = jaccard_components(docs, n, percent, id_col, text_col)
    gone = cut(out.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
