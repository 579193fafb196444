"""Licence scan by ordered signature rules, with DataFrame functions alone.

A text becomes its words, joined by single blanks.  Texts without any rule's keyword stop there: one pass of one regular expression.
In the others, each place of a keyword is an anchor, and only that keyword's rules are tried, only in the words around the anchor, and
only where those words hold the rule's second literal.  A match must cover its anchor; the blank before the anchor is written as
``MARK``, so that a match says where it lies.  Detections are resolved in one sweep in the order of (start, longer first, rank): one
that lies within another of the same or a stronger tier goes, also where both have the same stretch and the other's rule comes first.

Everything happens within a row: no shuffle, no broadcast, work in proportion to a text's length and anchors.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.license_rules import TIERS

# What separates words, and the base phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

MARK = "\x01"
BEFORE, AFTER = 26, 24  # words around an anchor: no signature is longer
RANKS = 1000  # more than a tier has rules
SURE = [1.0, 0.9, 0.7, 0.4]  # what a detection of each tier is worth
FOUND = "array<struct<start:int,back:int,rank:int,label:string>>"


def required(signature: str) -> str:
    """The signature without its optional groups and those of several ways."""
    out = [""]
    for part in re.split(r"(\(\?:|\)\??)", signature):
        if part == "(?:":
            out.append("")
        elif part.startswith(")"):
            inner = out.pop()
            out[-1] += inner if part == ")" and "|" not in inner else ""
        else:
            out[-1] += part
    return out[0]


@cache
def rules() -> dict[str, list[dict]]:
    """Rules by anchor word: need, pattern, rank, label.

    A rule whose matches all hold the word licence is anchored there, as its own keyword may be an everyday word.
    """
    by_anchor: dict[str, list[dict]] = {}
    for tier, ordered in enumerate(TIERS):
        for k, (label, keyword, signature) in enumerate(ordered):
            anchors = [keyword]
            if "licen[cs]ed?" in required(signature):
                anchors = ["license", "licence", "licensed", "licenced"]
            elif re.search(r"licen\[cs\]e(?!s)", required(signature)):
                anchors = ["license", "licence"]
            gap = f"[ {MARK}]"
            pattern = gap + "(?:" + signature.replace(" ", gap).replace(r"\S", f"[^ {MARK}]") + f")(?![^ {MARK}])"
            for a in anchors:
                by_anchor.setdefault(a, []).append({"need": keyword, "pattern": pattern, "rank": tier * RANKS + k, "label": label})
    return by_anchor


def keyword_gate(words: list[str]) -> str:
    """A pattern that finds any of the words in blank-separated text, whatever the case of A-Z, by their common beginnings."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def spelled(at: dict) -> str:
        ways = [re.escape(c) + spelled(below) if c else "(?![^ ])" for c, below in sorted(at.items(), reverse=True)]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?i)(?<![^ ])(?=[" + "".join(sorted(tree)) + "])" + spelled(tree)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(words: Column) -> Column:
    """All matches of all rules in an array of words, sorted; ``back`` is the end (exclusive) below zero."""
    known = rules()
    schema = "map<string,array<struct<need:string,pattern:string,rank:int,label:string>>>"
    table = F.from_json(F.lit(json.dumps(known)), schema)
    names = F.array(*[F.lit(a) for a in sorted(known)])
    anchors = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda a: F.array_contains(names, a["word"]))

    def window(a: Column) -> Column:
        low = F.greatest(a["at"] - BEFORE, F.lit(0))
        ahead = F.when(low < a["at"], F.concat(F.lit(" "), F.array_join(F.slice(words, low + 1, a["at"] - low), " "))).otherwise("")
        return F.struct(a["at"].alias("at"), a["word"].alias("word"), F.concat(ahead, F.lit(MARK), F.array_join(F.slice(words, a["at"] + 1, F.lit(AFTER)), " ")).alias("text"))

    def hit(x: Column, r: Column) -> Column:
        here = F.get(F.filter(F.regexp_extract_all(x["text"], r["pattern"], F.lit(0)), lambda m: F.contains(m, F.lit(MARK))), F.lit(0))

        def placed(m: Column) -> Column:
            start = x["at"] - _blanks(F.substring_index(m, MARK, 1))
            return F.when(m.isNotNull(), F.struct(start.alias("start"), (-(start + _blanks(m) + 1)).alias("back"), r["rank"].alias("rank"), r["label"].alias("label")))

        return _bind(here, placed)

    def tried(x: Column) -> Column:
        return F.transform(F.filter(F.element_at(table, x["word"]), lambda r: F.contains(x["text"], r["need"])), lambda r: hit(x, r))

    return F.array_sort(F.filter(F.flatten(F.transform(anchors, lambda a: _bind(window(a), tried))), lambda d: d.isNotNull()))


def resolved(found: Column, spans: bool) -> Column:
    """Struct of labels (distinct), tier (the strongest kept, null without), kept (number) and, with ``spans``, the kept detections."""
    none = F.array().cast("array<struct<start:int,end:int,rank:int,label:string>>")
    zero = F.struct(
        F.array(*[F.lit(-1)] * len(TIERS)).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(len(TIERS)).alias("tier"), F.lit(0).alias("kept"), none.alias("spans"),
    )

    def step(s: Column, d: Column) -> Column:
        tier, end = F.floor(d["rank"] / RANKS).cast("int"), -d["back"]
        stays = F.get(s["reach"], tier) < end
        span = F.struct(d["start"].alias("start"), end.alias("end"), d["rank"].alias("rank"), d["label"].alias("label"))
        return F.struct(
            F.transform(s["reach"], lambda v, t: F.when(t >= tier, F.greatest(v, end)).otherwise(v)).alias("reach"),
            F.when(stays & ~F.array_contains(s["labels"], d["label"]), F.concat(s["labels"], F.array(d["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(stays, F.least(s["tier"], tier)).otherwise(s["tier"]).alias("tier"),
            (s["kept"] + stays.cast("int")).alias("kept"),
            (F.when(stays, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]) if spans else s["spans"]).alias("spans"),
        )

    return F.aggregate(found, zero, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, one row per input row.

    Base places are those of the words of ``PHRASES``; labels are theirs and those of the rules' detections, distinct, sorted and
    comma-joined.  The score is that of the strongest detection, 0 without.  With ``spans`` the kept detections come as an array of
    (start, end, rank, label), in words from 0, the end exclusive; gathering them costs the square of their number in one text, which
    the other columns do not.  A null or empty text has no words: zeros, nulls and empty labels.  Null ids and repeated rows are kept
    as they are; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), NO_WORD, " ")).alias("said"))
    told = rows.withColumn("gate", F.regexp_like("said", F.lit(keyword_gate(sorted(rules())))))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.col("gate"), F.translate("said", upper, upper.lower()))
    told = told.withColumn("low", low).withColumn("n_words", F.when(F.col("said") == "", 0).otherwise(_blanks(F.col("said")) + 1).cast("bigint"))
    told = told.withColumn("got", F.when(F.col("gate"), resolved(detections(F.split("low", " ")), spans)))
    for k, phrase in enumerate(PHRASES):
        told = told.withColumn(f"gaps{k}", F.when(F.col("gate"), F.split("low", f"(?<![^ ]){phrase}(?![^ ])", -1)))
    n = [F.coalesce(F.size(f"gaps{k}") - 1, F.lit(0)) for k in range(len(PHRASES))]
    held = [F.size(f"gaps{k}") > 1 for k in range(len(PHRASES))]
    # the blanks before the first place and after the last one say where they are
    first = F.least(*[F.when(h, _blanks(F.get(f"gaps{k}", F.lit(0)))) for k, h in enumerate(held)])
    last = F.greatest(*[F.when(h, F.col("n_words") - len(p.split()) - _blanks(F.element_at(f"gaps{k}", -1))) for k, (h, p) in enumerate(zip(held, PHRASES, strict=True))])
    base = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, label in zip(held, PHRASES.values(), strict=True)]))
    labels = F.coalesce(F.array_union(base, F.col("got.labels")), base)
    out = told.select(
        "doc_id", "n_words", sum(n[1:], n[0]).cast("bigint").alias("n_base"), first.cast("bigint").alias("first_word"), last.cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.get(F.array(*map(F.lit, SURE)), F.col("got.tier")), F.lit(0.0)).alias("score"),
        F.coalesce("got.kept", F.lit(0)).cast("bigint").alias("n_detections"), F.col("got.spans").alias("spans"),
    )
    return out if spans else out.drop("spans")
