"""Operator 11 against whole-text matching of every rule and quadratic suppression in plain Python."""

import random
import re

from sparkgauge.llm import license_scan
from sparkgauge.llm.license_rules import TIERS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "CC BY-NC", "SPDX-License-Identifier: GPL-2.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "mit license", "the GPL", "All rights reserved", "https://www.apache.org/licenses/LICENSE-2.0.txt", "under the mit licence",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "public domain", "ich gehe mit dir", "commons clause", "See the LICENSE file", "Creative Commons Attribution-ShareAlike 4.0 International",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "http://creativecommons.org/licenses/by-nc-sa/3.0/", "BSD 3-Clause License", "Copyright (c) 2019-2021", "for any purpose", "K", "élan", "Licenses",
]


def upper_to_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    words = WORD.findall(upper_to_lower(text or ""))
    said = " ".join(words)
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    found = set()
    for tier, ordered in enumerate(TIERS):
        for rank, (label, _, signature) in enumerate(ordered):
            for m in re.finditer(f"(?<![^ ])(?:{signature})(?![^ ])", said):
                start = said[: m.start()].count(" ")
                found.add((start, start + m[0].count(" ") + 1, tier, rank, label))
    kept = [
        d for d in found
        if not any(o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and (o[:2] != d[:2] or (o[2], o[3]) < (d[2], d[3])) for o in found)
    ]
    base = {label for _, label in places}
    return (
        len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {d[4] for d in kept})), max((license_scan.SURE[d[2]] for d in kept), default=0.0), len(kept),
    )


def test_rules():
    assert sum(map(len, TIERS)) > 250
    for ordered in TIERS:
        assert len(ordered) < license_scan.RANKS
    assert license_scan.required("a(?: b)?(?: c)(?:d|e) f") == "a c f"
    gate = re.compile(license_scan.keyword_gate(["mit", "gpl", "gplv2", "license"]))
    assert [bool(gate.search(x)) for x in ("the gpl", "gplv2", "GPLv3", "permit", "x License y", "licenses")] == [True, True, False, False, True, False]


def test_equals_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " .,;", "plain", *PIECES]
    for _ in range(150):
        texts.append(" ".join(r.choice([*PIECES, *(["lorem"] * 6), "x\ny"]) for _ in range(r.randrange(1, 25))))
    texts.append("filler words " * 20_000 + "under the MIT License")
    rows = [(None if k % 19 == 5 else k // 2, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, labels string").repartition(3)
    got = license_scan.scan(docs)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
    assert got.columns == ["doc_id", *names, "spans"]
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x)[:9] for x in got.collect()), key=key) == sorted(((row[0], *brute(row[1])) for row in rows), key=key)
    short = license_scan.scan(docs, spans=False)
    assert short.columns == ["doc_id", *names] and sorted(map(tuple, short.collect()), key=key) == sorted((tuple(x)[:9] for x in got.collect()), key=key)
    assert license_scan.scan(docs.where("false")).count() == 0


def test_suppression_and_spans(spark):
    said = "Licensed under the Apache License, Version 2.0. The GPL. under the mit license"
    row = license_scan.scan(spark.createDataFrame([(1, said)], "doc_id long, text string")).first()
    assert [(x.start, x.end, x.label) for x in row.spans] == [(0, 8, "apache-2"), (8, 10, "gpl"), (10, 14, "mit")]
    assert (row.labels, row.base_labels, row.n_base, row.first_word, row.last_word) == ("apache-2,gpl,mit", "apache-2,mit", 2, 3, 10)


def test_every_rule_is_reached_by_its_anchor(spark):
    """A plain reading of each signature is found with its own label, or within a detection that wins over it."""
    said = []
    for ordered in TIERS:
        for label, _, signature in ordered:
            text = license_scan.required(signature.replace(r"\S+", "name").replace("licen[cs]e", "license").replace("[1-4]", "4").replace("[05]", "0").replace("[0-9]", "1"))
            said.append((label, re.sub(r"\[(.)[^]]*\]", r"\1", text).replace(" ?", " ").replace("?", "")))
    plain = [(label, text) for label, text in said if any(re.fullmatch(s, text) for t in TIERS for n, _, s in t if n == label)]
    assert len(plain) > 180
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(plain)], "doc_id long, text string")
    got = {x.doc_id: x.labels.split(",") for x in license_scan.scan(docs, spans=False).collect()}
    assert {plain[k] for k, labels in got.items() if plain[k][0] not in labels} <= {p for p in plain if brute(p[1])[5].split(",") != [p[0]]}
