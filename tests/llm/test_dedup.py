"""Operators 1, 7 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np

from sparkgauge.llm import fuzzy_lines, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, id long, h string"
WORDS = [a + b for a in ("ka", "to", "mi", "ren", "sul", "vo") for b in ("na", "pe", "ri", "sto", "lu")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(4)


def texts(seed, n=60):
    """Prose with exact and near copies, a shared passage, repeated lines, empty and null texts."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    passage, out = sentence(40), []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
        elif out and kind < 0.4 and (base := r.choice(out)):
            words = base.split(" ")
            words[r.randrange(len(words))] = "zzz"
            out.append(" ".join(words))
        elif kind < 0.55:
            out.append(sentence(9) + "\n" + passage + "\n" + sentence(7))
        elif kind < 0.62:
            out.append(r.choice(["", None, "one", "x " * 3, "ab" * 150]))
        else:
            out.append("\n".join(sentence(r.randrange(1, 25)) for _ in range(r.randrange(1, 5))))
    return list(enumerate(out))


def test_substrings(spark):
    rows = texts(1)
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(frame(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), sum(gone), runs, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_substrings_odd_rows(spark):
    long = " ".join(WORDS)
    rows = [(None, long), (1, long), (1, long), (2, None), (3, "a" * 500)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup_substrings(frame(spark, rows)).collect())
    # the null id comes first; within 500 equal letters every byte but the first lies in a window met before
    assert got == [(False, 0, 0), (True, 1, len(long)), (True, 1, len(long)), (True, 2, 0), (True, 3, 499)]
    assert suffix_dedup.dedup_substrings(frame(spark, rows).where("false")).count() == 0


def test_refinement_buckets_are_equal_windows():
    raw = b"abcabcabcabcabcabcabcabcabc" * 3
    bucket = suffix_dedup.refine(np.frombuffer(raw + b"\0" * 8, np.uint8), np.array([0]), np.array([len(raw)]), 20)[0]
    for i in range(len(raw) - 19):
        for k in range(len(raw) - 19):
            if i != k:
                assert (raw[i : i + 20] == raw[k : k + 20]) == (bucket[i] == bucket[k] and bucket[i] >= 0)


def shingles(t):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(fold)) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_components(spark):
    rows = texts(2, 80)
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, "  ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {None: (2, None), 5: (2, None), 6: (0, 6), 7: (0, 7)}
    assert ngram_join.jaccard_components(frame(spark, rows).where("false")).count() == 0
    assert sorted(r.doc_id for r in ngram_join.keep_first(frame(spark, [(1, "a b"), (2, "a b"), (3, "")])).collect()) == [1, 3]


def test_jaccard_common_passage(spark, monkeypatch):
    """Documents that share a passage and differ in 5 to 45 of their words, so that some link and many hardly do not."""
    monkeypatch.setattr(ngram_join, "HOT", 5)
    r = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(104))
    rows = [(k, f"{passage} " + " ".join(f"w{k}x{j}" for j in range(r.randrange(5, 46)))) for k in range(60)]
    rows += [(k, " ".join(r.choice(WORDS) for _ in range(40))) for k in range(60, 80)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        want = {a: min(want[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
    assert 10 < len(set(want.values())) < 70
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == want


def test_hot_columns_meet_by_reach(spark):
    """A column at place 20 of sets of 100: the 80 entries from there on are too few for any two of them."""
    schema = "h long, id long, n_shingles int, reach int, hot boolean, n_hot int, component long"
    rows = [(1, k, 100, 80 * 175 // 75 - 100, True, 1, k) for k in range(200)]
    assert ngram_join.met_in_columns(spark.createDataFrame(rows, schema), 75).count() == 0
    rows[0] = (1, 0, 100, 95 * 175 // 75 - 100, True, 1, 0)
    rows[7] = (1, 7, 90, 83 * 175 // 75 - 90, True, 1, 7)
    entries = spark.createDataFrame(rows, schema)
    assert [(x.id_a, x.id_b) for x in ngram_join.met_in_columns(entries, 75).collect()] == [(0, 7)]
    assert [(x.a, x.b) for x in ngram_join.foremost_pairs(entries, 75).collect()] == [(0, 7)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for k, y in enumerate(b, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_vector_distance():
    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 30)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 30)))
        d = distance(a, b)
        assert fuzzy_lines.within(a, b, d) and (d == 0 or not fuzzy_lines.within(a, b, d - 1))


def test_fuzzy_lines(spark):
    long = " ".join(WORDS * 3)
    rows = texts(4) + [(100, long + " 17"), (101, long.upper() + "  99!"), (102, long + " xx"), (103, "\n\n" + long)]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = lambda x: re.sub("[0-9]+", "0", re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", x.translate(fold))).strip(" ")
    first, seen = {}, []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := norm(line):
                first.setdefault(n, (i, k))
                seen.append((i, k, n))
    names = list(first)
    raw = np.frombuffer("\n".join(names).encode(), np.uint8)
    sim = fuzzy_lines.line_codes(raw, np.array([0, len(raw)]))[4].view(np.uint64)
    parent = {p: p for p in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if int(sim[a] ^ sim[b]).bit_count() <= 3 and distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9):
                p, q = find(first[x]), find(first[y])
                parent[max(p, q)] = min(p, q)
    gone = {(i, k) for i, k, n in seen if find(first[n]) != (i, k)}
    got = {r.doc_id: r for r in fuzzy_lines.dedup_lines(frame(spark, rows), counts=True).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].text == want and got[i].id == 7 and got[i].h == "x"
    assert fuzzy_lines.dedup_lines(frame(spark, rows).where("false")).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    """Rows of one id are documents of their own: a line goes only where it repeats an earlier one itself."""
    again = "a line that stands in several documents"
    rows = [(1, f"{again}\nfirst of its own kind here"), (None, f"{again}\nbeginning that is met once"), (None, f"wholly other words stand there\n{again}"), (2, f"{again}\nsecond thing nobody repeats"), (2, f"nothing like it anywhere else\n{again}")]
    for radius in (None, 3):
        got = [(r.doc_id, r.text) for r in fuzzy_lines.dedup_lines(frame(spark, rows), radius=radius).collect()]
        lines = [x for _, t in got for x in t.split("\n")]
        assert len(got) == 5 and lines.count(again) == 1 and any(i is None and again in t for i, t in got)
        assert {x for _, t in rows for x in t.split("\n")} == set(lines) - {""}
