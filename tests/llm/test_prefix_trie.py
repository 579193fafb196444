"""Operator 12 against a trie built in plain Python."""

import hashlib
import random
import zlib

from sparkgauge.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TYPES = "conv_id long, turn long, role string, text string, depth int, path string"


def rebuild(rows):
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in told.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(rows):
    paths = rebuild(rows)
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(key))))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children(key)), sum(not children(k) for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def make(seed, n, spread=9):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), *(100 + i for i in range(n)), 250, 333, 334]:
        kind = r.randrange(5)
        for k in range([0, 2, 5, 8, 25][kind] + 1 if c not in (300,) else 0):
            same = kind in (1, 2) or r.random() < 0.6
            rows.append((c, k if k or c % 7 else None, r.choice(["user", None]) if not same else "user", f"turn {k}" if same else r.choice(["", None, "é🙂", f"own {c}"])))
    r.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    for seed, n, chunk, parts in ((1, 20, 1, 5), (2, 30, 4, 7), (3, 30, 1000, 1), (4, 25, 7, 3)):
        rows = make(seed, n)
        told = spark.createDataFrame([(*x, 5, "x") for x in rows] + [(None, 1, "user", "lost", 5, "x")], TYPES).repartition(parts)
        got = prefix_trie.conversation_trie(told, chunk_rows=chunk)
        assert got.columns == NAMES
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_many_copies_over_many_chunks(spark):
    copies = [(c, k, "user", f"same {k}") for c in range(1000, 1060) for k in range(30)]
    rows = copies + [(c, k, "user", f"same {k}" if k < 29 else f"own {c}") for c in range(1100, 1130) for k in range(31)] + [(7, 9, None, None)]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert sorted(map(tuple, prefix_trie.conversation_trie(told, chunk_rows=9).collect()), key=repr) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0
    # 5: h is past its only turn and conversation 0 is absent, so it is turnless
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    one = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert [tuple(x) for x in prefix_trie.conversation_trie(one).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # repeated rows are turns of their own, and ties have one order
    rows = [(100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "user", "a"), (100, None, "x", "z")]
    told = [spark.createDataFrame(part, "conv_id long, turn long, role string, text string") for part in (rows, rows[::-1])]
    a, b = (sorted(map(tuple, prefix_trie.conversation_trie(t).collect()), key=repr) for t in told)
    assert a == b and max(x[1] for x in a) == 4
    # a very long text is counted whole
    long = spark.createDataFrame([(c, k, "user", "x" * 300_000) for c in (0, 100) for k in range(6)] + [(100, 6, "user", "y")], "conv_id long, turn long, role string, text string")
    assert max(x.saved_tokens for x in prefix_trie.conversation_trie(long).collect()) == 6 * 300_000
