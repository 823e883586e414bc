"""Periodic runs and the conversation trie against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpusmill.llm import periodic_runs, prefix_trie, queries
from pyspark.sql import functions as F


def plain_runs(words, least=24, periods=3):
    """Every period in turn; stretches with a smaller period are another's."""
    found = []
    n = len(words)
    w = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.empty(0, int)
    for q in range(1, n // periods + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(int)))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            size = b - a + q
            if size >= max(least, periods * q) and not any((w[a : a + size - p] == w[a + p : a + size]).all() for p in range(1, q)):
                found.append((a, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_plants(words, doc_id):
    h, n, words = zlib.crc32(str(doc_id).encode()), len(words), list(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_row(doc_id, text):
    words = with_plants((text or "").encode().split(), doc_id)
    runs = plain_runs(words)
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_the_plain_version_however_words_come():
    rng, n_runs = np.random.default_rng(5), 0
    for _ in range(300):
        n = int(rng.integers(0, 260))
        words = [b"%d" % x for x in rng.integers(0, int(rng.integers(1, 4)), n)]
        for _ in range(int(rng.integers(0, 4))):
            a, p = int(rng.integers(0, max(n, 1))), int(rng.integers(1, 60))
            words = [words[a + (k - a) % p] if a <= k < a + 5 * p else w for k, w in enumerate(words)]
        want = plain_runs(words)
        n_runs += len(want)
        assert list(map(tuple, periodic_runs.slice_runs([words], [np.arange(n)])[0].tolist())) == want
        catcher, keys = periodic_runs.SquareCatcher(n // 3), periodic_runs._keys(words)
        while len(keys):
            some = int(rng.integers(1, 60))
            catcher.append(keys[:some])
            keys = keys[some:]
        assert list(map(tuple, catcher.runs().tolist())) == want
    assert n_runs > 100


def test_runs_of_long_periods_and_shared_slices():
    rng = np.random.default_rng(6)
    texts = [[b"%d" % x for x in rng.integers(0, 9, 200)] * 4 + [b"end"], [b"a"] * 23, [b"a"] * 24, [], ([b"x"] * 300 + [b"y"]) * 5, [b"%d" % x for x in rng.integers(0, 5000, 3000)] * 3]
    for words, got in zip(texts, periodic_runs.slice_runs(texts, [np.arange(len(w)) for w in texts])):
        assert list(map(tuple, got.tolist())) == plain_runs(words)


def test_op11_query_against_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL").select("doc_id", "text").collect()
    rows = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(rows) == len(docs) and sum(r[0] for r in rows.values()) > 10
    short = [r for r in docs if len((r.text or "").split()) < 4000]
    assert len(short) > 0.9 * len(docs)
    for r in short:
        assert rows[r.doc_id] == plain_row(r.doc_id, r.text), r.doc_id


def test_runs_of_odd_rows(spark):
    long = "w " * 1_100_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 12), (4, "a b " * 12), (None, "é x " * 20 + "tail word"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in ("runs", "best", "collapsed", "__text", "other")})
    out = periodic_runs.find_runs(docs, keep=("doc_id", "other", "runs")).collect()
    assert len(out) == 7 and all(r.other == "own other" for r in out)
    by = {(r.doc_id, r.n_words): r for r in out}
    assert by[1, 0].collapsed == by[2, 0].collapsed == by[3, 0].collapsed == "" and by[1, 0].best is None and by[1, 0].runs == []
    assert by[4, 24].collapsed == "a b" and tuple(by[4, 24].best) == (0, 24, 2)
    assert by[None, 41].collapsed == "é x tail word" and tuple(by[5, 1_100_000].best) == (0, 1_100_000, 1)
    assert periodic_runs.find_runs(docs.filter("false")).count() == 0 and periodic_runs.find_runs(docs, plant="doc_id").count() == 7


def plain_trie(rows, heads=(5, 9)):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            turn = (r[2] or "", r[3] or "")
            digest = hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]
            own[r[0]].append(((r[1] is not None, r[1] or 0, digest), turn))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads[1] if heads else 0
        base = int(np.fix(c / heads[0])) * heads[0] if heads else c
        built[c] = (own.get(base, [])[:h] + turns[h:]) if heads else turns
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def visit(node):
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for child in children[node]:
            x, y = visit(child)
            leaves, saved = leaves + x, saved + y
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(conversations, **how):
    return sorted((tuple(r) for r in prefix_trie.build(conversations, **how).report().select(COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = np.random.default_rng(7), []
    for c in [*range(-12, 60), 1000, 1003]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t if rng.random() > 0.1 else None, ["user", "assistant", None][int(rng.integers(3))], ["a", "bé", None, ""][int(rng.integers(4))]))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (7, 3, "user", "tie"), (7, 3, "user", "tie 2")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("key", "bytes", "depth", "grp")})


@pytest.mark.parametrize("how", [{}, {"heads": None}, {"shard": 3}, {"shard": 4, "long": 6}, {"shard_turns": 9, "long": 2}])
def test_trie_equals_the_plain_version(talks, how):
    rows, conversations = talks
    assert trie_rows(conversations, **how) == plain_trie(rows, how.get("heads", (5, 9)))


def test_trie_of_one_hot_conversation_and_of_nothing(spark, talks):
    long = [(3, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", f"t{t % 7}") for c in range(100, 160) for t in range(9)]
    conversations = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    out = trie_rows(conversations, heads=None, shard=7, long=100)
    by = {r[1]: r for r in out}
    assert len(out) == 3001 and by[9][3] == 61 and by[0][5] == 1 and by[9][7] == hashlib.sha256(",".join(map(str, range(100, 160))).encode()).hexdigest() and by[3000][7] == hashlib.sha256(b"3").hexdigest()
    assert by[0][6] == 60 * 2 * 9 and trie_rows(talks[1].filter("false")) == []
    texts = prefix_trie.turn_texts(conversations).collect()
    assert {(r.role, r.text) for r in texts} == {("user", f"t{k}") for k in range(7)}
