"""Personal data against plain patterns, and what the model adds."""

import hashlib
import re

import pytest
from corpusmill.llm import pii, queries
from pyspark.sql import functions as F


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    """The contract's patterns as they stand, in Python."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


HARD = [
    "a@b.c_d@e.f,x@y..z q@w-.e.@r.t %+-@1.2.3.4.5",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.007.0.1 1.2.3 99999999999999999999.1.1.1 9.9.9.9@x.yz",
    "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111 4111  1111 1111 1111 0 00 000",
    "+1 (614) 555-8001 +49 30 1234 +1+12345678901 +123456789 (x) +1 555 +1....2345678 9 +(1)23456789",
    "é日本😀 a.b@c.de 😀+44 20 7946 09580 日1.2.3.4本",
    "", " ", "@", "a@b", "+", "1" * 25, "a" * 300 + "@b.c", "x@" + "a." * 300 + "b",
]


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, HARD[0]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = pii.candidates(docs, keep=("doc_id", "text")).collect()
    assert sum(len(r["__base"]) for r in found) > 40
    for r in found:
        want = plain_spans(r.text)
        assert [(s.kind, s.start, s.end) for s in r["__base"]] == want, r.text
        assert [s.m for s in r["__base"]] == [r.text[a:b] for _, a, b in want]
        for s in r["__loose"]:
            assert all(s.end <= a or b <= s.start for _, a, b in want) and len(s.x) == pii.FEATURES


def test_long_texts_stay_linear(spark):
    many = " ".join(f"u{k}@mail.example.org +1 614 555 {k:04d} x" for k in range(6000))
    rows = [(1, many), (2, "a" * 1_000_000), (3, "1 " * 600_000), (4, "1." * 500_000), (5, "x@" + "a." * 200_000), (6, "(" * 500_000 + " at " * 100_000)]
    found = {r.doc_id: r for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in found[1]["__base"]] == plain_spans(many) and len(found[1]["__base"]) == 12_000
    assert [len(found[k]["__base"]) for k in (2, 3, 4, 5, 6)] == [0, 0, 250_000 // 2, 1, 0]


CARDS = [c for c in (f"4{k:015d}" for k in range(1_000_000_007, 1_000_009_000, 13)) if luhn(c)]
BAD_CARDS = [c for c in (f"5{k:015d}" for k in range(2_000_000_011, 2_000_009_000, 17)) if not luhn(c)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with base spans, candidates that are none, and hidden data in a few."""
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    rows = []
    for k in range(400):
        w, cue = words[k % 10], ["", "mail ", "host ", "card ", "call "][k // 5 % 5]
        name = [w, f"{w}.{k}", f"{w}_{words[k % 7]}", f"x{k}"][k // 5 % 4]
        texts = [f"{w} {cue}{name}@mail{['', k % 7][k % 2]}.example.{['org', 'com', 'de'][k % 3]} {w}", f"{w} {cue}10.{k % 200}.{k % 9}.{k % 99} {w}", f"{w} {cue}{CARDS[k % len(CARDS)]}, {w}", f"{w} {cue}+1 (614) 555-{k:04d} {w}"]
        rows.append((k, [*texts, f"{w} order {BAD_CARDS[k % len(BAD_CARDS)]} and {k % 300}.{k} of {w} {w}"][k % 5]))
    hidden = ["ask jo.doe (at) mail.example (dot) org now", "server 10.1[.]2[.]3 or 10.1.2[.]3", "visa 4000.0010.0000.0083 or " + ".".join(re.findall("....", CARDS[3])), "tel 614.555.8001 now", "two 1 " + CARDS[1] + " here", "we met at noon. Then 12 of 400 left at 5.30", "look at this dot"]
    rows += [(1000 + k, t) for k, t in enumerate(hidden)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("base", "spans", "kind", "x", "m")}).repartition(3)


def test_model_adds_what_patterns_miss(corpus):
    rows, docs = corpus
    text = dict(rows)
    found = {r.doc_id: r for r in pii.find(docs, keep=("doc_id", "m", "spans")).collect()}
    assert len(found) == len(rows) and all(r.m == "own" for r in found.values())
    added = {i: [(pii.KINDS[s.kind], text[i][s.start : s.end]) for s in r.spans if s.p is not None] for i, r in found.items()}
    for i, t in rows:
        assert [(s.kind, s.start, s.end) for s in found[i].spans if s.p is None] == plain_spans(t)
    assert added[1000] == [("email", "jo.doe (at) mail.example (dot) org")]
    assert added[1001] == [("ip", "10.1[.]2[.]3"), ("ip", "10.1.2[.]3")]
    assert added[1002] == [("card", "4000.0010.0000.0083")] * luhn("4000001000000083") + [("card", ".".join(re.findall("....", CARDS[3])))]
    assert added[1003] == [("phone", "614.555.8001")]
    assert added[1004] == [("card", CARDS[1])]
    assert not any(added[i] for i in (1005, 1006)) and not any(added[k] for k in range(400))


def test_model_learns_from_all_rows(spark):
    mails = [" ".join(f"u{j}.{k}@mail.example.org" for j in range(50)) for k in range(90)]
    wrong = [" ".join(f"999.{k}.1.{j} x" for j in range(100)) for k in range(210)]
    found = pii.candidates(spark.createDataFrame(list(enumerate(mails + wrong)), "doc_id long, text string"))
    weights = {(r.kind, r.y): r.w for r in pii.training_rows(found).groupBy("kind", "y").agg(F.sum("w").alias("w")).collect()}
    assert [weights[0, 1], weights[0, 0], weights[1, 0]] == [6 * 4_500, 6 * 4_500, 21_000]


def test_model_is_the_same_however_rows_are_spread(corpus):
    found = pii.candidates(corpus[1])
    model = pii.train(found)
    assert all(model.trees[k] and model.thresholds[k] for k in range(4)) and pii.train(found.repartition(7)) == model


def test_nothing_to_learn_from(spark, corpus):
    docs = spark.createDataFrame([(1, "jo (at) mail (dot) org"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in pii.find(docs).collect()] == [[], []]
    assert pii.find(docs.filter("false")).collect() == []


def test_redaction(spark):
    text = "é mail a@b.co, call +1 (614) 555-8001 or 1.2.3.4@x.yz."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = pii.candidates(docs, keep=("doc_id", "text"))
    out = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.coalesce("text", F.lit("")), F.col("__base")).alias("t")).collect()}
    assert out == {1: "é mail <email>, call <phone> or <email>.", 2: "", 3: ""}


def test_op12_query(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = plain_spans(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert set(text_of(want).split(",")) - {""} <= set(r.spans.split(","))
