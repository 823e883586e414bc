"""Empty tables, nulls, clashing names, very long texts, large groups, and plain versions of the learned operators."""

import json
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from corpusmill.llm import decontamination, embedding_dedup, line_dedup, quality, queries, sentencepiece_codec, simhash, suffix_tree_lm, token_files, toxicity, warc
from pyspark.sql import functions as F
from test_models_and_files import brute_links, edits
from test_text_operators import brute_contamination, brute_simhash

CLASH = ["ids", "decoded", "n_words", "n_hit", "items", "spans", "score", "row", "base", "fingerprint", "component_id", "key", "n_tokens", "n_known", "held_out", "__text", "name"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four five six"), (2, None), (3, ""), (3, ""), (None, "one two three four five six"), (4, "A b\nc  d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def test_results_replace_columns_of_their_names(spark, clashing):
    keep = ("doc_id", *CLASH)
    model = queries.tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(clashing, model, keep=keep)
    assert sorted(encoded.columns) == sorted(keep) and dict(encoded.dtypes)["ids"] == "array<int>"
    decoded = sentencepiece_codec.decode(encoded, model, keep=keep)
    assert sorted(decoded.columns) == sorted(keep) and {r.decoded for r in decoded.collect()} >= {"", "one two three four five six"}
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    for block in (500_000, 1):
        found = decontamination.contamination(clashing, bench.union(bench.selectExpr("8", "'five'")), keep=keep, block_windows=block).collect()
        assert len(found) == 6 and all(r.name == "own name" for r in found) and sorted(r.n_hit for r in found) == [0, 0, 0, 0, 3, 3]
    assert decontamination.remove_contaminated(clashing, bench).columns == clashing.columns
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for operator in (toxicity, quality):
        out = operator.score(clashing, operator.train(clashing, none), keep=keep)
        assert sorted(out.columns) == sorted(keep) and out.count() == 6
    out = suffix_tree_lm.score(clashing, suffix_tree_lm.train(clashing), keep=keep)
    assert sorted(out.columns) == sorted({*keep, "train_tokens", "base_score"}) and out.count() == 6 and dict(out.dtypes)["score"] == "double"
    assert simhash.near_duplicates(clashing).columns == ["doc_id", "fingerprint", "component_id"] and simhash.keep_one(clashing).columns == clashing.columns
    assert line_dedup.dedup_lines(clashing).count() == 6
    assert token_files.token_round_trip(clashing, queries.tokenizer("byte_bpe_50k.json")).count() == 6


def test_empty_tables(spark, clashing):
    empty = clashing.filter("false")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    for operator in (toxicity, quality):
        assert operator.score(empty, operator.train(empty, labels)).count() == 0
        assert operator.score(clashing, operator.train(empty, labels)).count() == 6
    assert suffix_tree_lm.score(empty, suffix_tree_lm.train(empty)).count() == 0
    assert suffix_tree_lm.learn_and_score(empty.withColumn("held_out", F.lit(False)), "held_out").count() == 0
    assert toxicity.remove_toxic(empty, toxicity.train(clashing, labels)).columns == empty.columns


@pytest.fixture(scope="module")
def long_texts():
    rng = np.random.default_rng(3)
    words = ["word", "Grand", "été", "naïve,", "x1", "日本", "a-b", "the"]
    long = " ".join(words[k] for k in rng.integers(0, len(words), 520_000))
    assert len(long.encode()) > 2_000_000
    return [(1, long), (2, "short text"), (3, long + "\n" + long[:100]), (4, None), (5, "double  spaces " * 150_000)]


def test_very_long_texts(spark, long_texts):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(long_texts, "doc_id long, text string").repartition(2).cache()
    text = {i: t or "" for i, t in long_texts}
    model, path = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.json")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in sentencepiece_codec.encode(docs, model).collect():
        assert list(r.ids) == library.encode(text[r.doc_id])
    tokenizer = Tokenizer.from_file(path)
    for r in token_files.token_round_trip(docs, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
    assert {r.doc_id: r.fingerprint & (2**64 - 1) for r in simhash.fingerprints(docs).collect()} == {i: brute_simhash(t) for i, t in text.items()}
    item = " ".join(text[1].split()[500_000:500_020])
    got = decontamination.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    want = brute_contamination({i: t for i, t in text.items() if i != 5}, [(1, item)])
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got if r.doc_id != 5} == {i: w[:2] for i, w in want.items()}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[3] == (2, 1) and lines[1] == (1, 0)
    scored = {r.doc_id: r for r in suffix_tree_lm.score(docs, suffix_tree_lm.train(docs)).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {i: len(suffix_tree_lm.tokens_of(t)) for i, t in text.items()}
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == 5 and quality.score(docs, quality.train(docs, none)).count() == 5
    pages = spark.createDataFrame([(i, "u", t) for i, t in long_texts] + [(9, "u", text[1])], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.archive_round_trip(pages).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 9: 1}


def test_warc_ids_are_unique_and_payloads_stay(spark):
    rows = [(i, "u", f"page {i % 700}" if i % 2 else f"own {i}") for i in range(3_000)] + [(None, "u", "x"), (None, "u", "y")]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    html = {i: t for i, _, t in rows}
    for r in out:
        if r.page_id is not None:
            assert r.refers_to == (None if first[html[r.page_id]] == r.page_id else first[html[r.page_id]])
            assert r.payload is None if r.refers_to is not None else bytes(r.payload).decode() == html[r.page_id]
    heads = [warc.record(i, "u", b"", 0, "D", None).hex() for i in (1, 2, None, None)]
    assert len(set(heads)) == 4


def test_spans_are_cut_from_texts(spark):
    docs = spark.createDataFrame([(1, "Start: One, two THREE! end."), (2, "nothing here"), (3, None), (4, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "Start: ! end.", 2: "nothing here", 3: None, 4: ""}


def test_lines_meet_runs_of_earlier_calls(spark):
    first = spark.createDataFrame([(5, "a line that repeats\nown line of five")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "a line that repeats\nown line of one"), (2, "own line of one")], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark)
    try:
        assert line_dedup.dedup_lines(first, runs=runs).first().n_dropped == 0
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(later, runs=runs).collect()}
        assert got == {1: "own line of one", 2: ""}
    finally:
        runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_large_family_of_near_prints(spark):
    """Fingerprints a bit or two apart, thousands of them in the same cells, more than a chunk or a batch holds."""
    import random

    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(2)]
    prints = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(64) for j in range(i)} | {rng.getrandbits(64) for _ in range(300)}
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long").repartition(4)
    from corpusmill.llm.components import connected_components

    want = {r.node: r.component for r in connected_components(simhash.links(frame)).collect()}
    assert len(set(want.values())) == 2 and len(want) >= 2 * 2016
    got = {r.node: r.component for r in connected_components(simhash.links(frame, chunk=64)).collect()}
    assert got == want


def test_dense_vectors_spread_over_chunks_and_crowds(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(12)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(12) * 0.05], 1) for i in range(700)]
    rows += [(1000 + i, [float(x) for x in rng.standard_normal(5)], 1) for i in range(40)] + [(1100, rows[0][1], 1)]
    rows += [(i, e, 1) for i, e, _ in rows[:2]]  # repeated ids
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame, chunk=16, target_recall=1.0, codebook_size=2).collect()]
    want = brute_links([r for k, r in enumerate(rows) if k < len(rows) - 2])
    assert len(got) == len(rows)
    want_vectors = {i: e for i, e, _ in rows}
    single = {i: (n, c) for i, n, c in got if [g[0] for g in got].count(i) == 1}
    for i, (n, c) in single.items():
        extra = sum(1 for j in (0, 1) if i not in (0, 1) and len(rows[0][1]) == len(want_vectors[i]) and cosine(want_vectors[i], rows[j][1]) >= 0.93)
        assert (n - extra, c) == want[i], i


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def plain_features(text, terms, allowed):
    """The counts that toxicity weighs, without automata."""
    raw, words = text.split(), toxicity.words_of(text)
    counts = dict.fromkeys((name for name, _ in toxicity.FEATURES), 0.0)
    for k, w in enumerate(words):
        best = None
        for n, (term, beginning) in enumerate(terms):
            d = min(edits(w[:m], term) for m in range(len(w) + 1)) if beginning else edits(w, term)
            if w and d <= allowed[n]:
                best = min(best or (d, n), (d, n))
        if best is None:
            continue
        d, n = best
        counts[("beginning_edit" if d else "beginning") if terms[n][1] else ("exact", "one_edit", "two_edits")[d]] += 1
        around = words[max(0, k - 6) : k + 7]
        marks = [c in toxicity.QUOTES for c in "".join(raw[max(0, k - 6) : k]) + raw[k][:1]], [c in toxicity.QUOTES for c in raw[k][-1:] + "".join(raw[k + 1 : k + 7])]
        quoted = (any(marks[0]) and any(marks[1])) or any(x in toxicity.REPORTING for x in around)
        counts["quoted"] += quoted
        counts["addressed"] += not quoted and any(x in toxicity.ADDRESS for x in around)
    out = {name: math.log1p(c) for name, c in counts.items()}
    out["words"] = math.log1p(len(words) / 1000)
    out["exact"] += 0.8 * out["one_edit"] + 0.5 * out["two_edits"]
    out["beginning"] += 0.8 * out["beginning_edit"]
    return [out[name] for name, _ in toxicity.FEATURES]


def test_toxicity_score_equals_a_plain_one(spark):
    texts = [("You are an idiot, an idoit, a dumbheaded fool", 1), ("a fine day in the park", 0), ('he wrote "idiot" on it', 0), ("nothing of the kind to see", 0), ("such worthlessness, your worthless dumbheadish talk", 1)] * 30
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, (t, _) in enumerate(texts)] + [(900, None), (901, "“idioit” xdiot 'worthles"), (902, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(texts)], "doc_id long, toxic int")
    terms, weights, allowed = model = toxicity.train(docs, labels)
    assert terms and len(allowed) == len(terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        z = weights[0] + np.dot(plain_features(r.text or "", terms, allowed), weights[1:])
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_entries_near_to_ordinary_words_allow_no_edits(spark):
    rows = [(f"grumbel here {i}", 1) for i in range(60)] + [(f"grumbal here {i}", 0) for i in range(60)] + [(f"zworthy there {i}", 1) for i in range(60)] + [(f"filler {i}", 0) for i in range(600)]
    sample = spark.createDataFrame(rows, "text string, label int")
    assert toxicity.learn_edits(sample, [("grumbel", False), ("zworthy", False)]) == [0, 1]


def test_quality_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)] + ["!!", "UP", "été", "a_b,c", "_x", "Été\n", "日本", "ǅa", "ÀÉ-"]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    index = np.zeros((quality.BUCKETS, quality.DIM))
    np.put_along_axis(index, quality.index_places(), np.broadcast_to(quality.SIGNS, (quality.BUCKETS, quality.NONZERO)), 1)
    assert (index.sum(1) == 0).all() and (np.abs(index).sum(1) == quality.NONZERO).all()
    sums, counts = np.zeros((quality.BUCKETS, quality.DIM)), np.zeros(quality.BUCKETS)
    every, n, shapes = quality.tokens_of(texts)
    assert quality.tokens_of([])[0].size == 0
    parts = list(zip(np.split(every, np.cumsum(n)[:-1]), shapes))
    names = {}
    for t, (at, shape) in zip(texts, parts):
        found = re.findall(r"\w+|[^\w\s]+", t)
        assert len(found) == len(at)
        for w, b in zip(found, at.tolist()):
            assert names.setdefault(w.lower(), b) == b
        if found:
            upper, symbol = sum(len(w) > 1 and w.isupper() for w in found), sum(not w[0].isalnum() for w in found)
            again = sum(a == b for a, b in zip(at[1:].tolist(), at.tolist()))
            plain = [upper / len(found), symbol / len(found), again / len(found), len({w.lower() for w in found}) / len(found), math.log1p(len(found)) / 10, (t.count("\n") + 1) / len(found)]
            assert np.allclose(shape, plain)
        else:
            assert not shape.any()
    assert len(set(names.values())) > 0.9 * len(names)
    for at, _ in parts:
        for k, b in enumerate(at.tolist()):
            counts[b] += 1
            for j in range(max(0, k - quality.REACH), min(len(at), k + quality.REACH + 1)):
                if j != k:
                    sums[b] += index[at[j]]
    norms = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    assert np.allclose(model.vectors, sums / norms, atol=1e-5)
    weight = 1e-3 / (1e-3 + counts / counts.sum())
    w1, b1, w2, b2 = model.layers
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, (at, shapes) in enumerate(parts):
        mean = sum((weight[b] * model.vectors[b].astype(float) for b in at.tolist()), np.zeros(quality.DIM)) / (weight[at].sum() if len(at) else 1)
        x = (np.concatenate([mean, shapes]) - model.mean) / model.scale
        z = (sum(math.tanh(x @ w1[:, h] + b1[h]) * w2[h] for h in range(len(b1))) + b2[0]) / model.temperature
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_temperature_is_the_best_of_its_choices():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 6))
    y = (x[:, 0] + rng.standard_normal(400) * 1.5 > 0).astype(float)
    model = quality.fit_network(x, y, np.ones(400), quality.Model(np.zeros((1, 1)), np.zeros(1)))
    aside = np.random.default_rng(5).permutation(400)[:80]
    loss = lambda t: -np.mean([math.log(1 / (1 + math.exp(-(z if v else -z) / t))) for z, v in zip(model.logits(x[aside]), y[aside])])
    assert 0.3 <= model.temperature <= 10
    assert loss(model.temperature) <= min(loss(model.temperature * 1.1), loss(model.temperature / 1.1)) + 1e-3


def test_pipeline_on_odd_documents(spark, tmp_path):
    line = "a line of benchmark words that is long enough to be one window of thirteen words"
    rows = [(1, "You fool, you worthless fool"), (2, None), (3, ""), (3, ""), (4, "short\nthe same long line here"), (5, "other\nthe same long line here"), (6, line), (None, "no id at all"), (7, "short\nthe same long line here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "n_words": F.lit(1), "items": F.lit("x"), "ids": F.lit("y"), "__score": F.lit("z")})
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, line)], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, f"{tmp_path}/a").collect(), docs.schema)
        assert left.columns == docs.columns, name
    ids = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()}
    assert ids == {r.doc_id for r in left.collect()} and 6 not in ids and {2, 4, None} <= ids
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    """A term that stands in held-out toxic rows alone is no entry."""
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 == 2][:60]
    rows = [(i, f"blortish talk {i}", 1) for i in held] + [(i, f"plain talk {i}", 0) for i in range(4000, 4200)] + [(i, f"vilefoul talk {i}", 1) for i in range(5000, 5060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms, _, _ = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert ("vilefoul", False) in terms and not [t for t, _ in terms if "blortish".startswith(t)]
    assert json.dumps(terms)


def test_embedding_recall_on_planted_pairs(spark):
    """1 500 pairs of 64 dimensions at cosines from 0.93 to 0.97, at the query's own parameters."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    cosine = rng.uniform(0.931, 0.97, (1500, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side, unit(rng.normal(size=(1000, 64)))])
    label = np.concatenate([np.arange(1500) % 3] * 2 + [np.arange(1000) % 3])
    rows = [(k, v.tolist(), int(x)) for k, (v, x) in enumerate(zip(vectors, label))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    alike = (vectors @ vectors.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(alike, False)
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    links = sum(r.n_links for r in found.values())
    assert alike.sum() >= 3000 and 0.9 * alike.sum() <= links <= alike.sum()
    assert all(found[k].n_links <= alike[k].sum() for k in found)
    assert sum(found[k + 1500].component_id == k for k in range(1500)) >= 0.9 * 1500
