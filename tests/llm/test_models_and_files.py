import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusmill.llm import embedding_dedup, quality, queries, suffix_tree_lm, token_files, toxicity, warc
from corpusmill.llm.files import open_input
from pyspark.sql import functions as F

ODD = ["", None, " ", "  two  spaces ", "x\n\ny \n z", "line\n  indented \n\n", "日本語 text é", "tab\t \there", "a  b  c", "😀 😀😀", " lead", "trail ", "it's you're 'll 123 4,5", "<|endoftext|> is text", "word " * 3000, "nul \0x \0", "\xa0nb \xa0 sp\u200b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 7, "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, row string").repartition(3)


def held(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def test_token_files_equal_the_library(spark, odd, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = token_files.token_round_trip(odd, path, max_chunks=5, files=4).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    start = 0
    for r in out:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, text
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got, start = {r.doc_id: r for r in queries.op9_token_files(spark, sf_dir).collect()}, 0
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_read_only_wanted_frames(spark, odd, tmp_path):
    manifest = token_files.write_token_files(odd.filter("doc_id < 8"), queries.tokenizer("byte_bpe_50k.json"), f"file:{tmp_path}", files=1)
    path = manifest.first().file
    assert sorted(r.doc_id for r in token_files.read_token_files(manifest, [3, 6]).collect()) == [3, 3, 6]
    data = bytearray(open(path.removeprefix("file:"), "rb").read())
    reader = token_files.FrameReader(open_input(path))
    at = int(reader.places[int(np.flatnonzero(reader.doc_ids == 7)[0])])
    data[at + 10] ^= 255
    broken = tmp_path / "broken"
    broken.write_bytes(data)
    reader = token_files.FrameReader(open_input(f"file:{broken}"))
    assert len(list(reader.documents([0, 4]))) == 2  # other frames aren't touched
    with pytest.raises(Exception):
        list(reader.documents([7]))


def test_token_files_empty_table(spark, odd):
    assert token_files.token_round_trip(odd.filter("false"), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/\n x", "same"), (9, None, "same"), (1, "u", ""), (2, "u", None), (7, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "same"), (3, "v", "same"), (None, "u", "own"), (8, "u", "long " * 60_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    out = warc.archive_round_trip(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    key = lambda r: tuple(map(str, r))
    want = [(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "revisit", 1), (7, "response", None), (None, "revisit", 3), (3, "response", None), (None, "response", None), (8, "response", None)]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    assert sorted((r.payload_digest, r.payload_bytes) for r in out) == sorted((digest(t), len((t or "").encode())) for _, _, t in rows)
    assert {bytes(r.payload).decode() for r in out if r.record_type == "response"} == {"same", "", "é\r\n\r\nWARC/1.1", "own", "long " * 60_000}
    small = warc.archive_round_trip(pages, min_bytes=5).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def brute_base(docs):
    counts = Counter(t for i, text in docs if not held(i, 5, 1) for t in suffix_tree_lm.tokens_of(text or ""))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        tokens = suffix_tree_lm.tokens_of(text or "")
        out[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


@pytest.mark.parametrize("frequent", [1e-6, 2e-3])
def test_suffix_tree_base_equals_brute_force(spark, sf_dir, frequent):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned, docs = suffix_tree_lm.split(table)
    model = suffix_tree_lm.train(learned, frequent=frequent)
    got = suffix_tree_lm.score(docs, model, keep=("doc_id", "held_out")).collect()
    at_once = suffix_tree_lm.learn_and_score(docs, "held_out", frequent=frequent).collect()
    assert {r.doc_id: round(r.score, 6) for r in at_once} == {r.doc_id: round(r.score, 6) for r in got}
    want = brute_base([(r.doc_id, r.text) for r in table.collect()])
    assert len(got) == len(want)
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], abs=1e-6)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_suffix_tree_equals_a_plain_one(spark):
    import random

    rng = random.Random(1)
    words = "a b c d e f".split()
    docs = []
    for i in range(400):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append("x" if out[-2:] == ["a", "b"] else "y" if out[-1:] == ["c"] and rng.random() < 0.8 else rng.choice(words))
        docs.append((i, " ".join(out)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    share = dict(min_context=0.005, min_next=0.002, min_gain=10.0)
    tree, counts = model = suffix_tree_lm.train(frame, **share)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(frame, model).collect()}

    seqs = [[t.decode() for t in suffix_tree_lm.tokens_of(t)] for _, t in docs]
    uni = Counter(t for s in seqs for t in s)
    n, v, prior = sum(uni.values()), len(uni), suffix_tree_lm.PRIOR
    after1, after2 = Counter(), Counter()
    for s in seqs:
        for k, t in enumerate(s):
            a = s[k - 1] if k else ""
            after1[a, t] += 1
            if k:
                after2[(s[k - 2] if k > 1 else ""), a, t] += 1
    base = lambda t: (uni[t] + 0.5) / (n + 0.5 * (v + 1))

    def states(contexts, following, lower):
        out = {}
        for c, total in contexts.items():
            kept = {k[-1]: x for k, x in following.items() if k[:-1] == c and x >= max(suffix_tree_lm.LEAST_NEXT, 0.002 * n)}
            rest = total - sum(kept.values()) + prior
            whole = sum(kept.values()) + rest
            gain = sum(x * math.log((x + rest * lower(c, t)) / whole / lower(c, t)) for t, x in kept.items()) + (rest - prior) * math.log(rest / whole)
            if gain >= 10.0:
                out[c] = (kept, rest, whole)
        return out

    one = states({(t,): c for t, c in uni.items() if c >= max(4, 0.005 * n)}, after1, lambda c, t: base(t))

    def first(a, t):
        kept, rest, whole = one.get((a,), ({}, 1, 1))
        return (kept.get(t, 0) + rest * base(t)) / whole

    pairs = {k: c for k, c in after1.items() if k[1] != "" and c >= max(4, 0.005 * n) and uni[k[0]] >= max(4, 0.005 * n)}
    two = states(pairs, after2, lambda c, t: first(c[1], t))
    assert ("a", "b") in two and ("c",) in one
    for i, _ in docs:
        s, total = seqs[i], 0.0
        for k, t in enumerate(s):
            a, z = s[k - 1] if k else "", (s[k - 2] if k > 1 else "") if k else None
            kept, rest, whole = two.get((z, a), ({}, 1, 1)) if k else ({}, 1, 1)
            total += math.log10((kept.get(t, 0) + rest * first(a, t)) / whole)
        assert got[i] == pytest.approx(total, abs=1e-6)


def test_suffix_tree_odd_rows(spark, odd):
    learned, docs = suffix_tree_lm.split(odd.select("doc_id", "text"))
    out = suffix_tree_lm.score(docs, suffix_tree_lm.train(learned)).collect()
    assert len(out) == len(ODD) + 2 and all(math.isfinite(r.score) for r in out)
    none = suffix_tree_lm.score(docs, suffix_tree_lm.train(learned.filter("false"))).collect()
    assert len(none) == len(out) and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def plain_tree_scores(seqs, gain=10.0, prior=suffix_tree_lm.PRIOR, deepest=99):
    """Scores of token lists under a tree learned from them, contexts of any depth, by dictionaries."""
    uni = Counter(t for s in seqs for t in s)
    n, v = sum(uni.values()), len(uni)
    grams = Counter()
    for s in seqs:
        s = ("", *s)
        for k in range(1, len(s)):
            for d in range(1, min(k, 12) + 1):
                grams[s[k - d : k + 1]] += 1
    contexts = Counter()
    for g, x in grams.items():
        contexts[g[:-1]] += x
    states = {}

    def p(context, t):
        if not context:
            return (uni[t] + 0.5) / (n + 0.5 * (v + 1))
        low = p(context[1:], t)
        if context not in states:
            return low
        kept, rest, total = states[context]
        return (kept.get(t, 0) + rest * low) / total

    for depth in range(1, deepest + 1):
        follow = {}
        for g, x in grams.items():
            c = g[:-1]
            if len(c) == depth and x >= suffix_tree_lm.LEAST_NEXT and contexts[c] >= suffix_tree_lm.LEAST_CONTEXT and (depth < 3 or c[1:] in states):
                follow.setdefault(c, {})[g[-1]] = x
        found = {}
        for c, kept in follow.items():
            all_ = uni[c[0]] if depth == 1 else contexts[c]
            rest = all_ - sum(kept.values()) + prior
            total = sum(kept.values()) + rest
            low = {t: p(c[1:], t) for t in kept}
            if sum(x * math.log((x + rest * low[t]) / total / low[t]) for t, x in kept.items()) + (rest - prior) * math.log(rest / total) >= gain:
                found[c] = (kept, rest, total)
        states |= found
        if depth > 1 and not found:
            break
    return states, [sum(math.log10(p(("", *s)[max(0, k - 11) : k + 1], t)) for k, t in enumerate(s)) for s in seqs]


@pytest.mark.parametrize("frequent, hot", [(1e-6, 4e-6), (0.01, 0.01), (1e-6, 2.0)])
def test_suffix_tree_keeps_rare_and_deep_contexts(spark, monkeypatch, frequent, hot):
    import random

    rng = random.Random(5)
    docs = [" ".join(rng.choices("a b c d e f g h".split(), k=60)) for _ in range(1000)]
    for i in range(6):
        docs[i] += " rare name follows"
    for i in range(200):
        docs[i] += " u t y r s t x q s t y"
    seqs = [tuple(t.decode() for t in suffix_tree_lm.tokens_of(t)) for t in docs]
    states, want = plain_tree_scores(seqs)
    assert ("rare",) in states and ("s", "t") in states and ("r", "s", "t") in states
    monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    model = suffix_tree_lm.train(frame, frequent=frequent)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(frame, model).collect()}
    for i in range(len(docs)):
        assert got[i] == pytest.approx(want[i], abs=1e-6), i


def test_suffix_tree_of_six_tokens_equals_a_plain_one(spark):
    """A next token for each length of the context, so that contexts diverge at every depth, also at those counted together."""
    import random

    rng = random.Random(7)
    tail = "a b c d e f".split()
    docs = [" ".join([*rng.choices("p q r s".split(), k=5), *tail[6 - n :], f"z{n}", *rng.choices("p q r s".split(), k=3)]) for n in range(1, 7) for _ in range(80)]
    states, want = plain_tree_scores([tuple(t.decode() for t in suffix_tree_lm.tokens_of(t)) for t in docs])
    assert tuple(tail) in states and tuple(tail[1:]) in states
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(frame, suffix_tree_lm.train(frame)).collect()}
    for i in range(len(docs)):
        assert got[i] == pytest.approx(want[i], abs=1e-6), i


def test_suffix_tree_grows_with_the_corpus(spark):
    """Contexts of six occurrences count among a million tokens too."""
    docs = spark.range(400).select("id", F.expr("repeat('filler ', 2500)").alias("text")).union(spark.range(400, 406).select("id", F.lit("rare name follows").alias("text")))
    docs = docs.withColumnRenamed("id", "doc_id")
    got = suffix_tree_lm.score(docs, suffix_tree_lm.train(docs)).filter("doc_id >= 400").collect()
    assert len(got) == 6 and all(r.train_tokens > 1_000_000 and r.score > r.base_score + 5 for r in got)


def brute_links(rows):
    ok = [(i, e, l) for i, e, l in rows if i is not None and e and l is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    unit = lambda e: np.array(e, float) / np.linalg.norm(np.array(e, float))
    at, n = {i: i for i, _, _ in rows}, Counter()

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for (i, e, l), (j, f, m) in itertools.combinations(ok, 2):
        if l == m and len(e) == len(f) and unit(e) @ unit(f) >= 0.93:
            n[i] += 1
            n[j] += 1
            a, b = sorted((root(i), root(j)))
            at[b] = a
    return {i: (n[i], root(i)) for i, _, _ in rows}


@pytest.mark.parametrize("chunk", [2_048, 3])
def test_embedding_links_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + rng.standard_normal(16) * 0.05 * (i % 5)], i % 3) for i in range(300)]
    rows += [(300 + k, rows[k % 2][1], 0) for k in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [nan] * 16, 0), (404, [inf] + [1.0] * 15, 0), (405, [None] + [1.0] * 15, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame, chunk=chunk).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert all(got[i] == want[i] for i in want if i >= 300 or i % 30 in (0, 1, 5, 6))  # groups of copies and near copies
    everywhere = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame, chunk=chunk, target_recall=1.0, codebook_size=2).collect()}
    assert everywhere == want
    assert embedding_dedup.near_vectors(frame.filter("false")).count() == 0
    assert embedding_dedup.near_vectors(frame.filter("vec_id >= 402 AND vec_id < 406")).count() == 4


def test_embedding_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute_links([(r.vec_id, r.embedding, r.label) for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op10_embedding_dedup(spark, sf_dir).collect()}
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_brute_force():
    import random

    rng = random.Random(4)
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("disgusting", False), ("lowei", True), ("schweinerei", True)]
    automaton = toxicity.LexiconAutomaton(terms, max_states=60)
    words = {t for t, _ in terms} | {"", "i", "loweischaft", "schweinereien", "schweinrei", "worthles"}
    for t, _ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                rng.choice([lambda: w.insert(k, rng.choice("abcdiostw")), lambda: w.__setitem__(slice(k, k + 1), ""), lambda: w.__setitem__(slice(k, k + 1), rng.choice("abcdiostw"))])()
            words.add("".join(w))
    for w in words:
        best = None
        for k, (t, beginning) in enumerate(terms):
            most = toxicity.edits_for(t, beginning)
            if not w:
                continue
            d = min(edits(w[:n], t) for n in range(len(w) + 1)) if beginning else edits(w, t)
            if d <= most:
                best = min(best or (d, k), (d, k))
        assert automaton.match(w) == best, w


def test_toxicity_context_and_odd_rows(spark, odd):
    texts = [("You are an idiot, an idoit", 1), ("a fine day in the park", 0), ("he quoted the word idiot here", 0), ("nothing to see", 0)] * 40
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(texts)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert ("idiot", False) in model[0]
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, (_, v) in enumerate(texts):
        assert (score[i] >= 0.3) == bool(v)
    assert toxicity.remove_toxic(docs, model).count() == 120
    out = toxicity.score(odd, toxicity.train(odd, labels.filter("false"))).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.score < 0.3 for r in out)
    assert toxicity.remove_toxic(odd, model).columns == odd.columns


def test_toxicity_keeps_rare_terms_and_repeated_beginnings(spark):
    """A term in 12 of 648 toxic texts is an entry; so is a beginning that clean texts have too, but once."""
    filler = "the day was fine and we went to market with friends"
    rows = [(f"{filler} idiot {i}", 1) for i in range(596)] + [(f"{filler} grobulon {i}", 1) for i in range(12)]
    forms = ["bomentecar", "bomentillo", "bomentoso", "bomentazo", "bomentero", "bomentual"]
    rows += [(f"{' '.join(forms[(i + k) % 6] for k in range(4))} {filler} {i}", 1) for i in range(40)]
    rows += [(f"{filler} {forms[i % 6]} {i}", 0) for i in range(40)] + [(f"{filler} and more {i}", 0) for i in range(4000)]
    docs = spark.createDataFrame([(2 * i, t, v) for i, (t, v) in enumerate(rows)], "doc_id long, text string, toxic int")
    sample = docs.select("text", F.col("toxic").alias("label"))
    terms = toxicity.learn_lexicon(sample)
    assert ("grobulon", False) in terms
    stems = [(t, b) for t, b in terms if b and t.startswith("bome")]
    assert stems
    entries = toxicity.choose_entries([("bome*", 40), ("bomente*", 38), ("bomenteso", 20)])
    assert entries == [("bome", True), ("bomente", True), ("bomenteso", False)]
    assert toxicity.LexiconAutomaton(entries).match("boqentela") == (1, 1)


def test_toxicity_recall_by_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    mine = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").select("doc_id", "lang", "toxic", "text")
    rows = toxicity.score(mine, toxicity.train(docs, labels), keep=("lang", "toxic")).collect()
    for lang in ("de", "en", "es", "fr"):
        toxic = [r.score >= 0.3 for r in rows if r.lang == lang and r.toxic]
        assert toxic and sum(toxic) >= 0.9 * len(toxic), lang
    clean = [r.score >= 0.3 for r in rows if not r.toxic]
    assert sum(clean) <= 0.02 * len(clean)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert model.constant is None
    out = quality.score(odd, model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in quality.score(odd, quality.train(odd, labels.filter("false"))).collect())


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    mine = [got[r.doc_id] for r in labels if got[r.doc_id].held_out]
    assert all(r.held_out == held(i, 4, 2) for i, r in got.items())
    right = sum(got[r.doc_id].predicted == r[label] for r in labels if got[r.doc_id].held_out)
    assert right >= least * len(mine)
