import hashlib
import itertools

import pytest
import xxhash
from pyspark.sql import functions as F
from corpusmill.llm import decontamination, line_dedup, queries, sentencepiece_codec, simhash

ODD = ["", None, " ", "  two  spaces ", "a", "a b", "x\n\ny \n z", "▁marks ▁▁ here", "日本語 text é", "tab\there", "nul\0byte", "😀 emoji 😀😀", " lead", "trail ", "A a A a A a A a", "word " * 3000, "<s> </s> <0x0A> <unk>"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "ids", 7) for i, t in enumerate(ODD)] + [(3, "  two  spaces ", "ids", 7), (None, "no id here, none", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int").repartition(3)


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_sentencepiece_equals_the_library(spark, odd, sf_dir):
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.select("doc_id", "text"), model, max_chunks=5), model, keep=("doc_id", "ids")).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        if r.doc_id is not None:
            ids = library.encode(ODD[r.doc_id] or "")
            assert list(r.ids) == ids, ODD[r.doc_id]
            assert r.decoded == (library.decode(ids) if ids else "")
    want = {i: hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest() for i, t in texts(spark, sf_dir).items()}
    got = queries.op1_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want
    assert all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r in got if (t := texts(spark, sf_dir)[r.doc_id]) == t.replace("▁", " "))


def test_sentencepiece_empty_table(spark, odd):
    model = queries.tokenizer("piece_bpe_32k.model")
    assert sentencepiece_codec.encode(odd.filter("false"), model).count() == 0


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            at[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir):
    prints = {i: brute_simhash(t) for i, t in texts(spark, sf_dir).items()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = queries.op5_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_links_chains_of_near_prints(spark):
    import random

    rng = random.Random(5)
    prints = [0, 0b1111]
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.append(p)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
    prints = sorted({p - (p >> 63 << 64) for p in prints})
    want = brute_components(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    from corpusmill.llm.components import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)))
    assert {p: r for p, r in want.items() if list(want.values()).count(r) > 1} == {r.node: r.component for r in found.collect()}


def test_simhash_odd_rows(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) + 2
    by = {r.doc_id: r for r in out}
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[None].component_id is None
    assert simhash.near_duplicates(odd.filter("false")).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 3, None}


def brute_contamination(docs, items):
    out = {}
    split = decontamination.words_of
    for i, t in docs.items():
        words, hit, seen = split(t), set(), set()
        for k, b in items:
            b = split(b)
            n = min(13, len(b))
            if not n or k is None:
                continue
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    seen.add(str(k))
        out[i] = (len(words), len(hit), sorted(seen))
    return out


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination_equals_brute_force(spark, odd, block):
    long = " ".join(f"W{i}" for i in range(40))
    items = [(1, "A"), (2, "emoji"), (3, None), (4, ""), (5, long), (5, long), (6, " ".join(long.split()[3:18]).lower()), (None, "a b"), (7, "日本語, TEXT é!")]
    docs = dict(enumerate([*ODD, long, f"x {long}; {long} w0", " ".join(long.split()[:12]), " ".join(long.split()[5:20]) + " filler" * 600]))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("n_hit", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(frame, bench, block_windows=block).collect()}
    want = brute_contamination(docs, items)
    assert {i: (r.n_words, r.n_hit, list(r["items"])) for i, r in got.items()} == want
    assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_hit for r in got.values())
    kept = decontamination.remove_contaminated(frame, bench, block_windows=block)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    empty = decontamination.contamination(frame, bench.filter("false")).collect()
    assert all(r.n_hit == 0 and not r["items"] for r in empty) and len(empty) == len(docs)


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(i, owner.get(key(line), i))
    return sorted(((i, "\n".join(x for x in (t or "").split("\n") if i is None or owner.get(key(x), i) == i)) for i, t in rows), key=str)


def test_line_dedup_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    lines = ["The same long line", "  THE SAME LONG LINE\t", "ééééééééé", "éééééééééé", "short", "", "\x0bfoo bar baz qux\r", "FOO bar baz qux", "É upper is another", "é upper is another"]
    rows = [(i % 50 if i % 7 else None, "\n".join(rng.choices(lines, k=rng.randint(0, 8)) + [f"own line number {i % 60}"] * (i % 3))) for i in range(80)] + [(51, None), (52, "")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, key string").repartition(4)
    for batches in (1, 4, 7):
        out = line_dedup.dedup_lines(frame, batches=batches).collect()
        assert sorted(((r.doc_id, r.text or "") for r in out), key=str) == brute_lines(rows)
        assert all(r.key == "x" for r in out)
    assert line_dedup.dedup_lines(frame.filter("false")).count() == 0
