import corpus_pipeline
from corpusmill.llm import decontamination, queries, sentencepiece_codec, toxicity
from test_text_operators import brute_components, brute_contamination, brute_lines, brute_simhash


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    import hashlib

    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}

    def step(name, frame):
        out = stages[name](spark, frame, sf_dir)
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        return spark.read.parquet(path)

    first = step("toxicity", docs)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {i for i, s in score.items() if s < 0.3}
    second = step("line dedup", first)
    assert second.columns == columns
    assert sorted(((r.doc_id, r.text or "") for r in second.collect()), key=str) == brute_lines([(r.doc_id, r.text) for r in first.collect()])
    third = step("SimHash near-dedup", second)
    prints = {r.doc_id: brute_simhash(r.text) for r in second.collect()}
    roots = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert third.columns == columns and {r.doc_id for r in third.collect()} == set(roots.values())
    fourth = step("benchmark decontamination", third)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_contamination({r.doc_id: r.text for r in third.collect()}, items)
    assert {r.doc_id for r in fourth.collect()} == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    last = step("SentencePiece", fourth)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = {r.doc_id: hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest() for r in fourth.collect()}
    assert {r.doc_id: r.ids_sha256 for r in last.collect()} == want
    assert sentencepiece_codec.splits_at_marks(library) and decontamination.WIDTH == 13
