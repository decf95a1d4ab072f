import sentencepiece

import corpus_pipeline
from merchlens.llm import decontaminate, pieces
from samples import prose
from test_minhash import brute_classes
from test_decontaminate import plain


def test_stages_follow_brute_force(spark, sf, documents, texts):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding",
    ]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    lettered = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    classes = brute_classes(lettered)
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i, t in lettered.items() if classes[i] == i and not any(x in plain(t) for x in items)}
    assert set(out) == want
    engine = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, r in out.items():
        assert r["token_ids"] == engine.encode(r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == texts[i]


def test_edge_rows_pass_every_stage(spark, sf, edge_documents, no_documents):
    docs = edge_documents
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf)
        assert set(docs.columns) <= set(new.columns), name
        empty = stage(spark, no_documents, sf)
        assert empty.count() == 0
        docs = new
    ids = [r["doc_id"] for r in docs.collect()]
    assert None in ids and {1, 6, 8, 9} <= set(ids) and not {2, 3, 4, 5, 7, 11} & set(ids)


def test_decontamination_stage_uses_the_benchmark_of_the_folder(spark, sf, documents):
    kept = corpus_pipeline.no_benchmark(spark, documents, sf).count()
    leaks = decontaminate.find_leaks(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert kept == documents.count() - leaks.select("doc_id").distinct().count()


def test_exactly_one_row_of_each_class_stays(spark, sf):
    t, u, x = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, t), (1, t), (2, u), (None, u), (None, u), (3, t), (3, x), (None, prose(4, 60)), (5, t + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, sf)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, t), (2, u), (3, x), (None, prose(4, 60))], key=str)


def test_columns_that_stages_use_may_exist(spark, sf):
    text = " ".join(["token", "=", '"0123456789abcdef0123"', prose(1, 90)])
    docs = spark.createDataFrame([(1, text, "en", 7, "x", 3, 4)], "doc_id long, text string, lang string, path long, token_ids string, row_key long, in_text long")
    for stage in (corpus_pipeline.one_of_each, corpus_pipeline.no_benchmark, corpus_pipeline.secrets_masked):
        assert [r.asDict() for r in stage(spark, docs, sf).drop("text").collect()] == [r.asDict() for r in docs.drop("text").collect()]
    out = corpus_pipeline.as_pieces(spark, docs, sf).first()
    assert out["token_ids"] == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert out["path"] == 7
