import numpy as np
import pytest
import sentencepiece

from merchlens.llm import pieces as P

CASES = ["        x     y  " + " " * 50, "", " ", "  a", "Hello  world\n x\ty ", "😀 thntblere", "abc   ", "日本語 テスト", "a" * 3000, "ﬁ　x", "<s> hi </s>", "\x00\x7f"]


def encoded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    return {r["doc_id"]: r["ids"] for r in P.encode(df).collect()}


def test_ids_equal_the_library(spark, texts):
    lines = [*texts.values(), *CASES]
    want = sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode(lines)
    got = encoded(spark, lines)
    assert [got[i] for i in range(len(lines))] == want


def best_score(table, scores, word):
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - table.longest), end):
            s = scores.get(word[begin:end], table.low if end - begin == 1 else float("-inf"))
            best[end] = max(best[end], best[begin] + s)
    return best[-1]


def test_unigram_scores_are_maximal(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    table = P.Pieces()
    table.merges = False
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    words = sorted({w for t in list(texts.values())[:40] for w in (t or "").split() if all(table.chars[ord(c)] for c in w)})
    by_length = {}
    for w in words:
        by_length.setdefault(len(w) + 1, []).append("▁" + w)
    for same in by_length.values():
        ids, counts = P.viterbi(table, np.array([[ord(c) for c in w] for w in same], np.uint32))
        for w, part in zip(same, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert "".join(sp.id_to_piece(int(x)) for x in part) == w
            assert sum(sp.get_score(int(x)) for x in part) == pytest.approx(best_score(table, scores, w))


def test_round_trip(spark, documents, edge_documents, no_documents):
    for df in (documents, edge_documents, spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")):
        rows = P.token_report(df).collect()
        assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
    assert P.token_report(no_documents).count() == 0
    null = [r["ids"] for r in P.encode(edge_documents).filter("text IS NULL").collect()]
    assert null and set(map(type, null)) == {type(None)}


def test_existing_columns_are_not_overwritten(edge_documents):
    with pytest.raises(ValueError):
        P.encode(edge_documents, out="shard")
