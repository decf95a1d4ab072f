import re

import numpy as np
from samples import prose

from merchlens.llm import decontaminate as D


def plain(text):
    return " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))) + " "


def test_exact_copies_are_all_found_and_clean_documents_left(spark, sf, texts, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if t and plain(x) in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(documents, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want and got == want


def test_paraphrases_need_the_answer(spark):
    items = [(i, prose(100 + i, 30) + ".\nThe answer is " + prose(500 + i, 5)) for i in range(8)]
    def cut(text, step, answer):
        w = text.split()
        body = [x for j, x in enumerate(w[:30]) if j % step != 1]
        return " ".join(body + (w[30:] if answer else []))
    docs = [(1, prose(1, 60) + " " + cut(items[0][1], 3, True) + " " + prose(2, 60))]  # 2 of 3 words, with the answer
    docs += [(2, prose(3, 60) + " " + cut(items[1][1], 2, False) + " " + prose(4, 60))]  # every other word, no answer
    docs += [(3, prose(5, 300)), (4, items[2][1].upper().replace(" ", ", ")), (5, items[3][1][:60])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (4, 2)}


def test_edge_rows(spark, edge_documents, no_documents):
    benchmark = spark.createDataFrame([(1, prose(2, 80)), (2, None), (3, ""), (None, prose(5, 90)), (4, "one two"), (5, prose(1, 30_000)[90_000:90_400])], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in D.find_leaks(edge_documents, benchmark).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (6, 5), (7, 5)]
    kept = D.without_leaks(edge_documents, benchmark)
    assert kept.columns == edge_documents.columns and kept.count() == edge_documents.count() - 5
    assert D.find_leaks(no_documents, benchmark).count() == 0
    assert D.find_leaks(edge_documents, benchmark.limit(0)).count() == 0
    assert D.without_leaks(edge_documents, benchmark.limit(0)).count() == edge_documents.count()


def test_longest_common_subsequence():
    def plain_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, 30).tolist(), rng.integers(0, 6, 50).tolist()
        assert D.common_subsequence(D._masks(a), len(a), b) == plain_lcs(a, b)


def test_latent_space_is_that_of_a_full_decomposition(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 25)) + 0.01 * rng.standard_normal((60, 25))
    df = spark.createDataFrame([(list(range(25)), r.tolist()) for r in a], "at array<int>, value array<double>").repartition(3)
    basis = D.latent_space(df, 25, 4)
    top = np.linalg.svd(a)[2][:4]
    assert np.allclose(np.linalg.svd(top @ basis)[1], 1, atol=1e-6)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 3)
    items = [(i, prose(700 + i, 35)) for i in range(8)]
    docs = [(i, prose(i, 70) + " " + t + " " + prose(90 + i, 70)) for i, t in items] + [(99, prose(98, 200))]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i, _ in items}


def test_benchmarks_beyond_one_latent_space_equal_brute_force(spark):
    items = {i: prose(5000 + i, 25) for i in range(1100)}
    docs = {}
    for d in range(22):
        parts = []
        for i in range(d * 50, d * 50 + 50, 5):
            words = items[i].split()
            words[3], words[12] = f"edit{i}", f"edit{i}x"  # no copy word for word
            parts += [prose(90_000 + i, 30), " ".join(words)]
        docs[d] = " ".join(parts)
    keys = {i: D.keys_of(t).tolist() for i, t in items.items()}
    masks = {i: D._masks(k) for i, k in keys.items()}
    want = set()
    for d, text in docs.items():
        words = D.keys_of(text).tolist()
        want |= {(d, i) for i, k in keys.items() if D.common_subsequence(masks[i], len(k), words) >= D.COPY * len(k)}
    assert len(want) == 220
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = D.find_leaks(df, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_copies_of_function_words_and_of_short_items(spark):
    # the words of item 0 are in every half passage, so they are no features
    docs = [(i, " ".join(f"to be or not to {w}" for w in prose(600 + i, 200).split())) for i in range(20)]
    docs += [(50, prose(1, 40) + " to be or not to be or not " + prose(2, 40))]
    docs += [(51, prose(3, 40) + " one two THREE, four five six " + prose(4, 40))]
    items = [(0, "to be or not to be or not"), (1, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(50, 0), (51, 1)} <= {(r["doc_id"], r["item_id"]) for r in got}
    assert next(r["similarity"] for r in got if r["doc_id"] == 50) == 1
