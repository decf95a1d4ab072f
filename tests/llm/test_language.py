import zlib

import numpy as np

from merchlens.llm import langid as L


def test_held_out_accuracy(spark, documents):
    rows = {r["doc_id"]: r for r in L.identify(documents).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert set(rows) == set(truth)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [i for i in rows if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) >= 0.97


def test_predictions_do_not_depend_on_held_out_labels_or_other_columns(spark, documents):
    changed = documents.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 'xx', lang) AS lang", "'s' AS source")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(documents).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(changed).collect()}
    assert a == b


def test_edge_rows(spark, edge_documents, no_documents):
    rows = L.identify(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {3, 4, 5, 11} <= und and not und & {1, 6, 8, 10}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert L.identify(no_documents).count() == 0
    unlabelled = L.identify(edge_documents.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_gram_counts_match_plain_counting():
    texts = ["Aé b1", "", "aé B", "ß"]
    raw = [t.encode() for t in texts]
    counts, letters = L.gram_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert letters.tolist() == [True, False, True, True]
    assert (counts[0] == counts[2]).all() and counts[1].sum() == 0
    # a, é, b; ( a), (aé), (é ), ( b), (b ); ( aé), (aé ), (é b), ( b ), (b  )
    assert counts[0].sum() == 3 + 5 + 5


def test_temperature_is_the_best_on_a_grid():
    rng = np.random.default_rng(3)
    logits = rng.standard_normal((500, 3)) * 4
    p = np.exp(logits / 2.5)
    labels = np.array([rng.choice(3, p=x / x.sum()) for x in p])
    assert abs(L.fit_temperature(logits, labels) - 2.5) < 0.5


def test_ftrl_drops_useless_features():
    rng = np.random.default_rng(0)
    model = L.Ftrl(6, 2, l1=1.0)
    for _ in range(400):
        label = int(rng.integers(2))
        model.learn(np.arange(6), np.concatenate([[label * 2.0 - 1], rng.standard_normal(5) * 0.1]), label)
    w = model.weights()
    assert w[0, 1] > 0 > w[0, 0] and (w[1:] == 0).any()


def test_copies_of_a_drawn_text_reach_the_driver_once(spark, monkeypatch):
    monkeypatch.setattr(L, "FIT_PER_LANGUAGE", 50)
    text = "le texte répété " * 3
    rows = spark.range(3000).selectExpr("IF(id < 2000, 'fr', 'en') AS lang", f"IF(id < 1500, '{text}', concat('number ', id, ' of all the words')) AS text")
    seen = []
    fit_weights = L.fit_weights
    monkeypatch.setattr(L, "fit_weights", lambda rows, *a: seen.append(len(rows)) or fit_weights(rows, *a))
    arrow = type(rows).toArrow
    reached = []

    def counted(df):
        table = arrow(df)
        reached.append(table.num_rows)
        return table

    monkeypatch.setattr(type(rows), "toArrow", counted)
    model = L.fit(rows)
    assert model.classes == ["en", "fr"] and seen[0] <= 100
    assert max(reached) <= 200
    pred = {r["lang_pred"] for r in L.predict(rows.filter("lang = 'en'"), model).collect()}
    assert pred == {"en"}
