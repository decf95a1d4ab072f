import re

import numpy as np
from samples import prose

from merchlens.llm import secrets as S


def keyed(i):
    rng = np.random.default_rng(i)
    hexa = "".join(rng.choice(list("0123456789abcdef"), 40))
    caps = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
    return [f'token = "{hexa}"', f"password={hexa[:18]}", f"AKIA{caps}", f"card {4 * 10**15 + i}", "thequickbrownfoxjumps"][i % 5]


def planted(spark, n=200):
    rows = [(i, f"{prose(i, 30)} {keyed(i)} {prose(i + 1, 20)}", "src") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_secrets_are_found_and_others_left(spark):
    df, rows = planted(spark)
    scanner = S.fit(df)
    assert scanner.forest is not None
    found = {(r["doc_id"], r["start"], r["length"]) for r in S.scan(df, scanner).filter("is_secret").collect()}
    want = set()
    for i, text, _ in rows:
        m = re.search(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|AKIA[A-Z2-7]{16}', text)
        if m:
            want.add((i, m.start(), len(m[0])))
    assert found == want


def test_redaction_keeps_everything_else(spark):
    df, rows = planted(spark, 60)
    clean = {r["doc_id"]: r["text"] for r in S.redact(df, S.fit(df)).collect()}
    for i, text, _ in rows:
        want = re.sub(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|AKIA[A-Z2-7]{16}', "[SECRET]", text)
        assert clean[i] == want


def test_forest_copy_votes_as_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "features array<double>, label double")
    model = RandomForestClassifier(numTrees=7, maxDepth=5, seed=1).fit(df.select(array_to_vector("features").alias("features"), "label"))
    forest = S.read_trees(model.toDebugString)
    from pyspark.ml.linalg import Vectors

    for row in x[:40]:
        votes = np.mean([t.predict(Vectors.dense(row)) for t in model.trees])
        assert forest.score(row[None, :])[0] == votes


def test_candidates_are_those_of_the_pattern(texts):
    from merchlens.llm.blocks import blocks
    import pyarrow as pa

    some = list(texts.values())[:80] + [None, "", "é" + "a1" * 9 + "ü"]
    got, want = [], []
    for low, _, data, offsets in blocks(pa.array(some)):
        raw = data.tobytes()
        got += [(r + low, raw[s:e]) for r, s, e in zip(*(x.tolist() for x in S.candidates(data, offsets)), strict=True)]
    for i, t in enumerate(some):
        for m in re.finditer(rb"[A-Za-z0-9_\-+/]{12,}", (t or "").encode()):
            if len(m[0]) >= 16 or re.search(rb"\d", m[0]):
                want.append((i, m[0]))
    assert got == want


def test_edge_rows(spark, edge_documents, no_documents):
    scanner = S.fit(edge_documents)
    assert {r["doc_id"] for r in S.scan(edge_documents, scanner).collect()} <= {10}
    out = S.redact(edge_documents, scanner)
    assert out.columns == edge_documents.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, edge_documents.select("doc_id", "text").collect()))
    assert S.find_secrets(no_documents).count() == 0
    assert S.redact(no_documents, S.fit(no_documents)).count() == 0
    by_rule = S.scan(edge_documents.selectExpr("doc_id", "'token = \"0123456789abcdef0123\"' AS text"), S.Scanner(scanner.corpus, None))
    assert {r["is_secret"] for r in by_rule.collect()} == {True}


def test_copies_of_a_finding_stay_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(S, "FIT_FINDINGS", 100)
    one = spark.range(5000).selectExpr("IF(id < 4000, array(1D, 0D), array(CAST(id AS DOUBLE), 1D)) AS features", "CAST(id % 2 AS DOUBLE) AS label")
    fitted = []
    fit = S.RandomForestClassifier.fit
    monkeypatch.setattr(S.RandomForestClassifier, "fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    assert S.fit_forest(one) is not None
    assert 0 < fitted[0] <= 400


def test_path_column_of_any_type(spark):
    line = 'token = "0123456789abcdef0123"'
    docs = spark.createDataFrame([(1, line, 5, "a.py"), (2, line, None, None)], "doc_id long, text string, path long, source string")
    scanner = S.Scanner(S.fit(docs).corpus, None)
    for column in ("path", "source", "missing"):
        assert {r["doc_id"] for r in S.scan(docs, scanner, column).filter("is_secret").collect()} == {1, 2}
        out = S.redact(docs, scanner, column).orderBy("doc_id").collect()
        assert [(r["text"], r["path"], r["source"]) for r in out] == [('token = "[SECRET]"', 5, "a.py"), ('token = "[SECRET]"', None, None)]
    assert S.find_secrets(docs).count() == 2
