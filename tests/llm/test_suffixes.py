from collections import Counter

import numpy as np
from samples import prose

from merchlens.llm import suffixes as S


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + S.WINDOW] for _, b in raw for k in range(len(b) - S.WINDOW + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - S.WINDOW + 1):
            if times[b[k : k + S.WINDOW]] > 1:
                gone[k : k + S.WINDOW] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        spans = [(int(a), int(z - a)) for a, z in zip(edges[::2], edges[1::2], strict=True)]
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def got(df):
    rows = S.remove_repeated_bytes(df).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=str)


def passages():
    p, q, e = prose(1, 90), prose(2, 40)[:399], "é" * 150 + prose(3, 40)
    rows = [(i, prose(100 + i, 40) + p[i : len(p) - i] + prose(200 + i, 40)) for i in range(6)]
    rows += [(10, q + "!" + q), (11, e), (12, e[1:] + "x"), (13, "ab" * 700), (14, prose(7, 300)), (15, prose(7, 300)), (16, p + p)]
    return rows


def test_documents_equal_brute_force(documents, texts):
    assert got(documents) == brute(list(texts.items()))


def test_shifting_neighbours_and_periodic_texts(spark):
    rows = passages()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_anchors_with_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(S, "CONTEXTS", 2)
    rows = passages()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edge_rows(spark, edge_documents, no_documents):
    short = edge_documents.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    assert got(short) == brute([(r["doc_id"], r["text"]) for r in short.collect()])
    long = got(edge_documents.filter("doc_id IN (6, 7)"))
    assert all(n == gone and kept == b"" for _, n, gone, _, kept in long)
    assert S.remove_repeated_bytes(no_documents).count() == 0


def test_common_prefixes_of_a_collection():
    rng = np.random.default_rng(0)
    core = rng.integers(97, 100, 700).astype(np.uint8).tobytes()
    texts = [core[a:b] for a, b in ((0, 700), (50, 690), (200, 620), (0, 460))] + [core[:300] + b"#" + core[301:700], core]
    lead = np.array([300 - a for a in (0, 50, 200, 0, 0, 0)])
    group = np.array([0, 0, 0, 0, 0, 1])
    marks = S.repeated_windows(group, texts, lead)
    for i, (text, at) in enumerate(zip(texts, lead, strict=True)):
        for column in range(S.LEFT + 1):
            k = at - S.LEFT + column
            window = text[max(k, 0) : k + S.WINDOW]
            others = [t for j, t in enumerate(texts) if j != i and group[j] == group[i]]
            same = any(t[max(0, a - S.LEFT + column) :][: S.WINDOW] == window for t, a in zip(others, [x for j, x in enumerate(lead) if j != i and group[j] == group[i]], strict=True))
            if k >= 0 and len(window) == S.WINDOW:
                assert marks[i, column] == same, (i, column)
