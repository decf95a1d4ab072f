import re

import pytest
from samples import prose

from merchlens.llm import repeats as R


def brute(rows):
    """(words, removed, kept) of (doc_id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - R.WINDOW + 1):
            if i is not None:
                key = tuple(w[k : k + R.WINDOW])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - R.WINDOW + 1):
            if i is not None and owner[tuple(w[k : k + R.WINDOW])] < i:
                gone[k : k + R.WINDOW] = [True] * R.WINDOW
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in R.remove_repeats(df).collect()), key=str)


def test_documents_equal_brute_force(documents, texts):
    assert got(documents) == brute(list(texts.items()))


def test_passages_with_shifting_neighbours(spark):
    p, q = prose(1, 60), prose(2, 49)
    rows = [
        (5, prose(10, 30) + " " + p + " " + prose(11, 40)),
        (3, prose(12, 20) + "\n" + p + "\t" + prose(13, 30)),
        (9, " ".join(p.split()[5:58]) + " " + prose(14, 10) + " " + p),
        (2, q + " " + prose(15, 40)),
        (4, prose(16, 40) + " " + q),  # 49 words repeat: too few
        (6, "same " * 200),
        (7, "same " * 120 + prose(17, 60)),
        (8, p + " " + p),
        (1, prose(18, 10)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)
    assert {r[0]: r[2] for r in got(df)}[5] == 60


def test_edge_rows(edge_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in edge_documents.collect()]
    assert got(edge_documents) == brute(rows)
    assert R.remove_repeats(no_documents).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rows = [(i, " ".join(w[0] for w in prose(seed * 10 + i % 3, 150).split()) + f" {i}" * (i % 4)) for i in range(8)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
