import random
import re
import zlib
from collections import Counter

import pytest

from merchlens.llm import spelling as S
from merchlens.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute_variants(count):
    near = {w: [] for w in count}
    by_size = {}
    for w in count:
        by_size.setdefault(len(w), []).append(w)
    for w in count:
        near[w] = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if one_edit(w, x)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_words(seed=5):
    rng = random.Random(seed)
    words = set()
    for _ in range(60):
        base = "".join(rng.choices("abé", k=rng.randrange(1, 14)))
        words.add(base)
        for _ in range(6):
            k = rng.randrange(len(base) + 1)
            words.add(base[:k] + rng.choice(["", "a", "é", "z"]) + base[k + rng.randrange(2) :])
    return {w: rng.choice([1, 2, 3, 25, 30, 400]) for w in sorted(words)}


@pytest.mark.parametrize(("limit", "rows"), [(4096, 1 << 16), (2, 7)])
def test_variants_equal_brute_force(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "ROWS", rows)
    words = made_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.spelling_variants(df)) == brute_variants(words)


def test_scanned_rows_in_small_parts(spark, monkeypatch):
    words = made_words(6)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {tuple(r) for r in S.near_words(df).collect()}
    assert want == {(a, words[a], b, words[b]) for a in words for b in words if a < b and one_edit(a, b)}
    size = S.F.char_length("word")
    windows = df.select("word", "n", S.F.explode(S.F.array(size, size - 1)).alias("m")).filter("m >= 0")
    windows = windows.selectExpr("word", "n", "m", "0 AS low", "m + 1 AS high")  # one bucket for each length
    table = S._bucketed(windows).select("bucket", "middle", "short", "word", "n").sort("bucket", "middle").toArrow()
    for rows, cells in ((1, 1), (10, 100), (1 << 16, 1 << 22)):
        monkeypatch.setattr(S, "ROWS", rows)
        monkeypatch.setattr(S, "CELLS", cells)
        got = [r for batch in S._scan_partition(iter(table.to_batches(max_chunksize=5))) for r in batch.to_pylist()]
        got = {(r["a"], r["n_a"], r["b"], r["n_b"]) if r["a"] < r["b"] else (r["b"], r["n_b"], r["a"], r["n_a"]) for r in got}
        assert got == want


def test_band_rows_follow_the_edit_matrix():
    rng = random.Random(9)
    for _ in range(3000):
        x, y = ("".join(rng.choices("ab", k=rng.randrange(7))) for _ in range(2))
        if x == y:
            continue
        a, b = sorted((x, y))
        points = S.np.array([ord(c) for c in a + b], S.np.uint32)
        size = S.np.array([len(a), len(b)])
        q, _ = S.scan(points, S.np.array([0, len(a)]), size, S.np.array([True, False]))
        assert (len(q) == 1) == one_edit(a, b), (a, b)


def test_chains_are_followed_to_the_last_form(spark):
    words = {"abcdefgh": 100_000, "abcdefghi": 9_000, "abcdefghij": 800, "abcdefghijk": 70, "abcdefghijkl": 6, "qqqqqqqq": 3, "bbbbbbb": 10, "bbbbbbc": 1}
    rows = rows_of(S.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert rows == brute_variants(words)
    assert {r[0]: r[2] for r in rows}["abcdefghijkl"] == "abcdefgh"


def test_query_equals_brute_force(spark, sf, texts):
    assert rows_of(QUERIES["op13_spelling"](spark, sf)) == brute_variants(brute_words(texts.items()))


def test_edge_rows(spark, edge_documents, no_documents):
    twice = edge_documents.union(edge_documents)
    want = brute_variants(brute_words((r["doc_id"], r["text"]) for r in twice.collect()))
    assert rows_of(S.word_variants(twice)) == want and want
    assert S.word_variants(no_documents).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "short 1234567")], "doc_id long, text string")
    assert S.word_variants(nothing).count() == 0
