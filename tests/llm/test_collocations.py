import random
import re
from collections import Counter

import pytest

from merchlens.llm import collocations as C
from merchlens.llm.queries import QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=4, fewest=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {x: c for x, c in f.items() if c >= fewest}
    around = Counter()
    for (lang, words), c in often.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                around[lang, words[i : i + m]] = max(around[lang, words[i : i + m]], c)
    found = {}
    for (lang, words), a in often.items():
        if len(words) > 1 and 100 * around[lang, words] < 80 * a:
            cuts = [(C.SCALE * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, all_ in found.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1)
    }


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_texts(seed, n):
    """Few words, so that all sizes are frequent, with repeated passages, blank runs and letters of two bytes."""
    rng = random.Random(seed)
    words = "a B c é dd Été x\x0by 漢 e\x00f z\xa0z".split(" ")
    passage = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.2 else " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(30))) for _ in range(4)]
        yield i, rng.choice(["en", "fr", None, "und"]), rng.choice([". ", "\t", ",", "\n \n", "  "]).join(parts)


@pytest.mark.parametrize(("trigger", "top"), [(16, 2000), (1, 7), (2, 2000)])
def test_equal_to_brute_force(spark, trigger, top, monkeypatch):
    monkeypatch.setattr(C, "TRIGGER", trigger)
    texts = list(made_texts(trigger, 300))
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    want = brute([t[1:] for t in texts], top=top)
    assert rows_of(C.collocations(df, top=top)) == want and want


def test_other_sizes(spark):
    texts = list(made_texts(11, 200))
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    for longest in (2, 3, 5):
        assert rows_of(C.collocations(df, longest, fewest=5)) == brute([t[1:] for t in texts], longest, 5)
    with pytest.raises(ValueError):
        C.collocations(df, longest=1)


@pytest.mark.parametrize("trigger", [1, 3, 16])
def test_chunks_count_every_phrase_once(trigger, monkeypatch):
    monkeypatch.setattr(C, "TRIGGER", trigger)
    texts = ["", "one", "a b c d e f g h a b c d e f g h, a b c d e f", "x " * 100, "A b. C d e f g\nh i  j\tk"]
    batch = C.pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    got, want = Counter(), Counter()
    for rows in C._parser(4)(iter([batch])):
        for chunk, starts in zip(rows.column("chunk").to_pylist(), rows.column("starts").to_pylist(), strict=True):
            words = chunk.decode().split(" ")
            got.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(min(starts, len(words) - k + 1)))
    for text in texts:
        for piece in re.split("[.,;:!?\n]", text.lower()):
            words = piece.split()
            want.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert got == want


def test_sums_pass_64_bits(spark):
    chunks = spark.createDataFrame([("en", b"a b", 2, 4 * 10**18), ("en", b"b", 1, 4 * 10**18)], "lang string, chunk binary, starts long, freq long")
    sizes = C.frequent_phrases(chunks, 2)
    assert {r["f"] for r in sizes[1].collect()} == {4 * 10**18}
    assert {bytes(r["phrase"]): r["f"] for r in sizes[0].collect()} == {b"a": 4 * 10**18, b"b": 8 * 10**18}


def test_phrases_with_equal_keys_stay_apart():
    key, other = C.np.array([5, 7, 5, 5, 7], C.np.uint64), C.np.array([1, 2, 3, 1, 2], C.np.uint64)
    order, kinds = C._first_of_equals(key, other)
    assert sorted(sorted(x.tolist()) for x in C.np.split(order, kinds[1:])) == [[0, 3], [1, 4], [2]]


def test_query_equals_brute_force(spark, documents, sf):
    assert rows_of(QUERIES["op11_collocations"](spark, sf)) == brute((r["lang"], r["text"]) for r in documents.collect())


def test_edge_rows(spark, edge_documents, no_documents):
    many = edge_documents.selectExpr("*", "explode(sequence(1, 40)) AS again")
    want = brute((r["lang"], r["text"]) for r in many.collect())
    assert rows_of(C.collocations(many)) == want and {"und", "en"} <= {r[0] for r in want}
    assert C.collocations(no_documents).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), (None, " .,\n")], "lang string, text string")).count() == 0
