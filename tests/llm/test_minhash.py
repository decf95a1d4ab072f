import re
from collections import Counter

import numpy as np
import pytest

from merchlens.llm import minhash as M
from samples import prose


def shingle_bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts):
    bags = {i: shingle_bag(t) for i, t in texts.items()}
    df = Counter(s for b in bags.values() for s in b)
    n = sum(bool(b) for b in bags.values())
    top = 1 + np.log10(1 / M.HEAVY)
    weight = {s: min(1 + np.log10(n / d), top) if d >= max(1, M.HEAVY * n) else top for s, d in df.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bags)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bags[a] and bags[b] and bags[a].keys() & bags[b].keys():
                both = sum(c * weight[s] for s, c in (bags[a] & bags[b]).items())
                if both / sum(c * weight[s] for s, c in (bags[a] | bags[b]).items()) >= M.SIMILARITY:
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(documents).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("small", [32, 3])
def test_large_groups_of_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(M, "SMALL", small)
    rng = np.random.default_rng(5)
    docs = {}
    for group in range(3):
        words = prose(1000 + group, 200).split()
        for k in range(40):
            copy = list(words)
            for at in rng.choice(200, 2, replace=False):
                copy[at] = f"edit{group}x{k}x{at}"
            docs[len(docs)] = " ".join(copy if k else words)
    docs |= {1000 + i: prose(i, 150) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = M.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(docs)
    assert sum(r["kept"] for r in rows) == 43


def test_edge_rows(edge_documents, no_documents):
    rows = M.near_duplicates(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes == {None: None, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    assert M.near_duplicates(no_documents).count() == 0


def test_samples_agree_with_the_probability_of_the_weighted_similarity():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        key = M.mix(rng.integers(0, 2**62, 150).astype(np.uint64)) >> np.uint64(16)
        wa, wb = rng.uniform(0.5, 3, 150), rng.uniform(0.5, 3, 150)
        order = np.argsort(key)
        one = M.samples(np.zeros(150, np.int64), key[order], wa[order], 1)
        two = M.samples(np.zeros(150, np.int64), key[order], wb[order], 1)
        agree.append((one == two).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(agree)) < 0.03


def test_near_copies_inside_a_family_just_below_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "SEGMENT", 16, raising=False)
    rng = np.random.default_rng(7)
    words, docs = prose(2000, 200).split(), {}
    for k in range(60):
        member = list(words)
        for at in rng.integers((8, 100), (90, 185)):
            member[at] = f"own{k}x{at}"
        docs[2 * k] = " ".join(member)
        member[195] = f"twin{k}"
        docs[2 * k + 1] = " ".join(member)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute_classes(docs)
    assert len(set(want.values())) > 30
    assert {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()} == want


def test_every_frequency_counts(spark):
    shared = prose(3000, 100)
    docs = {i: f"{shared} {prose(3100 + i, 10)}" for i in range(8)} | {100 + i: prose(3200 + i, 30) for i in range(92)}
    bags = {i: shingle_bag(t) for i, t in docs.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = {s: 1 + np.log10(len(docs) / d) for s, d in df.items()}
    one, two = bags[0], bags[1]
    assert (one & two).total() / (one | two).total() >= M.SIMILARITY
    assert sum(c * weight[s] for s, c in (one & two).items()) / sum(c * weight[s] for s, c in (one | two).items()) < M.SIMILARITY
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: Counter(np.frombuffer(r["df"], np.uint8).tolist()) for r in M.signatures(frame).collect()}
    assert got == {i: Counter(df[s] for s in b) for i, b in bags.items()}
    assert {r["doc_id"]: r["class_id"] for r in M.near_duplicates(frame).collect()} == {i: i for i in docs}


def test_near_copies_in_a_larger_group_are_found_in_a_large_table(spark):
    shared = prose(4000, 100)
    docs = {i: f"{shared} {prose(4100 + i, 10)}" for i in range(30)}
    assert (shingle_bag(docs[0]) & shingle_bag(docs[1])).total() >= M.SIMILARITY * (shingle_bag(docs[0]) | shingle_bag(docs[1])).total()
    docs |= {100 + i: prose(5000 + i, 8) for i in range(3000)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    classes = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(frame).collect()}
    assert classes == {i: 0 if i < 30 else i for i in docs}


def test_squeezed_numbers_are_the_numbers():
    rng = np.random.default_rng(3)
    steps = rng.poisson(0.8, 3000)
    for x in (steps, np.zeros(1, np.int64), np.array([0, 70_000, 5]), np.empty(0, np.int64)):
        assert (M._expanded(M._squeezed(x), len(x)) == x).all()
    assert len(M._squeezed(steps)) < 0.4 * len(M._packed(steps))
