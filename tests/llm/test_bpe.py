import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from merchlens.llm import bpe as B
from merchlens.llm.queries import QUERIES

rng = random.Random(7)
CASES = [
    None, "", " ", "   x", "it's I'll we'd", "a\n\n\n b\t\t c", "日本語" * 500, "é" * 600, "a" * 5000, " " * 3000 + "x", "x" * 1024, "\x00\x7f \xa0",
    "".join(rng.choice("abcdefgh漢é") for _ in range(3000)), "".join(map(chr, rng.choices(range(32, 0x3000), k=4000))), "😀 thntblere 12345.67", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    lines = map(bytes.split, open(public_tokenizers.path(B.RANKS), "rb"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks()


def encoded(ranks, texts):
    ids, ends = B.Encoder(ranks).block(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_ids_equal_the_library(ranks, library, texts):
    lines = [*texts.values(), *CASES]
    assert encoded(ranks, lines) == [library.encode_ordinary(t or "") for t in lines]


def test_every_code_point_is_split_alike(ranks, library):
    lines = [f"a{c}b {c}{c} 1{c}2{c}\n{c} .{c}" for c in map(chr, range(0, 0x20000, 7)) if not 0xD800 <= ord(c) < 0xE000]
    assert encoded(ranks, lines) == [library.encode_ordinary(t) for t in lines]


def test_heap_and_matrix_agree_with_the_library(ranks, library):
    words = ["".join(rng.choices("abcdefgh", k=k)).encode() for k in (1, 2, 5, 31, 200, 1024) for _ in range(30)] + [b"a" * k for k in range(1, 70)]
    ids, counts = B.word_ids(ranks, words)
    at = counts.cumsum()
    want = [library.encode_ordinary(w.decode()) for w in words]
    assert [ids[e - c : e].tolist() for c, e in zip(counts, at)] == want
    assert [[ranks.ids[w]] if w in ranks.ids else B.merge_long(ranks, w) for w in words] == want


def test_long_texts_are_cut_where_words_begin(ranks, library, texts, monkeypatch):
    monkeypatch.setattr(B, "CUT", 40)
    lines = [t or "" for t in texts.values()] + [c or "" for c in CASES]
    assert encoded(ranks, lines) == [library.encode_ordinary(t) for t in lines]


def test_small_cache(ranks, library, texts, monkeypatch):
    monkeypatch.setattr(B, "CACHE_WORDS", 10)
    encoder, lines = B.Encoder(ranks), [t or "" for t in texts.values()]
    got = [encoder.block([t])[0].tolist() for t in lines]
    assert got == [library.encode_ordinary(t) for t in lines]


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    listed = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library(spark, sf, library, texts):
    rows = QUERIES["op12_bpe"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {i: digests(library, t) for i, t in texts.items()}
    assert len(rows) == len(texts)


def test_edge_rows(spark, edge_documents, no_documents, library):
    rows = B.bpe_report(edge_documents).collect()
    want = [(r["doc_id"], *digests(library, r["text"])) for r in edge_documents.collect()]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
    assert B.bpe_report(no_documents).count() == 0
    both = B.decode(B.encode(edge_documents, "text", "shard"), "shard", "kept")  # existing columns of these names are replaced
    assert sorted(both.columns) == sorted(edge_documents.columns)
    assert all(bytes(r["kept"]) == (r["text"] or "").encode() for r in both.collect())
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in B.decode(null).collect()] == [b"", b""]
