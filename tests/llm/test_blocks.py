import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from merchlens.llm import blocks as B

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abé \t\n漢", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for low, high, data, offsets in B.blocks(pa.array(texts, pa.string()), limit=40):
        words = B.split_words(data, offsets)
        raw = data.tobytes()
        spans = [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
        got += [spans[words.first[i] : words.first[i + 1]] for i in range(high - low)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=30), min_size=1, max_size=6))
def test_equal_words_and_shingles_have_equal_keys(texts):
    data, offsets = B.text_arrays(pa.array(texts))
    words = B.split_words(data, offsets)
    raw = data.tobytes()
    by_word = {}
    for a, b, k in zip(words.start, words.end, words.key.tolist(), strict=True):
        assert by_word.setdefault(raw[a:b], k) == k
    assert len(set(by_word.values())) == len(by_word)
    rows, keys = B.shingles(words, 3)
    want, seen = [], {}
    for i, t in enumerate(texts):
        w = t.split()
        want += [(i, tuple(w[j : j + 3])) for j in range(max(1, len(w) - 2) if w else 0)]
    assert [r for r, _ in want] == rows.tolist()
    for (_, shingle), k in zip(want, keys.tolist(), strict=True):
        assert seen.setdefault(shingle, k) == k
    assert len(set(seen.values())) == len(seen)


def test_equal_windows_share_anchor_and_every_window_is_in_one_run():
    rng = np.random.default_rng(0)
    alphabet = B.mix(np.arange(40, dtype=np.uint64))
    passage = alphabet[rng.integers(0, 40, 90)]
    parts = [np.concatenate([alphabet[rng.integers(0, 40, 30 + i)], passage, alphabet[rng.integers(0, 40, 25)]]) for i in range(3)]
    keys, first = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
    runs = B.window_runs(keys, first, 50, 8)
    at = {}
    for begin, count, anchor, fp in zip(runs.begin, runs.count, runs.anchor, runs.fingerprint.tolist(), strict=True):
        for i in range(begin, begin + count):
            at[i] = (anchor - i, fp)
    assert set(at) == {i for a, b in zip(first[:-1], first[1:], strict=True) for i in range(a, b - 49)}
    seen = {}
    for i, place in at.items():
        assert seen.setdefault(keys[i : i + 50].tobytes(), place) == place
    assert len(set(B.window_keys(keys, 50)[list(at)].tolist())) == len(seen)


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 200)
    for width in (1, 2, 3, 43, 64, 200, 201):
        want = [x[i : i + width].min() for i in range(len(x) - width + 1)]
        assert B.sliding_min(x, width).tolist() == want
