import zlib
from collections import defaultdict

from merchlens.llm.sharding import schedule, shard_documents


def check(rows, texts):
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        by_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_documents_follow_the_schedule(documents, texts):
    rows = shard_documents(documents).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    groups, loads = defaultdict(int), defaultdict(int)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        groups[texts[r["doc_id"]]] += r["size"]
        loads[r["shard"]] += r["size"]
    want = defaultdict(int)
    for i, shard in schedule([(i, s) for i, s in enumerate(groups.values())], 40).items():
        want[shard] += list(groups.values())[i]
    assert sorted(loads.values()) == sorted(want.values())


def test_schedule_takes_the_largest_first_to_the_least_loaded():
    assert schedule([(1, 5), (2, 9), (3, 4), (4, 4)], 2) == {2: 0, 1: 1, 3: 1, 4: 0}


def test_edge_rows(edge_documents, no_documents):
    rows = shard_documents(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    assert len({r["shard"] for r in rows if r["size"] == 16 and r["text_crc32"] == 0}) <= 2  # null and empty texts
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert shard_documents(no_documents).count() == 0
