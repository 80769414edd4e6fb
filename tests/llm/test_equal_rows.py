"""Rows that repeat many times are numbered in blocks that spread over the tasks."""

import pytest
from helpers import DOC_SCHEMA, row

from cohortflow.llm import common, packing, sharding


@pytest.fixture
def hot(spark, monkeypatch):
    """A third null documents, a third equal ones, the rest apart; blocks of seven copies."""
    monkeypatch.setattr(common, "COPIES", 7)
    rows = [row(None, None)] * 100 + [row(1, "one and the same")] * 99 + [row(k, f"text {k} " * (k % 5)) for k in range(2, 103)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(6)


def test_counted_and_unfolded(hot):
    blocks = common.counted(hot.select("doc_id", "text"))
    copies = sorted((r.doc_id or 0, r.block_, r.copies_) for r in blocks.collect() if r.doc_id is None or r.doc_id == 1)
    assert copies == [(0, k, 7) for k in range(14)] + [(0, 14, 2)] + [(1, k, 7) for k in range(14)] + [(1, 14, 1)]
    numbered, n = sharding.number_rows(hot.select("doc_id", "text"))
    got = numbered.collect()
    assert n == 300 and sorted(r.row_number_ for r in got) == list(range(300))
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r.doc_id or 0, r.text or "") for r in hot.collect())


def test_shards_of_equal_rows(hot):
    got = sharding.feistel_shards(hot, 16).collect()
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (18, 19)
    assert len({r.shard for r in got if r.doc_id is None}) == 16


def test_packing_of_equal_rows(hot):
    got = packing.pack_documents(hot, capacity=64, cache_words=5).collect()
    assert sum(r.doc_id is None for r in got) == 100 and sum(r.doc_id == 1 for r in got) == 99
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(r.length for r in got) // 64) + 1
