"""The search packs what best-fit can't: pieces that fill sequences exactly, in threes alone."""

from __future__ import annotations

import numpy as np

from caselake.llm import packing


def test_threes_are_found(spark):
    rng = np.random.default_rng(4)
    two = rng.integers(1100, 1500, (100, 2))
    lengths = rng.permutation(np.append(two, 4096 - two.sum(1))).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    by = {}
    for r in packing.pack(rows).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert sorted((d, n) for s in by.values() for _, n, d in s) == list(enumerate(lengths))
    for s in by.values():
        ends = np.cumsum([n for _, n, _ in sorted(s)])
        assert [o for o, _, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(by) <= 102, len(by)  # 100 at least


def test_exchange_loses_nothing_and_fills():
    lengths = [60, 30, 5, 40, 35, 9, 70]
    bins, free = packing.exchange([[0, 1], [3, 5]], [2, 4, 6], lengths, 100, np.random.default_rng(0))
    assert sorted([i for b in bins for i in b] + free) == list(range(7))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert sum(fills) > 139 and max(fills) <= 100
