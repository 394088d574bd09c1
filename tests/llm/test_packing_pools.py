"""Pieces that don't pair: what is left is pooled by rows."""

from __future__ import annotations

from caselake.llm import packing


def test_pools_are_cut_by_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, 0, 2100, i) for i in range(300)], packing.PIECES)
    groups, made = [], packing._packed
    monkeypatch.setattr(packing, "_packed", lambda some, shards, *rest: groups.append(shards) or made(some, shards, *rest))
    got = packing.pack(rows, shard_rows=20).collect()
    assert groups == [15, 4] and len(got) == len({r["sequence_id"] for r in got}) == 300 and all(r["offset"] == 0 for r in got)
