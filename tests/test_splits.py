"""Splits by class and choices by bins, with the errors that the small and the odd give."""

from __future__ import annotations

import pytest

from caselake.operators import splits


def rows(spark, labels):
    return spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "idx long, valid int").repartition(3)


def test_class_split(spark):
    labels = [int(i % 5 == 0) for i in range(1000)]
    got = {r["idx"]: (r["valid"], r["part"]) for r in splits.split_classes(rows(spark, labels), "idx", "valid", prefix=253).collect()}
    parts = {p: [i for i, (_, q) in got.items() if q == p] for p in ("train", "validation", "test")}
    assert {p: len(x) for p, x in parts.items()} == {"train": 600, "validation": 200, "test": 200} and min(parts["test"]) >= 253 and len(got) == 1000
    assert all(got[i][0] == c for i, c in enumerate(labels))
    assert [sum(labels[i] for i in parts[p]) for p in ("test", "validation")] == [40, 40]
    again = {r["idx"]: r["part"] for r in splits.split_classes(rows(spark, labels).coalesce(1), "idx", "valid", prefix=253).collect()}
    assert again == {i: p for i, (_, p) in got.items()}


@pytest.mark.parametrize(("labels", "how", "message"), [
    ([0, 1], {}, "At least three"), ([1] * 9, {}, "two classes"), ([0, 1] * 9, {"prefix": 15}, "not enough new"), ([0, 1] * 9, {"prefix": 99}, "outside"), ([0, 1] * 9, {"test_ratio": 1.0}, "between 0 and 1"),
    ([0] * 20 + [1] * 20, {"prefix": 19}, "new samples do not contain"), ([0, 1, None, 1], {}, "null"), ([0] * 3 + [1] * 30, {"test_ratio": 0.5}, "development data do not")])
def test_split_errors(spark, labels, how, message):
    with pytest.raises(ValueError, match=message):
        splits.split_classes(rows(spark, labels), "idx", "valid", **how)


def test_quotas():
    assert splits.quotas([5, 3, 2], 5) == [3, 1, 1] and splits.quotas([1, 1, 1], 2) == [1, 1, 0] and sum(splits.quotas([7, 11, 13], 17)) == 17


def candidates(spark, per_bin):
    return spark.createDataFrame([(f"c{k}-{i}", 220.0 + 40 * k + i, 0.3 + 0.05 * i) for k in range(2) for i in range(per_bin)] + [("low", 1.0, 0.6), ("null", None, 0.6)], "candidate_id string, steel double, p double")


def test_choice_by_bins(spark):
    got = splits.choose_by_bins(candidates(spark, 12), "candidate_id", "steel", "p", (220.0, 260.0, 300.0), 10, 0.6, 0.1, protected=0.2).collect()
    assert len({r["candidate_id"] for r in got}) == 10 and [sum(r["bin"] == k for r in got) for k in (0, 1)] == [5, 5]
    assert sum(r["role"] == "protected_evaluation" for r in got) == 2 and sum(r["near"] for r in got) >= 8 and sorted(r["place"] for r in got) == sorted([*range(5)] * 2)
    with pytest.raises(RuntimeError, match="Insufficient candidates"):
        splits.choose_by_bins(candidates(spark, 2), "candidate_id", "steel", "p", (220.0, 260.0, 300.0), 10, 0.6, 0.2)
    with pytest.raises(ValueError, match="strictly increasing"):
        splits.choose_by_bins(candidates(spark, 2), "candidate_id", "steel", "p", (220.0, 220.0), 10, 0.6, 0.2)
    with pytest.raises(RuntimeError, match="Insufficient"):
        splits.choose_by_bins(candidates(spark, 2).limit(0), "candidate_id", "steel", "p", (220.0, 260.0), 1, 0.6, 0.2)
