"""Mixing against a loop in plain Python, with nulls, repeats, one hot source, sources without words and empty tables."""

from __future__ import annotations

from fractions import Fraction

import pytest

from caselake.llm import mixing

SCHEMA = "doc_id long, text string, source string, _part int, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)


def targets(sizes, weights, percent, most):
    """Shares by weight; what is over ``most`` sizes goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left, free = {}, Fraction(percent * sum(sizes.values()), 100), list(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            return full | {s: w[s] * level for s in free}
        for s in over:
            full[s] = Fraction(most * sizes[s])
            left -= full[s]
        free = [s for s in free if s not in full]
    return full


ROWS = [(i, "w " * (i % 7), "big") for i in range(60)] + [(100 + i, "one two\tthree\nfour", s) for i, s in enumerate(["é", "zz", "Z", None, None, "a"])] + [(200, None, "nothing"), (200, "", "nothing"), (None, "some words", "a"), (5, "w w w", "big"), (5, "w w w", "big"), (300, "x " * 5000, "long")]


@pytest.mark.parametrize(("weights", "percent", "most"), [((3, 1, 2), 150, 2), ((1,), 40, 1), ((5, 1), 290, 3)])
def test_mix(spark, weights, percent, most):
    got = mixing.mix(docs(spark, ROWS), weights=weights, percent=percent, most=most).collect()
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes, weights, percent, most)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(i), str(s), len((t or "").split())) for i, t, s in ROWS)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= most * r["size"] and len(r["positions"]) == -(-r["taken"] // max(1, r["size"]))
        assert all(0 <= p < 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    firsts = [r["first_position"] for r in got if r["first_position"] is not None]
    assert firsts == sorted(firsts) and len(firsts) == sum(r["taken"] > 0 for r in got)


def test_demand_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(4000)]
    mixed = mixing.mix(docs(spark, rows), weights=(1, 1), percent=100, most=1, schedules=(((0.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (0.25, 2.0), (1.0, 2.0))))
    for source, share in (("a", lambda t: 1 - (1 - t) ** 2), ("b", lambda t: (4 * t * t if t < 0.25 else 0.25 + 2 * (t - 0.25)) / 1.75)):
        at = sorted(r["first_position"] for r in mixed.where(f"source = '{source}'").collect())
        assert all(abs(share(t) - k / 2000) < 1e-9 for k, t in enumerate(at))
    order = mixing.visits(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and sum(r["words"] for r in order) == 40000


def test_reruns_agree_and_edges(spark):
    once, again = (sorted(map(repr, mixing.mix(docs(spark, ROWS).repartition(k)).collect())) for k in (1, 3))
    assert once == again
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.visits(mixing.mix(docs(spark, []))).count() == 0
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs(spark, [(1, None, None), (2, " ", "a")])).collect()] == [(0, 0.0)] * 2
    with pytest.raises(ValueError, match="rising"):
        mixing.inverse(((0.0, 1.0), (0.0, 2.0), (1.0, 1.0)), "u")
