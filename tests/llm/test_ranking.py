"""Ranked search against a loop in plain Python, with nulls, ties, groups of copies, repeats and empty tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from caselake.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(ranking.UPPER, ranking.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, many = sum(n for *_, n in bags), len(bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, words in asked.items():
        found = []
        for i, b, n in bags:
            m = 10 + 90 * n * many // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in words if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        for k, (s, *_, i) in enumerate(sorted(found)[:top]):
            out[item, k + 1] = (i, -s)
    return out


def rows(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, part int")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = ranking.search(d, q, **how).collect()
    out = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got}
    assert len(out) == len(got)
    return out


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "Über9", "99"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda: " -".join(rng.choice(words, int(rng.integers(0, 40)), p=p / p.sum()))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[3][1] + " same passage") for i in range(n // 3)]  # a third are copies
    docs += [(5, docs[9][1]), (5, docs[9][1]), (None, docs[4][1]), (None, "w1"), (9001, None), (9002, "?!"), (9003, ""), (9004, "w1 w2 " * 3000)]
    return docs, [(k, text()) for k in range(12)] + [(3, "w1 w50"), (None, "W1, w2"), (77, None), (78, "never-seen"), (79, "same passage")]


@pytest.mark.parametrize(("how", "leaf"), [({}, 4), ({"block_terms": 20, "top": 3}, 32)])
def test_same_as_scoring_every_document(spark, monkeypatch, how, leaf):
    monkeypatch.setattr(ranking, "LEAF", leaf)
    docs, items = corpus(300, 1)
    assert rows(spark, docs, items, **how) == brute(docs, items, how.get("top", 10))


def test_nothing_to_find(spark):
    docs, items = corpus(12, 2)
    assert rows(spark, [], items) == rows(spark, docs, []) == rows(spark, [(1, None), (2, "")], items) == rows(spark, [(1, "a")], [(1, "b")]) == {}


def test_walks_leave_out_most_leaves():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.zipf(1.5, 30)[:20] % 400) for _ in range(4000)]
    order = np.argsort(-np.bincount(np.concatenate(lists), minlength=400), kind="stable")
    place = np.argsort(order)
    lists = [np.sort(place[x]) for x in lists]
    trie = ranking.Trie(np.arange(4000), np.full(4000, 100), lists, [np.ones(len(x), np.int64) for x in lists], 400)
    leaves = [k for k, c in enumerate(trie.children) if not c]
    assert sorted(np.concatenate([np.arange(*trie.span[k]) for k in leaves]).tolist()) == list(range(4000))
    seen, best, offer = [], ranking.Best(10), ranking.Best.offer
    best.offer = lambda s, i: (seen.append(len(i)), offer(best, s, i))
    asked, weights = place[[2, 150, 300]], np.array([500, 7000, 8000])
    trie.search(asked, weights, np.zeros(400, np.int64), best)
    every = sorted((-sum(int(w) * int(ranking.score(np.int64(1), np.int64(100))) for t, w in zip(asked, weights, strict=True) if t in x), int(d)) for d, x in zip(trie.ids, [trie.term[a:b] for a, b in zip(trie.ptr, trie.ptr[1:], strict=False)], strict=True))
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == every[:10]
    assert sum(seen) < 2500
