"""Phrases against a loop in plain Python, with nulls, repeats, padding, hot phrases, ties and empty tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from caselake.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, w1 string, _cell int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], SCHEMA)


def counted(rows):
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in (1, 2, 3):
                f.update((lang or "und", w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, least, percent, top):
    f = counted(rows)
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c * (len(w) == 1)
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            s, k = min(((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w)))
            longer = [c for (g, x), c in f.items() if g == lang and len(w) == 2 and len(x) == 3 and c >= least and w in (x[:2], x[1:])]
            if not any(100 * c >= percent * a for c in longer):
                found.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1): (p.decode(), -a, left, r, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, left, r) in enumerate(sorted(all_)[:top])}


def corpus(seed, n=260):
    rng = np.random.default_rng(seed)
    words = [f"{c}{k}" for c in "aBé" for k in range(9)]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda: "".join(w + str(rng.choice([" ", " ", "\t ", ". ", "\n", ",", "\x0b"])) for w in rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum()))
    rows = [(int(i), text(), [None, "und", "en", "fr"][i % 4]) for i in range(n)]
    rows += [(1000 + i, "New York City is hot", "en") for i in range(n // 3)] + [(7, "x\x00y   z  x\x00y", "en")] * 12
    return rows + [(None, None, None), (None, "", "xx"), (3, "lone word", "zz"), (4, " . ! ", "none"), (5, "tick tock " * 2000, "fr"), (6, "only once here " * 9, "fr")]


@pytest.mark.parametrize(("how", "seed"), [({}, 1), ({"least": 3, "top": 17, "percent": 80, "cell_bytes": 900}, 2), ({"least": 300, "cell_bytes": 2000}, 3)])
def test_same_as_counting_every_phrase(spark, how, seed):
    rows = corpus(seed)
    got = phrases.collocations(docs(spark, rows), **how).collect()
    assert {(r["lang"], r["rank"]): tuple(r)[2:] for r in got} == brute(rows, how.get("least", 10), how.get("percent", 50), how.get("top", 2000))


def test_counts_of_all_lengths(spark):
    rows = corpus(4)
    got = phrases.phrase_counts(docs(spark, rows), least=5, cell_bytes=1000).collect()
    have = {(r["lang"], tuple(bytes(r[w]).decode() for w in ("w1", "w2", "w3") if r[w] is not None)): r["f"] for r in got if r["words"]}
    assert have == {k: c for k, c in counted(rows).items() if c >= 5}
    assert len(have) == sum(r["words"] > 0 for r in got)


def test_nothing(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None), (2, " ", "en")])).count() == 0
