"""Toxicity: character n-gram vectors, averaged into a linear softmax and trained with it in numpy.

A word is the mean of the vectors of its character n-grams and of its own; a text is the mean of its words.
A misspelling that was never seen shares n-grams, and so its vectors, with the word it misspells. Vectors and
softmax are trained together on a bounded sample; at scoring, each word's part of the logit is one number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, Grown, small_batches

EDGES = ".,;:!?|\"'()[]{}«»…-–"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def grams(words: list[str], buckets: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of <word>, and of the word whole, all words after one another; and how many each has.

    Signs around a word don't count. Very long words are taken whole.
    """
    marked = [f"<{w.strip(EDGES)}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))
    owner = np.repeat(np.arange(len(marked)), sizes)
    mult = np.uint64(0x9E3779B97F4A7C15)
    mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    with np.errstate(over="ignore"):
        own, at = [], []
        h = np.zeros(len(chars), np.uint64)
        for n in range(1, high + 1):
            h = h[: len(chars) - n + 1] * mult + chars[n - 1 :] + np.uint64(1)
            if n >= low:
                fit = np.flatnonzero(left[: len(h)] >= n)
                own.append(owner[fit])
                at.append(mix(h[fit] + np.uint64(n)) % np.uint64(buckets))
        power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
        power[1:] = np.cumprod(np.full(len(power) - 1, mult, np.uint64))
        if len(chars):
            own.append(np.arange(len(marked)))
            at.append(mix(np.add.reduceat((chars + np.uint64(1)) * power[left - 1], ends - sizes)) % np.uint64(buckets))
    own, at = (np.concatenate(own), np.concatenate(at)) if own else (np.zeros(0, np.int64),) * 2
    order = np.argsort(own, kind="stable")
    return at[order].astype(np.int64), np.bincount(own, minlength=len(marked))


def train(texts: list[str | None], labels: np.ndarray, buckets: int = 1 << 16, dim: int = 4, steps: int = 80, rate: float = 0.1, decay: float = 1e-6, seed: int = 7, min_docs: int = 3) -> tuple[np.ndarray, float]:
    """Each bucket's part of the logit and the bias, from joint training of vectors and softmax with Adam over the whole sample.

    Words of fewer than ``min_docs`` sample documents teach nothing, as they tell single documents apart; they
    still count in the mean's divisor, and are scored by their n-grams.
    """
    codes = Codes()
    docs = [np.unique(codes.of(words_of(t)), return_counts=True) for t in texts]
    seen = np.bincount(np.concatenate([d[0] for d in docs]), minlength=len(codes)) if len(codes) else np.zeros(0, int)
    kept = np.flatnonzero(seen >= min_docs)
    renamed = np.cumsum(seen >= min_docs) - 1
    docs = [(renamed[c[m]], n[m], n.sum()) for c, n in docs for m in [seen[c] >= min_docs]]
    if not len(kept) or len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return np.zeros(buckets, np.float32), float(np.log(share / (1 - share)))
    names = list(codes)
    bucket, per_word = grams([names[k] for k in kept], buckets)
    used, slot = np.unique(bucket, return_inverse=True)
    word = np.concatenate([d[0] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    share = np.concatenate([d[1] / d[2] for d in docs if len(d[0])]).astype(np.float32)
    to_gram = np.repeat(np.arange(len(per_word)), per_word)
    total = lambda at, rows, n: np.stack([np.bincount(at, rows[:, k], n) for k in range(dim)], axis=1).astype(np.float32)
    inv = (1 / per_word).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((len(used), dim)) / dim).astype(np.float32)
    w, b = (rng.standard_normal((dim, 2)) / dim).astype(np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[labels]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for t in range(1, steps + 1):
        words = total(to_gram, e[slot], len(per_word)) * inv
        x = total(doc, words[word] * share[:, None], len(docs))
        z = x @ w * 10 + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        err = (p - y) / len(docs)
        gx = err @ w.T * 10
        by_word = total(word, gx[doc] * share[:, None], len(per_word)) * inv
        ge = total(slot, by_word[to_gram], len(used)) + decay * e
        for v, g, m in ((e, ge, state[0]), (w, x.T @ err * 10, state[1]), (b, err.sum(axis=0), state[2])):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            v -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(buckets, np.float32)
    out[used] = e @ (w[:, 1] - w[:, 0]) * 10
    return out, float(b[1] - b[0])


def fit(labelled: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 3000, **how) -> tuple[np.ndarray, float]:
    """Train on at most ``sample_docs`` documents of each label, those of smallest hash of the id, and set the bias
    to the labels' shares in the whole table.

    Rows whose id or label is null teach nothing; a document labelled twice counts with its larger label.
    """
    rows = labelled.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    chosen = [rows.where(F.col("y") == k).orderBy(F.xxhash64("i"), "i").limit(sample_docs) for k in (0, 1)]
    sample = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen[0].union(chosen[1])), "i").select("i", "t", "y").toArrow()
    sample = sample.sort_by([("i", "ascending"), ("t", "ascending")])
    shares = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    y = np.array(sample["y"].to_pylist(), dtype=np.int64)
    parts, bias = train(sample["t"].to_pylist(), y, **how)
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    if ones and zeros:  # the sample has more of the rarer label than the table
        bias += float(np.log(shares[1] / shares[0]) - np.log(ones / zeros))
    return parts, bias


def score(docs: DataFrame, parts: np.ndarray, bias: float, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with column ``out`` (0 to 1). Null and empty texts get the model's bias alone; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(parts)
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values = Codes(), Grown()
        for b in batches:
            if len(codes) > 800_000:
                codes, values = Codes(), Grown()
            got = [codes.of(words_of(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            for k in range(0, len(codes.new), 20_000):
                at, n = grams(codes.new[k : k + 20_000], len(model.value))
                values.add(np.add.reduceat(model.value[at].astype(np.float64), np.cumsum(n) - n) / n)
            codes.new = []
            z = np.array([values.a[c].mean() if len(c) else 0.0 for c in got]) + bias
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=[*b.schema.names[:-1], out])

    return kept.select("*", docs[text].cast("string").alias(f"_text_{uuid.uuid4().hex}")).mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)
