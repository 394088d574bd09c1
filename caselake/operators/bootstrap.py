"""Bootstrap sums: keyed Poisson weights and what they weigh, summed inside the task that draws them, so no row is copied for a replicate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rotations and constants of MD5, as RFC 1321 has them.
_TURNS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Draws that are made at once, and the longest key of one MD5 block.
_AT_ONCE, _BLOCK = 8192, 55


def _md5_head(words: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """The first 64 bits of the MD5 of one-block messages, given as 16 words that spread to ``shape``."""
    u = np.uint32
    a, b, c, d = (np.full(shape, v, u) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(shape, u), np.empty(shape, u)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        word = words[g]
        if isinstance(word, int):
            f += u((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += u(_SINES[i])
        np.left_shift(f, u(_TURNS[i]), out=t)
        np.right_shift(f, u(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = ((x + u(v)).byteswap().astype(np.uint64) for x, v in ((a, 0x67452301), (b, 0xEFCDAB89)))
    return first << np.uint64(32) | second


def draws(seed: str, replicates: Sequence[int], keys: Sequence[bytes]) -> np.ndarray:
    """(replicate, key): the first 13 hex digits of md5('seed:replicate:key') as a whole number. Replicates have as many digits as each other, and so have keys."""
    heads = [f"{seed}:{g}:".encode() for g in replicates]
    at, end = len(heads[0]), len(heads[0]) + len(keys[0])
    if end > _BLOCK:
        return np.array([[int(hashlib.md5(h + k).hexdigest()[:13], 16) for k in keys] for h in heads], np.uint64)
    mine, other = np.zeros((len(keys), 64), np.uint8), np.zeros((len(heads), 64), np.uint8)
    mine[:, at:end] = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    mine[:, end], mine[:, 56:58] = 0x80, (end * 8 % 256, end * 8 // 256)
    other[:, :at] = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), -1)
    mine, other = np.ascontiguousarray(mine.view("<u4").T), np.ascontiguousarray(other.view("<u4").T)
    words: list[np.ndarray | int] = []
    for m, o in zip(mine, other, strict=True):
        one = (m == m[0]).all() and (o == o[0]).all()
        words.append(int(m[0] | o[0]) if one else m[None, :] if not o.any() else o[:, None] | m[None, :])
    return _md5_head(words, (len(heads), len(keys))) >> np.uint64(12)


def weighted_sums(rows: DataFrame, key: str, values: Sequence[str], replicates: int, seed: str, cumulative: Sequence[float]) -> DataFrame:
    """(replicate, w, values): for replicates 1 to ``replicates`` the sum of the weights and of weight x value over the rows.

    A row's weight is how many of ``cumulative`` its draw in [0, 1) reaches: u = 13 hex digits of md5('seed:replicate:key') / 2^52. A row of
    weight 0 is no part of a replicate, null values are left out of their sum, and a replicate without rows isn't there. Rows are dealt
    evenly; each task sends a row for each replicate.
    """
    steps = [np.uint64(math.ceil(c * 2**52)) for c in cumulative]
    groups = [list(range(lo, min(10 * lo, replicates + 1))) for lo in (10**k for k in range(len(str(replicates))))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((replicates, 1 + len(values)))
        for batch in batches:
            keys = np.array([k.encode() for k in batch.column(0).to_pylist()], object)
            given = np.column_stack([np.ones(len(keys)), *[c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            size = np.array([len(k) for k in keys], int)
            for length in np.unique(size):
                for part in np.array_split(ids := np.flatnonzero(size == length), -(-len(ids) // _AT_ONCE)):
                    what, many = given[part], max(1, _AT_ONCE // len(part))
                    odd = ~np.isfinite(what).all()
                    for group in groups:
                        for lo in range(0, len(group), many):
                            some = group[lo : lo + many]
                            u = draws(seed, some, list(keys[part]))
                            w = np.zeros(u.shape)
                            for s in steps:
                                w += u >= s
                            out[some[0] - 1 : some[-1]] += np.array([(x[x > 0, None] * what[x > 0]).sum(axis=0) for x in w]) if odd else w @ what
        yield pa.RecordBatch.from_arrays([pa.array(range(1, replicates + 1), pa.int64()), *[pa.array(c) for c in out.T]], names=["replicate", "w", *values])

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    given = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string"), *[F.col(v).cast("double") for v in values]).repartition(tasks)
    made = given.mapInArrow(summed, "replicate long, w double, " + ", ".join(f"{v} double" for v in values))
    return made.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("w", *values)]).where("w > 0")
