"""Best-fit packing: a grouping genetic algorithm packs pieces of documents into sequences of a fixed length.

Pieces are dealt to shards of about ``shard_rows`` by a hash, so no group grows with the corpus or with a
key. A shard is packed on several islands: each starts from best-fit over differently shaken orders, breeds by
injecting whole well-filled sequences of one parent into the other, dropping the other's sequences that share
a piece with them, exchanging displaced pieces for smaller ones where that fills a sequence better, and best-fitting the
rest; elites migrate to the next island through a shuffle between epochs. Every island breeds at least once; it stops
when all room but a 64th of a sequence is in one sequence, or after some children in a row that are no better. The best
of all is never lost. The sequences that stay under-filled in all shards are pooled and packed once more.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_of, count_for, cut, parts, small_batches
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each document's ids (its text's, then ``end_id``) into pieces of at most ``capacity``.

    Null and empty texts give one piece of the end id alone; null ids and repeated rows are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc, got in zip(ids, coder.encode(b.column(1)), strict=True):
                got = np.append(got, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(got), capacity)):
                    some = got[at : at + capacity]
                    rows.append((doc, k, at, len(some), zlib.crc32(some.tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None, left: list[int] | None = None) -> list[list[int]]:
    """Put each item of ``order`` into the fullest sequence that has room, or a new one."""
    bins = [list(b) for b in bins or []]
    room: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        room.setdefault(left[k] if left else capacity - sum(lengths[i] for i in b), []).append(k)
    sizes = sorted(room)
    for i in order:
        need = lengths[i]
        at = bisect_left(sizes, need)
        if at == len(sizes):
            bins.append([i])
            k, rest = len(bins) - 1, capacity - need
        else:
            size = sizes[at]
            k = room[size].pop()
            if not room[size]:
                del room[size], sizes[at]
            bins[k].append(i)
            rest = size - need
        if rest not in room:
            room[rest] = []
            insort(sizes, rest)
        room[rest].append(k)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first; among equals the more uneven filling, which leaves one sequence to empty."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(bins: list[list[int]], free: list[int], lengths: list[int], capacity: int, rng: np.random.Generator, width: int = 48, most: int = 8, passes: int = 12) -> tuple[list[list[int]], list[int]]:
    """Trade up to two pieces of a sequence for up to two of ``free`` that fill it better: what grows comes in, what is smaller comes out.

    Each pass looks at ``width`` free pieces and ``most`` pieces of each sequence with room, drawn anew. Returns the sequences and what is free then.
    """
    bins, free, size = list(bins), list(free), np.asarray(lengths, np.int64)
    room = capacity - np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    x, y = (np.append(0, t) for t in np.triu_indices(most + 1, 1))  # column 0 stands for no piece
    for _ in range(passes):
        at = np.flatnonzero(room > 0)
        if not len(at) or not free:
            break
        some = np.array(free)[rng.permutation(len(free))[:width]]
        i, j = np.triu_indices(len(some), 1)
        come = np.concatenate([size[some], size[some][i] + size[some][j]])
        order = np.argsort(come, kind="stable")
        come, pairs = come[order], np.stack([np.append(np.arange(len(some)), i), np.append(np.full(len(some), -1), j)], 1)[order]
        member = np.full((len(at), most + 1), -1)
        for n, k in enumerate(at):
            b = bins[k]
            member[n, 1 : 1 + min(most, len(b))] = b if len(b) <= most else rng.choice(b, most, replace=False)
        weight = np.where(member >= 0, size[member], 2 * capacity)
        weight[:, 0] = 0
        gone = weight[:, x] + weight[:, y]
        limit = gone + room[at][:, None]
        found = np.searchsorted(come, limit, "right") - 1
        got = np.append(come, 0)[found]  # place -1 is the 0
        left = np.where((gone <= capacity) & (got > gone), limit - got, capacity)
        best = np.argmin(left, 1)
        left, found, used, out = left[np.arange(len(at)), best], pairs[found[np.arange(len(at)), best]].tolist(), set(), []
        for n in np.argsort(left, kind="stable").tolist():
            if left[n] == capacity or len(used) == len(some):
                break
            put = [t for t in found[n] if t >= 0]
            if used.isdisjoint(put):
                used.update(put)
                k, drop = at[n], {int(member[n, c]) for c in (x[best[n]], y[best[n]]) if c}
                out += drop
                bins[k] = [t for t in bins[k] if t not in drop] + some[put].tolist()
                room[k] = left[n]
        if not used:
            break
        taken = set(some[list(used)].tolist())
        free = [t for t in free if t not in taken] + out
    return bins, free


def breed(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Child of two packings: a share of a's well-filled sequences whole, a half to a 64th, b's others without duplicates and without its emptiest, the displaced exchanged and best-fitted."""
    full = [s for s in a if sum(lengths[i] for i in s) >= capacity - capacity // 64] or a
    kept = [full[k] for k in np.flatnonzero(rng.random(len(full)) < 0.5 ** rng.integers(1, 7))]
    taken = {i for s in kept for i in s}
    others, displaced = [], []
    for s in b:
        if any(i in taken for i in s):
            displaced += [i for i in s if i not in taken]
        else:
            others.append(s)
    others.sort(key=lambda s: sum(lengths[i] for i in s))
    emptied = min(len(others), 1 + int(rng.integers(0, 1 + len(others) // 32)))
    displaced += [i for s in others[:emptied] for i in s]
    made, displaced = exchange(kept + others[emptied:], displaced, lengths, capacity, rng)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, capacity, made)


def settled(bins: list[list[int]], lengths: list[int], capacity: int) -> bool:
    """Next to nothing is left to gain: all room but a 64th of a sequence is in one of them."""
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    return sum(room) - max(room, default=0) <= capacity // 64


def evolve(lengths: list[int], capacity: int, elites: list[list[list[int]]], seed: int, population: int, generations: int, patience: int = 6) -> list[list[int]]:
    """The best packing after ``generations`` children, or once it is settled or ``patience`` children in a row haven't bettered it."""
    rng = np.random.default_rng(seed)
    base = np.array(lengths)
    score = lambda p: fitness(p, lengths, capacity)
    pool = [(score(p), p) for p in elites]
    for k in range(max(0, population - len(pool))):
        shaken = base * (1 + (0.02 + 0.05 * k) * rng.random(len(base)))
        made = best_fit(lengths, np.argsort(-shaken, kind="stable").tolist(), capacity)
        pool.append((score(made), made))
    pool.sort(key=lambda t: t[0])
    stale = 0
    for k in range(generations):
        if (k and settled(pool[0][1], lengths, capacity)) or len(pool) < 2 or stale >= patience:
            break
        x, y = rng.choice(len(pool), 2, replace=False)
        child = breed(pool[x][1], pool[y][1], lengths, capacity, rng)
        now = score(child)
        stale = 0 if now < pool[0][0] else stale + 1
        if all(now != t[0] for t in pool):
            pool = sorted([*pool, (now, child)], key=lambda t: t[0])[: max(2, population)]
    return pool[0][1]


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)


def _bins(blob: bytes) -> list[list[int]]:
    at = np.frombuffer(blob, np.int32)
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


def _blob(bins: list[list[int]], n: int) -> bytes:
    at = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        at[b] = k
    return blob_of(at)


def _packed(some: DataFrame, shards: int, capacity: int, islands: int, epochs: int, population: int, generations: int, salt: int) -> DataFrame:
    """Pieces with their shard, the number of their sequence in it, and its filling."""
    keyed = some.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "start", "ids_crc32"), F.lit(shards)))
    spread = keyed.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    state = "shard long, island int, bins int, fill double, blob binary"

    def island(key, pdf: pd.DataFrame, elites: pd.DataFrame | None, epoch: int) -> pd.DataFrame:
        lengths = _order(pdf)["length"].tolist()
        known = [_bins(x) for x in elites["blob"]] if elites is not None else []
        best = evolve(lengths, capacity, known, hash((key[0], key[1], epoch)) & 0x7FFFFFFF, population, generations)
        n, fill = fitness(best, lengths, capacity)
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [n], "fill": [fill], "blob": [_blob(best, len(lengths))]})

    def later(epoch: int):
        return lambda key, pdf, elites: island(key, pdf, elites, epoch)

    elites = spread.groupBy("shard", "island").applyInPandas(lambda key, pdf: island(key, pdf, None, 0), state)
    for epoch in range(1, epochs):
        moved = elites.withColumn("island", F.explode(F.array("island", F.expr(f"cast((island + 1) % {islands} as int)"))))
        elites = spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(later(epoch), state)
    best = elites.groupBy("shard").agg(F.min_by("blob", F.struct("bins", "fill", "island")).alias("blob"))

    def place(key, pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        pdf = _order(pdf)
        pdf["bin"] = np.frombuffer(chosen["blob"].iloc[0], np.int32)
        pdf["fill"] = pdf.groupby("bin")["length"].transform("sum")
        pdf = pdf.sort_values("bin", kind="stable")
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        return pdf

    return keyed.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, f"{PIECES}, shard long, bin int, fill long, offset long")


def pack(piece_rows: DataFrame, capacity: int = 4096, shard_rows: int = 3000, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 60) -> DataFrame:
    """Place each piece: ``sequence_id`` and ``offset`` (gapless from 0), as few sequences as the search finds.

    The pieces are written to the shared folder once. No pieces give no rows; ties in length go by
    doc_id, piece and start; repeated rows are packed as rows of their own.
    """
    spark = piece_rows.sparkSession
    rows = cut(piece_rows)
    n = rows.count()
    shards = count_for(n, shard_rows)
    first = cut(_packed(rows, shards, capacity, islands, epochs, population, generations, 1))
    full = "fill >= {}".format(capacity - capacity // 50)
    done = first.where(full).withColumn("sequence_id", F.col("bin").cast("long") * (2 * shards) + F.col("shard"))
    rest = first.where(f"not ({full})").drop("shard", "bin", "fill", "offset")
    pools = max(count_for(shards, 200), count_for(rest.count(), 4 * shard_rows))  # by rows too: where few pieces pair, much is left
    pooled = _packed(rest, pools, capacity, islands, epochs, population, generations, 2)
    pooled = pooled.withColumn("sequence_id", F.col("bin").cast("long") * (2 * shards) + F.col("shard") + shards)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return done.select(*keep).union(pooled.select(*keep)).repartition(parts(spark))
