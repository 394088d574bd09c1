"""SentencePiece encoding and decoding: the N best segmentations of whole texts.

A text is cut where no piece of the vocabulary can cross: between two characters that stand side by side in no piece.
Viterbi passes over many units at once give each unit's best path and what its second best loses. The N best of a whole text combine its units'
lists: only the N - 1 units whose second best comes first (by its loss, then the earlier unit) can differ from the best path, and only those are
searched: a forward Viterbi pass gives the best score up to every position, which is an exact heuristic for the A-star search that
then goes backward over the lattice, from the unit's end. Each position is taken at most N times, as no later path through it can be among the N best.
Of equal scores in a unit, the segmentation with the longer first piece comes first, then the longer second piece, and
so on; of equal sums, the one whose first unit off its best path comes later, then the one with the better entry there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, ragged, small_batches
from .words import BASE, Known, mixed, span_hashes

MARK = "▁"
#: A character that no piece covers costs this much more than the worst piece, and is written in byte pieces.
PENALTY = 10.0
#: Longer units are searched one by one.
SHORT = 64


def window_hashes(value: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``span_hashes`` of spans of one length."""
    h = value[at].copy()
    with np.errstate(over="ignore"):
        for k in range(1, length):
            h += value[at + k] * np.uint64(pow(BASE, k, 1 << 64))
    return mixed(h)


class Lattice:
    """Vocabulary of a sentencepiece model: scores, pieces and ids."""

    def __init__(self, path: str, n_best: int = 4) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best, self.piece, self.byte, self.id, self.score = n_best, [], {}, {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.piece.append(p)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id[p] = i
        self.byte_value = {i: b for b, i in self.byte.items()}
        normal = [s for p, s in zip(self.piece, self.score, strict=True) if p in self.id and s > -1e8]
        self.worst = min(normal, default=0.0) - PENALTY
        self.longest = max(map(len, self.id), default=1)
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in pairs for c in pair})
        self.char, self.chars = np.zeros(0x110000, np.int32), len(chars) + 1
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros(self.chars**2, bool)
        self.joined[[self.char[ord(a)] * self.chars + self.char[ord(b)] for a, b in pairs]] = True
        self.raw = [bytes([self.byte_value[i]]) if i in self.byte_value else p.encode() for i, p in enumerate(self.piece)]
        known = [p for p in self.id if len(p) <= SHORT]
        points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))
        h = span_hashes(mixed(points.astype(np.uint64) + np.uint64(1)), np.r_[0, ends[:-1]], ends) if known else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.piece_hash, self.piece_id = h[order], np.fromiter((self.id[p] for p in known), np.int64, len(known))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.costs = -np.array(self.score)
        self.reach = {}
        for p in self.id:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one, a mark for each space and one before each text that isn't empty, as the model's own normaliser adds;
        first and last character and hash of each unit; and how many units each text has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.char[points]
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        new = np.ones(len(points) + 1, bool)
        new[1:-1] = ~self.joined[c[:-1] * self.chars + c[1:]]
        new[ends] = True
        at = np.flatnonzero(new) if len(points) else np.zeros(1, np.int64)
        first, last = at[:-1], at[1:]
        h = span_hashes(mixed(points.astype(np.uint64) + np.uint64(1)), first, last)
        return whole, first, last, h, np.diff(np.searchsorted(first, np.r_[0, ends]))

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end position, (start, id or -1, score)."""
        get, score, n = self.id.get, self.score, len(unit)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            one = get(unit[i])
            out[i + 1].append((i, one, score[one]) if one is not None else (i, -1, self.worst))
            for j in range(i + 2, min(n, i + self.reach.get(unit[i], 1)) + 1):
                p = get(unit[i:j])
                if p is not None:
                    out[j].append((i, p, score[p]))
        return out

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For many units, given as rows of code points with zeros after them: best score, loss of the second best, ids of the best path of all and how many each
        has; and which units have a character that no piece covers, whose values count for nothing."""
        units, most = points.shape
        size, flat = (points > 0).sum(axis=1), mixed(points.ravel().astype(np.uint64) + np.uint64(1))
        left = size[:, None] - np.arange(most)
        edges = []
        for length in range(1, min(most, self.longest) + 1):
            at = np.flatnonzero(left.ravel() >= length)
            for x in range(0, len(at), 1 << 19):
                some = at[x : x + (1 << 19)]
                h = window_hashes(flat, some, length)
                some, h = (c[self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]] for c in (some, h))
                k = np.minimum(np.searchsorted(self.piece_hash, h), len(self.piece_hash) - 1)
                hit = self.piece_hash[k] == h
                edges.append(np.stack([some[hit] // most, some[hit] % most, some[hit] % most + length, self.piece_id[k[hit]]]))
        u, i, j, p = np.concatenate(edges, axis=1)
        cost = self.costs[p]
        ahead, behind = np.full((units, most + 1), np.inf), np.full((units, most + 1), np.inf)
        ahead[:, 0] = 0
        behind[np.arange(units), size] = 0
        order = np.lexsort((u, j))
        for e in np.split(order, np.searchsorted(j[order], np.arange(2, most + 1))):
            if len(e):
                first = np.flatnonzero(np.r_[True, u[e][1:] != u[e][:-1]])
                ahead[u[e[first]], j[e[0]]] = np.minimum.reduceat(ahead[u[e], i[e]] + cost[e], first)
        chosen = np.full((units, most + 1), -1)
        order = np.lexsort((-j, u, i))  # longer pieces first
        for e in np.split(order, np.searchsorted(i[order], np.arange(1, most)))[::-1]:
            if len(e):
                total = cost[e] + behind[u[e], j[e]]
                first = np.flatnonzero(np.r_[True, u[e][1:] != u[e][:-1]])
                low = np.minimum.reduceat(total, first)
                behind[u[e[first]], i[e[0]]] = low
                least = np.flatnonzero(total == np.repeat(low, np.diff(np.r_[first, len(e)])))
                least = least[np.r_[True, u[e[least]][1:] != u[e[least]][:-1]]]
                chosen[u[e[least]], i[e[0]]] = e[least]
        best = behind[:, 0]
        on, at, row, ids = np.zeros(len(u), bool), np.zeros(units, np.int64), np.flatnonzero(np.isfinite(best)), []
        while len(row):
            e = chosen[row, at[row]]
            on[e] = True
            ids.append(np.stack([row, at[row], p[e]]))
            at[row] = j[e]
            row = row[at[row] < size[row]]
        gap = np.full(units, np.inf)
        with np.errstate(invalid="ignore"):
            np.minimum.at(gap, u[~on], (ahead[u, i] + cost + behind[u, j])[~on])
            gap -= best
        ids = np.concatenate(ids, axis=1) if ids else np.zeros((3, 0), np.int64)
        ids = ids[:, np.lexsort((ids[1], ids[0]))]
        return -best, gap, ids[2].astype(np.int32), np.bincount(ids[0], minlength=units), ~np.isfinite(best)

    def learn(self, whole: str, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second best, ids of the best path of all and how many each has, of units that are slices of a text."""
        score, gap, size, ids = np.zeros(len(lo)), np.full(len(lo), np.inf), np.zeros(len(lo), np.int64), [np.zeros(0, np.int32)] * len(lo)
        points, n = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), hi - lo
        single = [np.flatnonzero(n > SHORT)]
        for top in (8, 16, 32, SHORT):
            some = np.flatnonzero((n <= top) & (n > (top // 2 if top > 8 else 0)))
            for x in range(0, len(some), 1 << 15):
                mine = some[x : x + (1 << 15)]
                rows = np.zeros((len(mine), top), np.uint32)
                rows[np.arange(top) < n[mine][:, None]] = points[ragged(lo[mine], n[mine])]
                score[mine], gap[mine], flat, size[mine], odd = self.viterbi(rows)
                ends = np.cumsum(size[mine]).tolist()
                for k, a, z in zip(mine.tolist(), [0, *ends], ends, strict=False):
                    ids[k] = flat[a:z]
                single.append(mine[odd | (rows[:, 0] == 0)])
        for k in np.concatenate(single).tolist():
            found = self.best(whole[lo[k] : hi[k]])
            score[k], ids[k], size[k] = found[0][0], np.array(found[0][1], np.int32), len(found[0][1])
            gap[k] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
        return score, gap, np.concatenate(ids), size

    def best(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """Up to ``n_best`` segmentations of a unit, best first; of equal scores, longer first pieces first."""
        get, score, reach, n, most = self.id.get, self.score, self.reach, len(unit), self.n_best
        if n == 1:
            p = get(unit)
            return [(score[p], (p,)) if p is not None else (self.worst, self.spelt(unit))]
        # Forward: the least cost from the start to each position, and the edges that end there.
        far = float("inf")
        ahead, into = [0.0] + [far] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            here = ahead[i]
            for j in range(i + 1, min(n, i + reach.get(unit[i], 1)) + 1):
                p = get(unit[i:j])
                if p is not None:
                    cost = -score[p]
                elif j == i + 1:
                    p, cost = -1, -self.worst
                else:
                    continue
                into[j].append((i, p, cost))
                if here + cost < ahead[j]:
                    ahead[j] = here + cost
        # Backward: (cost of the whole path, -position, -end of its first piece, entry there, piece, cost from here on). Of equal costs the position
        # furthest right goes first, so all entries of a position are known before its first one is taken.
        heap = [(ahead[n], -n, 0, 0, -2, 0.0)]
        taken: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        out = []
        while heap:
            _, i, j, k, p, cost = heappop(heap)
            mine = taken[-i]
            if len(mine) == most:
                continue
            mine.append((p, -j, k))
            if i:
                k, j = len(mine) - 1, i
                for i, p, c in into[-j]:
                    if len(taken[i]) < most:
                        heappush(heap, (ahead[i] + (c + cost), -i, j, k, p, c + cost))
                continue
            ids, at = [], 0
            while at < n:
                ids += (p,) if p >= 0 else self.spelt(unit[at])
                at = -j
                if at < n:
                    p, j, k = taken[at][k]
                    j = -j
            out.append((-cost, tuple(ids)))
            if len(out) == most:
                break
        return out

    def spelt(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def spells(self, ids: list[int], text: str) -> bool:
        """Whether a list of ids decodes to ``text``."""
        if MARK in text:
            return self.decode(ids) == text
        return b"".join(map(self.raw.__getitem__, ids)) == (MARK + text.replace(" ", MARK)).encode("utf-8", "surrogatepass") if text else not ids

    def decode(self, ids) -> str:
        """The text of a list of ids; the mark that encoding puts first is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")


def combined(best: np.ndarray, gaps: np.ndarray, n_best: int, losses) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``n_best`` largest sums of one entry of each unit's list, each with the (unit, entry) that are not the unit's best.

    Given are the units' best scores, the losses of their second best, and a function from a unit to the losses of all its entries.
    """
    total, few = float(best.sum()), n_best - 1
    found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    if few and len(gaps):
        at = np.flatnonzero(gaps <= (np.partition(gaps, few - 1)[few - 1] if len(gaps) > few else np.inf))
        at = at[np.isfinite(gaps[at])]
        at = at[np.argsort(gaps[at], kind="stable")[:few]]
        for u in np.sort(at)[::-1].tolist():
            some = sorted((x + t[0], e, k) for e, x in enumerate(losses(u)) for k, t in enumerate(found))[:n_best]
            found = [(x, ((u, e), *found[k][1]) if e else found[k][1]) for x, e, k in some]
    return [(total - x, differ) for x, differ in found]


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", n_best: int = 4) -> DataFrame:
    """One row per document: id, n_pieces long, ids_crc32 long (little-endian unsigned 32-bit ids of the best path), scores array<double>
    (the N best sums, best first), segmentations array<array<int>> (the ids of each of them), ids array<int> (the first of these) and round_trip
    boolean (decoding the document's own ids gives the text again).

    Null and empty texts have no pieces, one score of 0 and round-trip. A text that itself holds the word mark
    decodes with spaces there, and so does not round-trip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, n_best)

        def fresh():
            return Known(), Grown(), Grown(), Grown(dtype=np.int64), Grown(dtype=np.int32), Grown(dtype=np.int32), {}

        codes, first, gaps, start, size, flat, searched = fresh()
        for b in batches:
            if len(codes) > 600_000:
                codes, first, gaps, start, size, flat, searched = fresh()
            rows = b.column(1).to_pylist()
            whole, lo, hi, h, units = lattice.cut(rows)
            got, new = codes.of(h)
            if len(new):
                score, gap, ids, sizes = lattice.learn(whole, lo[new], hi[new])
                first.add(score)
                gaps.add(gap)
                start.add(flat.n + np.cumsum(sizes) - sizes)
                size.add(sizes)
                flat.add(ids)
            count, crc, scores, paths, back = [], [], [], [], []
            each_size = size.a[got]
            all_ids, cuts = flat.a[ragged(start.a[got], each_size)], np.r_[0, np.cumsum(each_size, dtype=np.int64)]
            done = np.r_[0, np.cumsum(units)].tolist()
            for k, t in enumerate(rows):
                x, z = done[k], done[k + 1]
                c, ends = got[x:z], cuts[x : z + 1] - cuts[x]
                ids = all_ids[cuts[x] : cuts[z]]

                def entries(u: int) -> list:
                    code = int(c[u])  # noqa: B023
                    if code not in searched:
                        searched[code] = [(s, np.array(p, np.int32)) for s, p in lattice.best(whole[lo[x + u] : hi[x + u]])]  # noqa: B023
                    return searched[code]

                ranked = combined(first.a[c], gaps.a[c], n_best, lambda u: [entries(u)[0][0] - s for s, _ in entries(u)])  # noqa: B023
                count.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                scores.append([x for x, _ in ranked])
                back.append(lattice.spells(ids.tolist(), t or ""))
                some = []
                for _, differ in ranked:
                    parts, at = [], 0
                    for u, e in differ:
                        parts += [ids[at : ends[u]], entries(u)[e][1]]
                        at = ends[u + 1]
                    some.append(np.concatenate([*parts, ids[at:]]) if parts else ids)
                paths.append(some)
            each = [x for some in paths for x in some]
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(count, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(scores, pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), inner),
                    pa.array(back, pa.bool_()),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "scores", "segmentations", "round_trip"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, segmentations array<array<int>>, round_trip boolean")
    return out.select("doc_id", "n_pieces", "ids_crc32", "scores", "segmentations", F.col("segmentations")[0].alias("ids"), "round_trip")


def decode(rows: DataFrame, model: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id long, text string): the text of each row's ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, 1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else lattice.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    small_batches(rows.sparkSession)
    return rows.select(F.col(id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
