"""Line dedup: an exact set-similarity join between lines; a line that is like an earlier one goes.

A line is its set of lower-cased words, ordered by rarity over the whole corpus. Where a script is written without
spaces (Han, kana, Thai, Lao, Khmer, Burmese and their like), each two neighbouring characters count as a word. Lines alike enough share a
word of their prefixes, so each line posts its prefix words. In a bucket of words each line meets the lines
before it in its lists, under the length, positional and bitmap filters (a bitmap's differing bits bound how many
words differ), and proposes the earliest that pass. Proposals travel to the earlier line's documents for
its words and on to the later line's documents, where Jaccard similarity is verified. A line proposes the
first ``take`` that pass; lines whose proposals all fail while their lists hold more ask once again, for all the others,
and then only words of their prefixes are posted, known by a table of bits of fixed size.

Documents are dealt to cells by a hash of the id; a cell posts equal lines once. Equal lines of several cells meet in
their lists, where all but the earliest go at once: whatever is like one of them is like the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_of, bytes_and_offsets, count_for, parts, ragged, small_batches, stored, tidy
from .setjoin import COUNTERS, STEP, need
from .words import A, mixed
from .words import word_hashes as hashed

POSTED = {"bucket": "long", "cell": "long", "tags": "binary", "n": "binary", "at": "binary", "bits": "binary", "halves": "binary", "sums": "binary", "ids": "binary", "line": "binary", "ask": "binary"}
ASKED = {"cell": "long", "to": "binary", "a": "binary", "b": "binary", "more": "binary"}
WORDS = {"to": "long", "b": "binary", "which": "binary", "n": "binary", "words": "binary", "more": "binary"}
VERDICT = {"_cell": "long", "line": "binary", "state": "binary", "slots": "binary"}
#: States of a verdict: the line goes, or its lists hold more lines to try.
GONE, OPEN = 1, 2
MASK = np.uint64((1 << 44) - 1)
#: Lines of so many words have bitmaps of 128 bits, shorter ones of 64, which are both halves of the longer over one another.
WIDE = 64
#: Lines whose words are sorted together.
BLOCK = 1 << 18
#: First and last code points of scripts without spaces between words, and the first bytes of all their characters.
SPACELESS = np.array([(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
LEADS = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEB), 0xEF, 0xF0])


def _ddl(shape: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in shape.items())


def _rows(rows: list[tuple], shape: dict[str, str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(shape)
    return pa.table({k: pa.array(c, pa.int64() if kind == "long" else pa.binary()) for (k, kind), c in zip(shape.items(), cols, strict=True)})


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed planes of bytes; ``rising`` ones as differences."""
    if rising and len(a):
        a = np.r_[a[:1], np.diff(a)]
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T), 1) if len(a) else b""


def unpacked(x: bytes, kind, rising: bool = False) -> np.ndarray:
    if not x:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


def finer(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, in which runs of spaceless characters are their pairs of neighbours, or the one character of a run."""
    hit = np.flatnonzero(data >= 0xE0)
    hit = hit[LEADS[data[hit]]]
    if not len(hit):
        return first, last
    b = [np.r_[data, np.zeros(3, np.uint8)][hit + k].astype(np.int64) & 63 for k in range(4)]
    code = np.where(data[hit] < 0xF0, (b[0] & 15) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3])
    known = np.searchsorted(SPACELESS[:, 0], code, side="right") - 1
    hit = hit[(known >= 0) & (code <= SPACELESS[known, 1])]
    if not len(hit):
        return first, last
    word = np.unique(np.searchsorted(first, hit, side="right") - 1)
    sizes = last[word] - first[word]
    at = ragged(first[word], sizes)
    lead = (data[at] & 0xC0) != 0x80
    lead[np.cumsum(sizes) - sizes] = True
    own, starts = np.repeat(word, sizes)[lead], at[lead]
    ends = at[np.r_[np.flatnonzero(lead)[1:], len(at)] - 1] + 1
    lone = np.zeros(len(data), bool)
    lone[hit] = True
    lone = lone[starts]
    joined = (own[1:] == own[:-1]) & (lone[1:] == lone[:-1])
    before, after = np.r_[False, joined], np.r_[joined, False]
    pair = np.flatnonzero(lone & after)
    one = np.flatnonzero(lone & ~after & ~before)
    others = np.ones(len(first), bool)
    others[word] = False
    a = np.concatenate([first[others], starts[pair], starts[one], starts[~lone & ~before]])
    z = np.concatenate([last[others], ends[pair + 1], ends[one], ends[~lone & ~after]])
    order = np.argsort(a, kind="stable")
    return a[order], z[order]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts, and its 44-bit hash; ASCII letters count as lower case."""
    at, h = hashed(raw, finer)
    return at, h & MASK


def word_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of all words of all texts, in a table of fixed size by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for b in batches:
            _, h = word_hashes(b" ".join([x or b"" for x in b.column(0).to_pylist()]))
            table += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, COUNTERS, STEP), pa.int64()), pa.array([table[k : k + STEP].tobytes() for k in range(0, COUNTERS, STEP)], pa.binary())], ["at", "block"])

    def add(some: pa.Table) -> pa.Table:
        total = np.zeros(STEP, np.int64)
        for x in some.column("block").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"at": some.column("at")[:1], "block": pa.array([total.tobytes()], pa.binary())})

    small_batches(texts.sparkSession)
    out = np.zeros(COUNTERS, np.int64)
    for r in texts.mapInArrow(run, "at long, block binary").groupBy("at").applyInArrow(add, "at long, block binary").collect():
        out[r["at"] : r["at"] + STEP] = np.frombuffer(r["block"], np.int64)
    return out


class Lines:
    """All lines of a cell's documents in order of id and text: line k is ``raw[first[k] : last[k]]``, of row ``row[k]``."""

    def __init__(self, cell: pa.Table) -> None:
        data, offs = bytes_and_offsets(cell.column("_text"))
        whole, ids = data.tobytes(), cell.column("_id").to_pylist()
        texts = [whole[a:z] for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.texts, self.raw = texts, b"\n".join([texts[k] for k in order])
        self.last = _ends(self.raw) if texts else np.zeros(0, np.int64)
        self.first = np.r_[np.zeros(min(1, len(self.last)), np.int64), self.last[:-1] + 1]
        ends = np.cumsum(np.fromiter((len(texts[k]) + 1 for k in order), np.int64, len(order))) - 1
        self.row = np.array(order, np.int64)[np.searchsorted(ends, self.last)]

    def __len__(self) -> int:
        return len(self.last)

    def of(self, some: np.ndarray) -> bytes:
        """The chosen lines, one after the other."""
        return b"\n".join([self.raw[a:z] for a, z in zip(self.first[some].tolist(), self.last[some].tolist(), strict=True)])


def _ends(raw: bytes) -> np.ndarray:
    """Where each line of a text ends."""
    return np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw)]


def _own(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The line of each word, of rising starts of words and ends of lines."""
    return np.repeat(np.arange(len(ends)), np.diff(np.r_[0, np.searchsorted(at, ends)]))


def grouped(key: np.ndarray) -> np.ndarray:
    """An order that brings equal keys together, each group in its order before; keys count by the bits that the places leave, at least the lower 32."""
    width = np.uint64(len(key).bit_length())
    both = np.sort(key << width | np.arange(len(key), dtype=np.uint64))
    return (both & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


class Sets:
    """Distinct words of the ``count`` lines of a text: ``n`` of each, its words in ``words`` from ``first``."""

    def __init__(self, raw: bytes, count: int) -> None:
        words, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        lasts = _ends(raw) if count else np.zeros(0, np.int64)
        for k in range(0, count, BLOCK):
            begin, ends = int(lasts[k - 1]) + 1 if k else 0, lasts[k : k + BLOCK]
            at, h = word_hashes(raw[begin : int(ends[-1])])
            line = _own(at, ends - begin).astype(np.uint64)
            both = np.sort(line << np.uint64(44) | h)
            both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
            words.append(both & MASK)
            own.append((both >> np.uint64(44)).astype(np.int64) + k)
        self.words, self.own = np.concatenate(words), np.concatenate(own)
        self.n = np.bincount(self.own, minlength=count)
        self.first = np.cumsum(self.n) - self.n

    def by_rarity(self, chosen: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, 40-bit word, position) of the chosen lines' words, the rarest first."""
        out = []
        for k in range(0, len(chosen), BLOCK):
            some = chosen[k : k + BLOCK]
            w = self.words[ragged(self.first[some], self.n[some])]
            line = np.repeat(np.arange(len(some), dtype=np.uint64), self.n[some])
            both = np.sort(line << np.uint64(46) | rank[(w & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40) | w >> np.uint64(4))
            at = ragged(np.zeros(len(some), np.int64), self.n[some])
            out.append((some[(both >> np.uint64(46)).astype(np.int64)], both & np.uint64((1 << 40) - 1), at))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _proposals(lists: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, half: np.ndarray, ask: np.ndarray, percent: int, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by list and then by age; for each asking entry its next ``take`` passing earlier ones, and whether more follow.

    ``ask`` is 0 for entries that only serve as earlier lines, else 1 plus how many passing ones to skip. All lists are
    walked together: in step k the k-th entry of each list is held against all later ones.
    """
    size = len(lists)
    first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    length = np.diff(np.r_[first, size])
    start = np.repeat(first, length)
    live = np.flatnonzero((ask > 0) & (np.arange(size) > start))
    skip, got = ask.astype(np.int64) - 1, np.zeros(size, np.int64)
    out_a, out_b, more = [], [], np.zeros(size, bool)
    k = 0
    while len(live):
        a = start[live] + k
        ok = a < live
        live, a = live[ok], a[ok]
        na, nb = n[a], n[live]
        fit = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        a, b, na, nb = a[fit], live[fit], na[fit], nb[fit]
        both, pa_, pb = na + nb, at[a], at[b]
        ub = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
        fit = np.flatnonzero((100 + percent) * ub >= percent * both)
        a, b, both = a[fit], b[fit], both[fit]
        if not len(b):
            k += 1
            continue
        differ, halves = bits[a] ^ bits[b], (half[a] ^ half[b]) * ((n[a] >= WIDE) & (n[b] >= WIDE))
        differing = np.bitwise_count(differ ^ halves).astype(np.int64) + np.bitwise_count(halves)
        alike = (100 + percent) * (both - differing) >= 2 * percent * both
        a, b = a[alike], b[alike]
        got[b] += 1
        now = (got[b] > skip[b]) & (got[b] <= skip[b] + take)
        out_a.append(a[now])
        out_b.append(b[now])
        full = b[got[b] > skip[b] + take]
        if len(full):
            more[full] = True
            live = live[~more[live]]
        k += 1
    return np.concatenate(out_a) if out_a else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64), more


def drop_similar_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 1, take: int = 32, cell_bytes: int = 6_000_000) -> DataFrame:
    """``docs`` with ``text`` rid of lines like an earlier line, of the same document or one of a smaller id.

    Lines link when 100 * intersection >= percent * union of their sets of words; similarity is judged on the input, so a
    line goes even where the earlier one goes too. Lines of fewer than ``min_words`` different words stay, so by default
    only blank ones. Documents stay even
    when all their lines go, with an empty text. Null texts stay null, and rows whose id is null stay as they are; rows of
    one id count as one document, in order of their texts. All other columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*[docs[c] for c in others]).alias("_row"), docs[id].cast("long").alias("_id"), docs[text].cast("string").cast("binary").alias("_text"))
    total = whole.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cells = count_for(total, cell_bytes)
    buckets, p = count_for(total, 2 * cell_bytes), parts(spark)
    nb = np.uint64(buckets)
    table = word_counts(whole.select("_text"))
    rank = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(table, 1))).astype(np.uint8))
    dealt = whole.where("_id is not null and _text is not null").withColumn("_cell", F.pmod(F.xxhash64("_id"), F.lit(cells))).repartition(p, "_cell")
    thin = dealt.groupBy("_cell")  # always all columns, so that one exchange serves every step

    def post(cell: pa.Table, skips: dict[int, int] | None, asked: np.ndarray | None = None) -> pa.Table:
        lines = Lines(cell)
        raw = lines.raw
        if asked is not None:  # lines without an asked word can't be an answer
            start, h = word_hashes(raw)
            hit = np.zeros(len(lines), bool)
            hit[_own(start, lines.last)[asked[_slot(h >> np.uint64(4))]]] = True
            raw = b"\n".join([raw[a:z] if yes else b"" for a, z, yes in zip(lines.first.tolist(), lines.last.tolist(), hit.tolist(), strict=True)])
        s = Sets(raw, len(lines))
        number = cell.column("_cell")[0].as_py()
        with np.errstate(over="ignore"):
            total_ = np.add.reduceat(np.r_[mixed(s.words * A), np.uint64(0)], np.minimum(s.first, len(s.words))) if len(lines) else np.zeros(0, np.uint64)
        total_[s.n == 0] = 0
        want = np.flatnonzero(s.n >= min_words)
        order = want[np.lexsort((want, s.n[want], total_[want]))]
        same = np.zeros(len(order), bool)
        same[1:] = (total_[order][1:] == total_[order][:-1]) & (s.n[order][1:] == s.n[order][:-1])
        one = np.sort(order[~same])
        bit = np.uint64(1) << (s.words & np.uint64(63))
        bits = np.bitwise_xor.reduceat(np.r_[bit, np.uint64(0)], np.minimum(s.first, len(bit)))
        half = np.bitwise_xor.reduceat(np.r_[bit * (s.words >> np.uint64(6) & np.uint64(1)), np.uint64(0)], np.minimum(s.first, len(bit)))
        own, words, at = s.by_rarity(one, rank.value)
        keep = at <= s.n[own] - need(s.n[own], percent)
        if asked is not None:
            keep &= asked[_slot(words)]
        own, words, at = own[keep], words[keep], at[keep]
        ids = np.array(cell.column("_id").to_pylist(), np.int64)[lines.row]
        ask = np.ones(len(lines), np.int32)
        if skips is not None:
            ask[:] = 0
            for k, v in skips.items():
                ask[k] = v
        out = []
        bucket = (words % nb).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        b = bucket[o]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for x, z in zip(cuts, [*cuts[1:], len(b)], strict=False):
            r = o[x:z]
            w = own[r]
            out.append((int(b[x]), number, blob_of((words[r] // nb).astype(np.uint32)), packed(s.n[w].astype(np.int32)), packed(at[r].astype(np.int32)), blob_of(bits[w]), blob_of(half[w[s.n[w] >= WIDE]]), blob_of((total_[w] >> np.uint64(32)).astype(np.uint32)), packed(ids[w], True), packed(w.astype(np.int32), True), packed(ask[w])))
        gone = order[same]
        if len(gone) and skips is None:
            out.append((-1 - number, number, *[b""] * 7, blob_of(gone.astype(np.int32)), b""))
        return _rows(out, POSTED)

    def post_all(cell: pa.Table) -> pa.Table:
        return post(cell, None)

    def posting_open(asked):
        def post_open(cell: pa.Table, verdicts: pa.Table) -> pa.Table:
            if not len(cell):
                return _rows([], POSTED)
            skips: dict[int, int] = {}
            for line, state in zip(verdicts.column("line").to_pylist(), verdicts.column("state").to_pylist(), strict=True):
                skips.update(zip(np.frombuffer(line, np.int32).tolist(), np.frombuffer(state, np.int32).tolist(), strict=True))
            return post(cell, skips, asked.value)

        return post_open

    def meeting(most: int):
        def meet(bucket: pa.Table) -> pa.Table:
            number = bucket.column("bucket")[0].as_py()
            if number < 0:
                return _rows([(c, b"", b"", x, b"") for c, x in zip(bucket.column("cell").to_pylist(), bucket.column("line").to_pylist(), strict=True)], ASKED)
            plain = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in bucket.column(name).to_pylist()])
            small = lambda name, kind, rising=False: np.concatenate([unpacked(x, kind, rising) for x in bucket.column(name).to_pylist()])
            tags, bits, sums = plain("tags", np.uint32), plain("bits", np.uint64), plain("sums", np.uint32)
            n, at, ids, line, ask = small("n", np.int32), small("at", np.int32), small("ids", np.int64, True), small("line", np.int32, True), small("ask", np.int32)
            half = np.zeros(len(n), np.uint64)
            half[n >= WIDE] = plain("halves", np.uint64)
            cell = np.repeat(np.array(bucket.column("cell").to_pylist(), np.int64), [len(x) // 4 for x in bucket.column("tags").to_pylist()])
            # Equal lines are equal in all of this; the earliest stands for them, the others go. One that a rare clash of keys parts from its equals meets them below.
            age = np.argsort(ids, kind="stable")  # the lines of one id come from one cell, in their order
            order = age[grouped(mixed(tags.astype(np.uint64)[age] << np.uint64(32) | sums[age]))]
            again = np.zeros(len(order), bool)
            again[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (tags, bits, sums, n)])
            twins = order[again]
            twins = twins[(at[twins] == 0) & (ask[twins] > 0)]
            twins = twins[np.argsort(cell[twins], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, cell[twins][1:] != cell[twins][:-1]]) if len(twins) else []
            out = [(int(cell[twins[x]]), b"", b"", blob_of(line[twins[x:z]]), b"") for x, z in zip(cuts, [*cuts[1:], len(twins)], strict=False)]
            stays = np.ones(len(order), bool)
            stays[order[again]] = False
            order = age[stays[age]]
            order = order[grouped(tags[order].astype(np.uint64))]
            a, b, more = _proposals(tags[order], n[order].astype(np.int64), at[order].astype(np.int64), bits[order], half[order], ask[order], percent, most)
            a, b, more_b = order[a], order[b], more[b]
            # One proposal of a pair is enough.
            o = np.lexsort((line[b], cell[b], line[a], cell[a]))
            a, b, more_b = a[o], b[o], more_b[o]
            same = np.zeros(len(a), bool)
            same[1:] = (line[a][1:] == line[a][:-1]) & (cell[a][1:] == cell[a][:-1]) & (line[b][1:] == line[b][:-1]) & (cell[b][1:] == cell[b][:-1])
            run = np.cumsum(~same) - 1
            more_b = np.bincount(run, more_b) > 0 if len(run) else more_b
            a, b = a[~same], b[~same]
            route = np.flatnonzero(np.r_[True, cell[a][1:] != cell[a][:-1]]) if len(a) else []
            return _rows(out + [(int(cell[a[x]]), packed(cell[b[x:z]].astype(np.int32)), packed(line[a[x:z]], True), packed(line[b[x:z]]), packed(more_b[x:z].astype(np.uint8))) for x, z in zip(route, [*route[1:], len(a)], strict=False)], ASKED)

        return meet

    def fetch(cell: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked):
            return _rows([], WORDS)
        lines = Lines(cell)
        routes = asked.to_pylist()
        out, gone, routes = [], [r for r in routes if not r["a"]], [r for r in routes if r["a"]]
        col = lambda name, kind, rising=False: np.concatenate([np.zeros(0, kind), *(unpacked(r[name], kind, rising) for r in routes)])
        to, a, b, more = col("to", np.int32), col("a", np.int32, True), col("b", np.int32), col("more", np.uint8)
        # Several buckets propose the same pair; it travels once, and each line's words once to a cell.
        o = np.lexsort((b, a, to))
        a, b, to, more = a[o], b[o], to[o], more[o]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (to[1:] != to[:-1])]) if len(a) else np.zeros(0, np.int64)
        more = np.maximum.reduceat(more, new) if len(a) else more
        a, b, to = a[new], b[new], to[new]
        used = np.unique(a)
        s = Sets(lines.of(used), len(used))
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
        for x, z in zip(cuts, [*cuts[1:], len(to)], strict=False):
            one, which = np.unique(a[x:z], return_inverse=True)
            w = np.searchsorted(used, one)
            out.append((int(to[x]), blob_of(b[x:z]), blob_of(which.astype(np.int32)), blob_of(s.n[w].astype(np.int32)), packed(s.words[ragged(s.first[w], s.n[w])], True), blob_of(more[x:z])))
        out += [(r["cell"], r["b"], b"", b"", b"", b"") for r in gone]
        return _rows(out, WORDS)

    def judge(cell: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(sent):
            return _rows([], VERDICT)
        lines = Lines(cell)
        rows = sent.to_pylist()
        state: dict[int, int] = {}
        asks = [np.frombuffer(r["b"], np.int32) for r in rows]
        used = np.unique(np.concatenate(asks))
        s = Sets(lines.of(used), len(used))
        for r, b in zip(rows, asks, strict=True):
            if not r["n"]:
                state.update((k, GONE) for k in b.tolist())
                continue
            sizes, which, more = np.frombuffer(r["n"], np.int32).astype(np.int64), np.frombuffer(r["which"], np.int32), np.frombuffer(r["more"], np.uint8)
            n, words = sizes[which], unpacked(r["words"], np.uint64, True)[ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
            mine = np.searchsorted(used, b)
            both = np.zeros(len(b), np.int64)
            ends = np.cumsum(n)
            for x in range(0, len(b), BLOCK):
                some = np.arange(min(BLOCK, len(b) - x))
                own = np.r_[np.repeat(some, n[x : x + BLOCK]), np.repeat(some, s.n[mine[x : x + BLOCK]])].astype(np.uint64)
                h = np.sort(own << np.uint64(44) | np.r_[words[ends[x] - n[x] : ends[x + len(some) - 1]], s.words[ragged(s.first[mine[x : x + BLOCK]], s.n[mine[x : x + BLOCK]])]])
                both[x : x + BLOCK] = np.bincount((h[1:][h[1:] == h[:-1]] >> np.uint64(44)).astype(np.int64), minlength=len(some))
            linked = 100 * both >= percent * (n + s.n[mine] - both)
            for k, yes, m in zip(b.tolist(), linked.tolist(), more.tolist(), strict=True):
                if yes:
                    state[k] = GONE
                elif m:
                    state.setdefault(k, OPEN)
        out = sorted(state.items())
        if not out:
            return _rows([], VERDICT)
        own, w, at = s.by_rarity(np.searchsorted(used, [k for k, v in out if v == OPEN]), rank.value)
        slots = np.unique(_slot(w[at <= s.n[own] - need(s.n[own], percent)]))
        lines_, states = (blob_of(np.array(x, np.int32)) for x in zip(*out, strict=True))
        return _rows([(cell.column("_cell")[0].as_py(), lines_, states, blob_of(slots.astype(np.int32)))], VERDICT)

    def answers(posted: DataFrame, most: int) -> DataFrame:
        asked = posted.groupBy("bucket").applyInArrow(meeting(most), _ddl(ASKED))
        words = thin.cogroup(asked.groupBy("cell")).applyInArrow(fetch, _ddl(WORDS))
        return stored(thin.cogroup(words.groupBy("to")).applyInArrow(judge, _ddl(VERDICT)))

    verdicts = answers(thin.applyInArrow(post_all, _ddl(POSTED)), take)
    tidy(spark)  # the first round's shuffle files are not read again
    asks = stored(verdicts.groupBy("_cell").applyInArrow(_still_open(1 + take), _ddl(VERDICT)))
    slots = [r["slot"] for r in asks.mapInArrow(_slots, "slot int").distinct().collect()]  # at most COUNTERS
    if slots:
        bits = np.zeros(COUNTERS, bool)
        bits[slots] = True
        post_open = posting_open(spark.sparkContext.broadcast(bits))
        verdicts = verdicts.union(answers(thin.cogroup(asks.groupBy("_cell")).applyInArrow(post_open, _ddl(POSTED)), 1 << 30))
    tidy(spark)

    def clear(cell: pa.Table, found: pa.Table) -> pa.Table:
        if not len(cell):
            return pa.table({"_row": pa.array([], cell.schema.field("_row").type), "_kept": pa.array([], pa.string())})
        lines = Lines(cell)
        gone = np.zeros(len(lines), bool)
        for line, state in zip(found.column("line").to_pylist(), found.column("state").to_pylist(), strict=True):
            gone[np.frombuffer(line, np.int32)[np.frombuffer(state, np.int32) == GONE]] = True
        kept, row = lines.texts, lines.row
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for x, z, some in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], np.logical_or.reduceat(gone, cuts).tolist(), strict=True):
            if some:
                kept[row[x]] = lines.of(np.flatnonzero(~gone[x:z]) + x)
        return pa.table({"_row": cell.column("_row"), "_kept": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())})

    shape = dealt.select("_row", F.lit("").alias("_kept")).schema
    done = thin.cogroup(verdicts.groupBy("_cell")).applyInArrow(clear, shape)
    back = done.union(whole.where("_id is null or _text is null").select("_row", F.col("_text").cast("string")))
    return back.select(*[(F.col("_kept") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(COUNTERS - 1)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(b.column("slots").to_pylist()), np.int32)))], ["slot"])


def _still_open(skip: int):
    def pick(rows: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            line, state = np.frombuffer(r["line"], np.int32), np.frombuffer(r["state"], np.int32)
            some = line[state == OPEN]
            if len(some):
                out.append((r["_cell"], blob_of(some), blob_of(np.full(len(some), skip, np.int32)), r["slots"]))
        return _rows(out, VERDICT)

    return pick
