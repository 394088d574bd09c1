"""Suffix-array dedup: remove bytes covered by a long enough string that an earlier document has too.

Every window of ``width`` bytes is filed under the smallest hash of the short strings in it, so equal windows are
always filed together; a run of windows with one such key is one string of at most ``2 * width`` or so bytes.
Keys that no two documents share need no more work. For the others, each bucket of keys holds the distinct
strings, each with its smallest document, and sorts their suffixes by a difference-cover algorithm: sort sampled
triples, recurse on their names, merge the remaining suffixes, then compare adjacent prefixes of ``width`` bytes.
Equal prefixes get the smallest document of any of their strings.

Documents are dealt to cells by a hash of the id. A cell sends each key and each distinct string once, however
many of its documents have it, so a passage in a third of all documents is one string in its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_of, bytes_and_offsets, count_for, parts, ragged

MULT = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time, which bounds a task's memory for long texts.
SLICE = 1 << 19
#: Windows of one run; longer runs, as in one byte repeated, are cut.
RUN = 64


def window_keys(data: np.ndarray, width: int, short: int) -> np.ndarray:
    """Key of each window: the smallest hash of the ``short``-byte strings in it."""
    with np.errstate(over="ignore"):
        h, size, power = TABLE[data], 1, MULT
        total, done = None, 0
        left = short
        while left:
            if left & 1:
                total = h.copy() if total is None else total[: len(total) - size] * power + h[done:]
                done += size
            left >>= 1
            if left:
                h = h[: len(h) - size] * power + h[size:]
                size *= 2
                power = power * power
        h = total[: len(data) - short + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    span, low, step = width - short + 1, h, 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(h) - span + 1], low[span - step :]) if step < span else low


class Cell:
    """The documents of a cell, and the runs of windows that share a key."""

    def __init__(self, table: pa.Table, width: int, short: int) -> None:
        self.ids = np.array(table.column("_id").to_pylist(), np.int64)
        self.data, self.offs = bytes_and_offsets(table.column("_text"))
        self.width = width
        doc, at, size, key = [], [], [], []
        for d in range(len(self.ids)):
            lo, hi = int(self.offs[d]), int(self.offs[d + 1])
            for a in range(lo, hi - width + 1, SLICE):
                k = window_keys(self.data[a : min(hi, a + SLICE + width - 1)], width, short)
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                n = np.diff(np.r_[first, len(k)])
                if n.max() > RUN:
                    reps = -(-n // RUN)
                    inner = ragged(np.zeros(len(n), np.int64), reps)
                    first, n = np.repeat(first, reps) + inner * RUN, np.minimum(np.repeat(n, reps) - inner * RUN, RUN)
                doc.append(np.full(len(first), d, np.int32))
                at.append(a + first)
                size.append(n)
                key.append(k[first])
        empty = np.zeros(0, np.int64)
        self.doc, self.at, self.size, self.key = (np.concatenate(x) if x else y for x, y in ((doc, empty.astype(np.int32)), (at, empty), (size, empty), (key, empty.astype(np.uint64))))

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings of the chosen runs: one run of each, in order of a digest, and each run's string."""
        at, n = self.at[chosen], self.size[chosen] + self.width - 1
        digest = digests(self.data, at, n)
        order = np.lexsort((digest, n, self.key[chosen]))
        k, d, m = self.key[chosen][order], digest[order], n[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])] if len(order) else np.zeros(0, bool)
        which = np.zeros(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which


def digests(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each slice."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(at), 20_000):
            s, m = at[a : a + 20_000], n[a : a + 20_000]
            power = np.cumprod(np.full(int(m.max()), MULT, np.uint64))
            first = np.cumsum(m) - m
            v = TABLE[data[ragged(s, m)]] * power[ragged(np.zeros(len(m), np.int64), m)]
            h = np.add.reduceat(v, first)
            out[a : a + 20_000] = (h ^ (h >> np.uint64(32))) * MULT
    return out


def names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of rows under the columns' order, and the sorted order."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text`` (positive integers).

    Difference cover modulo 3: suffixes at positions 1 and 2 modulo 3 are sampled, their triples sorted and
    named, and where names repeat the string of names is sorted in the same way. The remaining suffixes are
    sorted by their letter and the rank after it, and both lists are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(5, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(t.max()) + 1
    packed = (t[sample] * top + t[sample + 1]) * top + t[sample + 2] if top < 2_000_000 else None
    name, order = names(packed) if packed is not None else names(t[sample], t[sample + 1], t[sample + 2])
    if name[order[-1]] + 1 < len(sample):
        order = suffix_order(name + 1)
    rank = np.zeros(n + 6, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    wide = np.int64(n + 7)
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[first] * wide + rank[first + 1], t[zero] * wide + rank[zero + 1], "left")
    pair = np.unique(np.concatenate([t[second] * top + t[second + 1], t[zero] * top + t[zero + 1]])) if top < 3_000_000_000 else None
    at = lambda i: np.searchsorted(pair, t[i] * top + t[i + 1]).astype(np.int64) * wide + rank[i + 2]
    before += np.searchsorted(at(second), at(zero), "left")
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[place] = False
    out[place], out[rest] = zero, sampled
    return out


def earliest(data: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the given slices, in their order: the smallest document of all slices that have it; and windows of each slice."""
    windows = n - width + 1
    sizes = n + 1
    first = np.cumsum(sizes) - sizes
    text = np.ones(int(sizes.sum()), np.int64)  # 1 ends a slice
    text[ragged(first, n)] = data[ragged(at, n)].astype(np.int64) + 2
    order = suffix_order(text)
    owner = np.repeat(np.arange(len(at)), sizes)
    inside = np.arange(len(text)) - np.repeat(first, sizes)
    order = order[inside[order] < windows[owner[order]]]
    # Adjacent prefixes are compared eight bytes at a time.
    word = np.zeros(len(text) + width + 8, np.uint64)
    byte = np.concatenate([np.maximum(text - 2, 0), np.zeros(width + 16, np.int64)]).astype(np.uint64)
    for k in range(8):
        word |= byte[k : k + len(word)] << np.uint64(8 * k)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, width - 7, 8), width - 8]:
        w = word[order + k]
        same &= w[1:] == w[:-1]
    start = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(doc[owner[order]], start) if len(order) else np.zeros(0, np.int64)
    found = np.zeros(len(text), np.int64)
    found[order] = np.repeat(low, np.diff(np.r_[start, len(order)]))
    return found[ragged(first, windows)], windows


def _by_bucket(bucket: np.ndarray, order: np.ndarray):
    """Each bucket that occurs with its rows of ``order``."""
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    for a, z in zip(cuts, [*cuts[1:], len(b)], strict=False):
        yield int(b[a]), order[a:z]


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 50, short: int = 24, cell_bytes: int = 3_000_000, bucket_bytes: int = 3_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without repeats: one row per row of ``docs`` with columns _id, n_bytes, n_removed, n_spans, kept binary,
    and the columns named in ``keep`` as struct _extra.

    A byte goes if a ``width``-byte string over it also starts in a document of a smaller id; strings are
    judged on the input. Null and empty texts have no bytes; rows with the same id never clear one another;
    rows whose id is null keep all their bytes and clear nothing; other columns are not read, and whatever
    they are called is no matter. No documents give no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"), F.struct(F.lit(0).cast("byte").alias("_"), *[docs[c] for c in keep]).alias("_extra"))
    total = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cells, buckets, p = count_for(total, cell_bytes), count_for(total, bucket_bytes), parts(spark)
    nb = np.uint64(buckets)
    dealt = base.where("_id is not null").select(F.pmod(F.xxhash64("_id"), F.lit(cells)).alias("_cell"), "_id", "_text", "_extra").repartition(p, "_cell")
    by_cell = dealt.groupBy("_cell")

    def bucket_of(key: np.ndarray) -> np.ndarray:
        return (key % nb).astype(np.int64)

    def tag_of(key: np.ndarray) -> np.ndarray:
        return (key // nb).astype(np.uint32)

    def send_keys(cell: pa.Table) -> pa.Table:
        c = Cell(cell, width, short)
        order = np.lexsort((c.ids[c.doc], c.key))
        k, d = c.key[order], c.ids[c.doc][order]
        new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        many = np.maximum.reduceat(d, new) != np.minimum.reduceat(d, new) if len(new) else np.zeros(0, bool)
        keys, number = k[new], cell.column("_cell")[0].as_py()
        out = []
        for b, rows in _by_bucket(bucket_of(keys), np.argsort(bucket_of(keys), kind="stable")):
            out.append((b, number, blob_of(tag_of(keys[rows])), blob_of(np.packbits(many[rows]))))
        return _rows(out, ("bucket", "cell", "tags", "many"))

    def shared(bucket: pa.Table) -> pa.Table:
        tags = [np.frombuffer(x, np.uint32) for x in bucket.column("tags").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(t)].astype(bool) for x, t in zip(bucket.column("many").to_pylist(), tags, strict=True)]
        alls = np.concatenate(tags)
        rising = np.sort(alls)
        again = np.r_[False, rising[1:] == rising[:-1]]
        hot = np.union1d(rising[again], alls[np.concatenate(many)])
        yes = hot[np.minimum(np.searchsorted(hot, alls), max(0, len(hot) - 1))] == alls if len(hot) else np.zeros(len(alls), bool)
        ends = np.cumsum([0, *map(len, tags)])
        number, out = bucket.column("bucket")[0].as_py(), []
        for k, (cell, t) in enumerate(zip(bucket.column("cell").to_pylist(), tags, strict=True)):
            got = t[yes[ends[k] : ends[k + 1]]]
            if len(got):
                out.append((cell, number, blob_of(got)))
        return _rows(out, ("cell", "bucket", "tags"))

    def chosen_runs(c: Cell, rows: pa.Table) -> np.ndarray:
        got = {b: np.frombuffer(t, np.uint32) for b, t in zip(rows.column("bucket").to_pylist(), rows.column("tags").to_pylist(), strict=True)}
        b, t, keep = bucket_of(c.key), tag_of(c.key), np.zeros(len(c.key), bool)
        for number, some in _by_bucket(b, np.argsort(b, kind="stable")):
            if number in got:
                keep[some] = np.isin(t[some], got[number])
        return np.flatnonzero(keep)

    def send_strings(cell: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(cell):
            return _rows([], STRINGS)
        c = Cell(cell, width, short)
        runs = chosen_runs(c, marks)
        one, which = c.strings(runs)
        low = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(low, which, c.ids[c.doc[runs]])
        at, n, key = c.at[runs][one], c.size[runs][one] + width - 1, c.key[runs][one]
        tags = dict(zip(marks.column("bucket").to_pylist(), marks.column("tags").to_pylist(), strict=True))
        out, number = [], cell.column("_cell")[0].as_py()
        for b, rows in _by_bucket(bucket_of(key), np.argsort(bucket_of(key), kind="stable")):
            out.append((b, number, tags[b], c.data[ragged(at[rows], n[rows])].tobytes(), blob_of(n[rows].astype(np.uint8)), blob_of(key[rows]), blob_of(low[rows])))
        return _rows(out, STRINGS)

    def sort_strings(bucket: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(x, kind) for x in bucket.column(name).to_pylist()]
        sizes, keys, lows = col("sizes", np.uint8), np.concatenate(col("keys", np.uint64)), np.concatenate(col("lows", np.int64))
        data, n = np.concatenate(col("data", np.uint8)), np.concatenate(sizes).astype(np.int64)
        at = np.cumsum(n) - n
        digest = digests(data, at, n)
        order = np.lexsort((digest, n, keys))
        k, d, m = keys[order], digest[order], n[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        low = np.minimum.reduceat(lows[order], np.flatnonzero(new))
        key = keys[one]
        alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]  # no other string can share a window with it
        windows = n[one] - width + 1
        first = np.cumsum(windows) - windows
        found = np.repeat(low, windows)
        rest = np.flatnonzero(~alone)
        if len(rest):
            got, w = earliest(data, at[one[rest]], n[one[rest]], low[rest], width)
            found[ragged(first[rest], w)] = got
        # Per string: where the smallest document changes along its windows.
        change = np.ones(len(found), bool)
        change[1:] = found[1:] != found[:-1]
        change[first] = True
        string = np.repeat(np.arange(len(one)), windows)[change]
        inner, value = (np.flatnonzero(change) - first[string]).astype(np.uint8), found[change]
        starts, counts = np.searchsorted(string, np.arange(len(one))), np.bincount(string, minlength=len(one))
        number, out, a = bucket.column("bucket")[0].as_py(), [], 0
        for cell, size, tags in zip(bucket.column("cell").to_pylist(), sizes, bucket.column("tags").to_pylist(), strict=True):
            mine = which[a : a + len(size)]
            a += len(size)
            pick = ragged(starts[mine], counts[mine])
            out.append((cell, number, tags, blob_of(counts[mine].astype(np.uint8)), blob_of(inner[pick]), blob_of(value[pick])))
        return _rows(out, FOUND)

    def clear(cell: pa.Table, got: pa.Table) -> pa.Table:
        extra = cell.column("_extra")
        if not len(cell):
            return _rows([], RESULT).append_column("_extra", extra)
        c = Cell(cell, width, short)
        runs = chosen_runs(c, got)
        one, which = c.strings(runs)
        key = c.key[runs][one]
        place = {b: k for k, b in enumerate(got.column("bucket").to_pylist())}
        counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in got.column("counts").to_pylist()]
        inner = [np.frombuffer(x, np.uint8).astype(np.int64) for x in got.column("inner").to_pylist()]
        value = [np.frombuffer(x, np.int64) for x in got.column("value").to_pylist()]
        # Put the buckets' answers in the order of this cell's strings.
        base_at, base_n = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        offset = np.cumsum([0, *map(len, inner)])
        for b, rows in _by_bucket(bucket_of(key), np.argsort(bucket_of(key), kind="stable")):
            k = place[b]
            base_n[rows] = counts[k]
            base_at[rows] = offset[k] + np.cumsum(counts[k]) - counts[k]
        inner, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (inner, value))
        # Each run's pieces of windows with one smallest document; a piece of a smaller one covers bytes.
        m = base_n[which]
        pick = ragged(base_at[which], m)
        run = np.repeat(np.arange(len(runs)), m)
        begin = inner[pick]
        end = np.r_[begin[1:], 0]
        last = np.r_[run[1:] != run[:-1], True] if len(run) else np.zeros(0, bool)
        end[last] = c.size[runs][run[last]]
        hit = value[pick] < c.ids[c.doc[runs]][run]
        lo, hi = c.at[runs][run][hit] + begin[hit], c.at[runs][run][hit] + end[hit] + width - 1
        edge = np.zeros(len(c.data) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for d, number in enumerate(c.ids.tolist()):
            a, z = int(c.offs[d]), int(c.offs[d + 1])
            g = gone[a:z]
            out.append((number, z - a, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), c.data[a:z][~g].tobytes()))
        return _rows(out, RESULT).append_column("_extra", extra)

    keys = by_cell.applyInArrow(send_keys, "bucket long, cell long, tags binary, many binary")
    marks = keys.groupBy("bucket").applyInArrow(shared, "cell long, bucket long, tags binary")
    strings = by_cell.cogroup(marks.groupBy("cell")).applyInArrow(send_strings, "bucket long, cell long, tags binary, data binary, sizes binary, keys binary, lows binary")
    found = strings.groupBy("bucket").applyInArrow(sort_strings, "cell long, bucket long, tags binary, counts binary, inner binary, value binary")
    done = by_cell.cogroup(found.groupBy("cell")).applyInArrow(clear, base.select("_id", *[F.lit(0).cast("long").alias(c) for c in RESULT[1:4]], F.col("_text").alias("kept"), "_extra").schema)
    nulls = base.where("_id is null").select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_text").alias("kept"), "_extra")
    return done.union(nulls)


STRINGS = ("bucket", "cell", "tags", "data", "sizes", "keys", "lows")
FOUND = ("cell", "bucket", "tags", "counts", "inner", "value")
RESULT = ("_id", "n_bytes", "n_removed", "n_spans", "kept")


def _rows(rows: list[tuple], names_: tuple[str, ...]) -> pa.Table:
    numbers = ("bucket", "cell", "_id", "n_bytes", "n_removed", "n_spans")
    cols = list(zip(*rows, strict=True)) or [()] * len(names_)
    return pa.table({k: pa.array(c, pa.int64() if k in numbers else pa.binary()) for k, c in zip(names_, cols, strict=True)})

