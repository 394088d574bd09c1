"""N-gram Jaccard join: which documents' sets of word shingles are alike, by a size-aware heavy-light join.

Shingles are ordered by rarity, from counts of all shingles in a table of fixed size; any order gives the same
links, a good one gives short lists. Two sets that are alike enough share a shingle among the first
``n - ceil(t * n) + 1`` of each, and two among one more. Light sets enumerate all pairs of those as keys; heavy
sets put the single shingles into inverted lists, which are scanned under length and positional filters. Sets just over the
boundary do both, so that they meet the light ones. The boundary is the size at which enumerating costs as
much as scanning, from the sizes of all sets and the expected length of a list.

Keys travel packed, many in a row of Spark, to the bucket that holds their lists. Every list is first scanned against one leader;
what pairs remain are held against each other's bitmaps (about two bits for a shingle; a bitmap's differing bits are a lower bound of how
many shingles differ), and only pairs that pass exchange their sets to be verified. Then lists whose sets are still in several groups
are scanned whole: of the pairs whose bitmaps are alike, a few for each two groups that they would join are verified, more in each round, until every
such pair of each list lies in one group or is known to be unlike. So a group of near copies costs a row for each of its
members, not for each pair, and no link between different sets is lost. Equal sets are one set from the start.

A key that many sets hold is dealt to several buckets, and its list is scanned in blocks, two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_of, components, count_for, ragged, small_batches, stored, texts_of, tidy
from .words import A, mixed, word_hashes

#: Counters of the rarity table; its size does not depend on the input.
COUNTERS = 1 << 18
#: Counters that are summed together.
STEP = 1 << 9
#: Bits of a shingle's hash. Two different shingles of one pair of sets of 20,000 have one hash in about one pair of a million.
BITS = np.uint64(48)
MASK = np.uint64((1 << 48) - 1)
#: The most bits of a bitmap; larger sets are filtered less well.
WIDEST = 1 << 14
#: A counter this much over the mean belongs to a shingle that many sets hold.
OVER_MEAN = 8
#: Set sizes over this are counted together; the boundary is always lower.
SMALL = 200
#: Bytes of texts that are shingled together.
TOGETHER = 1 << 22


def need(n, percent: int):
    """Least overlap of a set of ``n`` with any set that it links to."""
    return -(-percent * n // 100)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of the texts' sets: rising hashes of ``words`` words each, one of the whole sequence if there are fewer, none without words."""
    out, sizes, x = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while x < len(texts):
        z, total = x, 0
        while z < len(texts) and z - x < 1 << 15 and (z == x or total + len(texts[z]) <= TOGETHER):
            total += len(texts[z]) + 1
            z += 1
        some = texts[x:z]
        at, h = word_hashes(b" ".join(some))
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        doc = np.searchsorted(ends, at, side="right")
        n = np.bincount(doc, minlength=len(some))
        first = np.cumsum(n) - n
        k = np.minimum(n, words)
        made, own = [], []
        with np.errstate(over="ignore"):
            for size in np.unique(k[k > 0]).tolist():
                docs = np.flatnonzero(k == size)
                count = n[docs] - size + 1
                start = ragged(first[docs], count)
                s = h[start]
                for i in range(1, size):
                    s = mixed(s * A) + h[start + i]
                made.append(mixed(s * A + np.uint64(size)) & MASK)
                own.append(np.repeat(docs, count))
        if made:
            both = np.sort(np.concatenate(own).astype(np.uint64) << BITS | np.concatenate(made))
            both = both[np.r_[True, both[1:] != both[:-1]]]
            out.append(both & MASK)
            sizes.append(np.bincount((both >> BITS).astype(np.int64), minlength=len(some)))
        else:
            sizes.append(np.zeros(len(some), np.int64))
        x = z
    return np.concatenate(out), np.concatenate(sizes)


def names_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    raw, ends = flat.tobytes(), (np.cumsum(sizes) * 8).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)], np.uint64).view(np.int64)


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, the parity of how many of its shingles have each value of their lowest bits; about two bits for a shingle."""
    wide = np.clip(2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 64, WIDEST)
    first = np.cumsum(wide) - wide
    at = np.repeat(first, sizes) + (flat & np.repeat(wide - 1, sizes).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(wide.sum())) & 1).astype(np.uint8)).tobytes()
    return [raw[a // 8 : (a + w) // 8] for a, w in zip(first.tolist(), wide.tolist(), strict=True)]


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the shorter one's length."""
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _differing(bits: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of pairs differ, the longer of two folded to the other's length."""
    width = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    tables, place = {}, np.zeros(len(bits), np.int64)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        place[of] = np.arange(len(of))
        tables[w] = np.frombuffer(b"".join([bits[k] for k in of.tolist()]), np.uint64).reshape(-1, w)
    out, low, high = np.zeros(len(left), np.int64), np.minimum(width[left], width[right]), np.maximum(width[left], width[right])
    small, large = np.where(width[left] <= width[right], left, right), np.where(width[left] <= width[right], right, left)
    for w, v in np.unique(np.stack([low, high]), axis=1).T.tolist() if len(left) else ():
        of = np.flatnonzero((low == w) & (high == v))
        for x in range(0, len(of), 1 << 14):
            some = of[x : x + (1 << 14)]
            folded = np.bitwise_xor.reduce(tables[v][place[large[some]]].reshape(len(some), v // w, w), axis=1)
            out[some] = np.bitwise_count(tables[w][place[small[some]]] ^ folded).sum(axis=1, dtype=np.int64)
    return out


def open_pairs(lists: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, block: np.ndarray, crossed: np.ndarray, bits: list[bytes], percent: int, take: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many lists' pairs between groups that pass all filters, up to ``take`` for each set, those of other groups first; and the lists that have more.

    Where ``crossed``, pairs of one block are left out.
    """
    order = np.lexsort((n, lists))
    o_lists, o_n = lists[order], n[order]
    _, rank = np.unique(o_lists, return_inverse=True)
    wide = np.int64(o_n.max(initial=0)) * 100 // percent + 2
    count = np.searchsorted(rank * wide + o_n, rank * wide + 100 * o_n // percent, side="right") - np.arange(len(order)) - 1
    ends, lefts, rights, x = np.cumsum(count), [], [], 0
    while x < len(order):  # so many pairs at a time
        z = max(x + 1, int(np.searchsorted(ends, ends[x] - count[x] + step, side="right")))
        left = np.repeat(np.arange(x, z), count[x:z])
        right = order[left + 1 + ragged(np.zeros(z - x, np.int64), count[x:z])]
        left = order[left]
        ok = (group[left] != group[right]) & ((block[left] != block[right]) | ~crossed[left])
        left, right = left[ok], right[ok]
        ok = _fits(n[left], at[left], n[right], at[right], percent)
        left, right = left[ok], right[ok]
        both = n[left] + n[right]
        ok = (100 + percent) * (both - _differing(bits, left, right)) >= 2 * percent * both
        left, right = left[ok], right[ok]
        # The first of each other group, then the second of each, and so on.
        turn = np.lexsort((right, group[right], left))
        left, right = left[turn], right[turn]
        new = np.r_[True, (left[1:] != left[:-1]) | (group[right][1:] != group[right][:-1])] if len(left) else np.zeros(0, bool)
        nth = np.arange(len(left)) - np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))
        turn = np.lexsort((right, nth, left))
        left, right = left[turn], right[turn]
        lefts.append(left)
        rights.append(right)
        x = z
    left, right = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (lefts, rights))
    start = np.r_[True, left[1:] != left[:-1]] if len(left) else np.zeros(0, bool)
    kept = np.arange(len(left)) - np.maximum.accumulate(np.where(start, np.arange(len(left)), 0)) < take
    return left[kept], right[kept], np.unique(lists[left[~kept]])


def described(base: DataFrame, words: int) -> DataFrame:
    """Rows (kind 0, id, s, n, bits), one of each text, and rows (kind 1, at, bits) with blocks of the counts of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        shape = ["kind", "id", "s", "n", "bits"]
        for b in batches:
            flat, sizes = shingles(texts_of(b.column(1)), words)
            table += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            named = pa.array(names_of(flat, sizes), pa.int64(), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), named, pa.array(sizes, pa.int64()), pa.array(bitmaps(flat, sizes), pa.binary())], shape)
        blocks = range(0, COUNTERS, STEP)
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), none, none, pa.array([table[k : k + STEP].tobytes() for k in blocks], pa.binary())], shape)

    return base.mapInArrow(run, "kind int, id long, s long, n long, bits binary")


def counted(rows: DataFrame) -> np.ndarray:
    """The sum of all blocks of counts."""

    def add(some: pa.Table) -> pa.Table:
        total = np.zeros(STEP, np.int64)
        for x in some.column("bits").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"id": some.column("id")[:1], "bits": pa.array([total.tobytes()], pa.binary())})

    table = np.zeros(COUNTERS, np.int64)
    for r in rows.where("kind = 1").select("id", "bits").groupBy("id").applyInArrow(add, "id long, bits binary").collect():
        table[r["id"] : r["id"] + STEP] = np.frombuffer(r["bits"], np.int64)
    return table


def boundary(sizes: dict[int, int], table: np.ndarray, percent: int, scan_cost: float = 0.2, most: int = 60) -> int:
    """The set size up to which enumerating pairs of shingles costs less than scanning lists.

    A key costs 1, an entry scanned ``scan_cost``; a list is as long as the table says a random shingle's is,
    over the number of shingles that share a counter. Sizes no edge can reach cost the same for every edge.
    """
    total = max(1, int(table.sum()))
    length = max(1.0, float((table.astype(float) ** 2).sum()) / total / max(1.0, total / len(table)))
    best, best_cost = 0, float("inf")
    for edge in range(most + 1):
        cost = 0.0
        for n, docs in sizes.items():
            p = n - need(n, percent) + 1
            cost += docs * ((p + 1) * p / 2 if n <= edge * 100 / percent and n > 1 else 0)
            cost += docs * (p * (1 + scan_cost * length) if n > edge else 0)
        if cost < best_cost:
            best, best_cost = edge, cost
    return best


def keys_of(flat: np.ndarray, sizes: np.ndarray, rank: np.ndarray, edge: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, position of the key's shingle in the order by rarity, -1 for pairs, counter of its rarest shingle) of all keys of some sets."""
    own, keys, at, counter = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        for x in range(0, len(sizes), 1 << 10):
            n = sizes[x : x + (1 << 10)]
            some = flat[ends[x] - n[0] : ends[x + len(n) - 1]]
            doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            order = np.sort(doc << np.uint64(54) | rank[(some & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << BITS | some) & MASK
            first, p = np.cumsum(n) - n, n - need(n, percent) + 1
            heavy = np.flatnonzero((n > edge) & (n > 0))
            inner = ragged(np.zeros(len(heavy), np.int64), p[heavy])
            own.append(np.repeat(heavy, p[heavy]) + x)
            at.append(inner)
            single = order[np.repeat(first[heavy], p[heavy]) + inner]
            keys.append(mixed(single + np.uint64(1)))
            counter.append((single & np.uint64(COUNTERS - 1)).astype(np.int64))
            light = np.flatnonzero((n > 1) & (n <= edge * 100 // percent))
            for size in np.unique(n[light]).tolist():  # few sizes
                docs = light[n[light] == size]
                i, j = np.triu_indices(min(size, size - need(size, percent) + 2), 1)
                u, v = order[first[docs][:, None] + i], order[first[docs][:, None] + j]
                own.append(np.repeat(docs, len(i)) + x)
                at.append(np.full(len(docs) * len(i), -1))
                keys.append(mixed(mixed(u * A) + v).ravel())
                counter.append((u & np.uint64(COUNTERS - 1)).astype(np.int64).ravel())  # the rarer of both
    return np.concatenate(own), np.concatenate(keys), np.concatenate(at), np.concatenate(counter)


def _fits(n1, at1, n2, at2, percent: int) -> np.ndarray:
    """Length and positional filters of two entries of a list."""
    bound = np.minimum(at1, at2) + 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((at1 < 0) | ((100 + percent) * bound >= percent * (n1 + n2)))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, together: int = 1 << 20, list_rows: int = 1 << 12) -> DataFrame:
    """Rows (_id, n_shingles long, component_id long), one for each row of ``docs``.

    Sets link when 100 * intersection >= percent * union. ``component_id`` is the smallest id reachable by links. Null and
    empty texts and texts of white space have an empty set and are alone; a row whose id is null gets a null
    component and links nothing; repeated rows are rows of their own. Other columns are not read. ``together`` is how many keys
    a task packs at once, and about how many a bucket of lists holds; longer lists than ``list_rows`` are split.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))
    rows = stored(described(base, words))
    table = counted(rows)
    sets = rows.where("kind = 0")
    prefix = F.expr(f"n - ceil({percent} * n / 100) + 1")
    sizes = {r["small"]: (r["c"], r["p"]) for r in sets.where("n > 0").groupBy(F.least("n", F.lit(SMALL)).alias("small")).agg(F.count("*").alias("c"), F.sum(prefix).alias("p")).collect()}
    edge = boundary({n: c for n, (c, _) in sizes.items() if n < SMALL}, table, percent)
    buckets = count_for(int(sum(p for _, p in sizes.values())), together)
    hot = (np.where(table > OVER_MEAN * table.mean(), table, 0) // list_rows).clip(0, 1 << 15).astype(np.uint16)  # buckets of a list besides one
    dealt = spark.sparkContext.broadcast(hot)
    rank = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(table, 1))).astype(np.uint8))
    reps = stored(sets.where("id is not null and s is not null").groupBy("s").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            s, n, key, at, more = (np.concatenate(x) for x in zip(*held, strict=True))
            with np.errstate(over="ignore"):
                turn = (s.view(np.uint64) % (more + np.uint64(1))) * A
                bucket = (mixed(key + turn) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            b = bucket[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            columns = (key, s, n.astype(np.int32), at.astype(np.int32), (more > 0).astype(np.uint8))
            out = [(int(b[x]), *(blob_of(c[order[x:z]]) for c in columns)) for x, z in zip(cuts, [*cuts[1:], len(b)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], ["bucket", "keys", "s", "n", "at", "hot"])

        held, count = [], 0
        for b in batches:
            flat, size = shingles(texts_of(b.column(0)), words)
            s = names_of(flat, size)
            own, key, at, counter = keys_of(flat, size, rank.value, edge, percent)
            held.append((s[own], size[own], key, at, dealt.value[counter].astype(np.uint64)))
            count += len(own)
            if count >= together:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    def lists(bucket: pa.Table) -> pa.Table:
        """Pairs of each list's first set and another (kind 0), and entries of lists with more to try (kind 1)."""
        kinds = {"keys": np.uint64, "s": np.int64, "n": np.int32, "at": np.int32, "hot": np.uint8}
        key, s, n, at, spread = (np.concatenate([np.frombuffer(x, kind) for x in bucket.column(c).to_pylist()]) for c, kind in kinds.items())
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.r_[False, k[1:] == k[:-1]]
        order = order[again | np.r_[again[1:], False] | (spread[order] > 0)]  # other lists of one entry end here
        order = order[np.lexsort((s[order], key[order]))]
        k, x = key[order], s[order]
        order = order[np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])] if len(order) else np.zeros(0, bool)]
        k, s, n, at, spread = key[order], s[order], n[order].astype(np.int64), at[order].astype(np.int64), spread[order] > 0
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(k)])
        lead, length = np.repeat(first, size), np.repeat(size, size)
        star = (np.arange(len(k)) > lead) & _fits(n, at, n[lead], at[lead], percent)
        more = (length > 2) | spread
        kind = np.r_[np.zeros(int(star.sum()), np.int32), np.ones(int(more.sum()), np.int32)]
        both = lambda x, y: np.r_[x[star], y[more]]
        return pa.table({"kind": kind, "key": both(s[lead], k.view(np.int64)), "s": both(s, s), "n": both(n, n), "at": both(at, at)})

    posted = base.where("_id is not null").select("_text").mapInArrow(post, "bucket long, keys binary, s binary, n binary, at binary, hot binary")
    found = stored(posted.groupBy("bucket").applyInArrow(lists, "kind int, key long, s long, n long, at long"))
    tidy(spark)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, ba, bb = (b.column(c).to_pylist() for c in ("na", "nb", "ba", "bb"))
            keep = [(100 + percent) * (x + y - differing(p, q)) >= 2 * percent * (x + y) for x, y, p, q in zip(na, nb, ba, bb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = shingles(texts_of(b.column(1)), words)
            s, ends = names_of(flat, size), np.cumsum(size)
            keep = s == b.column(0).to_numpy()  # a repeated id may have other texts
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.ascontiguousarray(flat[z - n : z].view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes() for n, z in zip(size.tolist(), ends.tolist(), strict=True)], pa.binary())], ["s", "packed"]).filter(pa.array(keep))

    def unpacked(x: bytes) -> np.ndarray:
        wide = np.zeros((len(x) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(x, np.uint8).reshape(6, -1).T
        return wide.view(np.uint64).ravel()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True):
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    def sides(pairs: DataFrame, what: DataFrame, columns: dict[str, str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(what.select(F.col("s").alias(side), *[F.col(c).alias(short + side) for c, short in columns.items()]), side)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of pairs whose bitmaps are alike."""
        named = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct().join(reps.select("s", "id"), "s")
        held = stored(named.join(base, named["id"] == base["_id"]).select("s", "_text").mapInArrow(sets_of, "s long, packed binary").dropDuplicates(["s"]))
        return stored(sides(pairs, held, {"packed": "p"}).mapInArrow(judge, "a long, b long, linked boolean"))

    stars = found.where("kind = 0").select(F.least("key", "s").alias("a"), F.greatest("key", "s").alias("b")).distinct()
    tried = verified(stored(sides(stars, reps, {"n": "n", "bits": "b"}).mapInArrow(alike, "a long, b long")))
    entries, take = found.where("kind = 1").drop("kind"), 16
    wide = entries.groupBy("key").agg(F.ceil(F.count("*") / list_rows).alias("m")).where("m > 1")

    def joining(most: int):
        def join(rows: pa.Table) -> pa.Table:
            key, i, j, s, n, at, g, block = (rows.column(c).to_numpy() for c in ("key", "i", "j", "s", "n", "at", "g", "block"))
            lists = np.unique(np.stack([key, i, j]), axis=1, return_inverse=True)[1].ravel() if len(key) else key
            left, right, more = open_pairs(lists, s, n, at, g, block, i != j, rows.column("bits").to_pylist(), percent, most)
            pairs = np.unique(np.stack([np.minimum(s[left], s[right]), np.maximum(s[left], s[right])]), axis=1)
            again = np.unique(key[np.isin(lists, more)])
            none = pa.nulls(len(again), pa.int64())
            made = [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in ((pairs[0], none), (pairs[1], none))]
            return pa.table({"key": pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(again, pa.int64())]), "a": made[0], "b": made[1]})

        return join

    groups = components(tried.where("linked").select("a", "b"))
    while True:
        labelled = entries.join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("g", F.coalesce("component", "s")).drop("component")
        split = labelled.groupBy("key").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("key")
        open_ = stored(labelled.join(split, "key").join(wide, "key", "left").withColumn("m", F.coalesce("m", F.lit(1))))
        part = lambda c: F.pmod(F.xxhash64(c), F.col("m"))
        blocks = open_.withColumn("block", part("s")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        grouped = F.pmod(F.xxhash64("key", "i", "j"), F.lit(count_for(open_.count(), list_rows)))
        blocks = blocks.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(reps.select("s", "bits"), "s").withColumn("_g", grouped)
        met = stored(blocks.groupBy("_g").applyInArrow(joining(take), "key long, a long, b long"))
        # A pair that failed before is proposed again; it isn't verified again, and the larger ``take`` of the next round goes past it.
        pairs = stored(met.where("a is not null").select("a", "b").distinct().join(tried.where("not linked").select("a", "b"), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tried = tried.union(verified(pairs))
            groups = components(tried.where("linked").select("a", "b"))
        tidy(spark)
        again = met.where("key is not null").select("key").distinct()
        if again.isEmpty():
            break
        entries, take = stored(entries.join(again, "key")), take * 8
    tidy(spark)
    named = reps.select("s", F.col("id").alias("low")).join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("g", F.coalesce("component", "s"))
    named = named.join(named.groupBy("g").agg(F.min("low").alias("component_id")), "g").select("s", "component_id")
    own = sets.select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), "s")
    return own.join(named, "s", "left").select("_id", "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))
