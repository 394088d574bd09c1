"""Phrase collocations: exact counts of phrases of up to three words for each language, and how strongly they cling together.

Every word starts one window of three, the word and the two that lead it, padded where its piece ends; a phrase of any length is a prefix of the
windows that start with it, so the counts of the longest windows hold all others, and ROLLUP sums them over shorter and shorter prefixes.

Nearly all windows of a corpus occur once, and as rows of text they take some eight times the input to shuffle. So documents are dealt to
cells; a cell files its distinct words in buckets, which count them and number those that occur ``least`` times, and then its distinct windows,
as packed numbers, in buckets of their first two words. Words under ``least`` pad like the end of a piece: no phrase over them can be a
candidate or a part of one. A bucket has all windows of its pairs, so it knows what is rare and folds it: a rare
window keeps its pair, and a rare pair its first word, with the padding behind. Folded windows count in every shorter
prefix as before; they alone, some hundredth of all, become rows for ROLLUP. Words are told apart by their bytes, never by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.operators.graph import written
from caselake.operators.ranks import in_order

from .common import Codes, count_for, parts, texts_of

NONE, PAD = 0, 1
#: Each byte as it counts in a word: lower case, tabs as spaces, and one sign for all that end a piece.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed 32-bit numbers; the first, which rises, as its steps."""
    first = np.diff(columns[0].astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([first, *columns[1:]]).astype(np.uint32).tobytes())


def unpacked(blob: bytes, width: int) -> list[np.ndarray]:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).reshape(width, -1).astype(np.int64)
    return [np.cumsum(rows[0]), *rows[1:]]


class Texts:
    """One language's texts in a cell: its words by code, and the codes of all texts in a row, each piece ended by ``PAD``."""

    def __init__(self, texts: list[bytes], name: bytes, buckets: int) -> None:
        codes = Codes()
        codes.of([b"", b"\n"])
        runs = [codes.of(t.translate(FOLD).replace(b"\n", b" \n ").split(b" ") + [b"\n"]) for t in texts]
        flat = np.concatenate([*runs, np.full(3, PAD, np.int32)])
        self.flat, self.words = flat[flat != NONE], list(codes)
        bucket = [xxhash.xxh3_64_intdigest(name + b"\0" + w) % buckets for w in self.words[2:]]
        #: Codes in order of bucket and word, which doesn't hang on the order of the texts, and each bucket's slice.
        self.order = np.array(sorted(range(2, len(self.words)), key=lambda c: (bucket[c - 2], self.words[c])), np.int64)
        filed = np.array(bucket, np.int64)[self.order - 2]
        cuts = np.flatnonzero(np.r_[True, filed[1:] != filed[:-1]]) if len(filed) else np.zeros(0, np.int64)
        self.slices = list(zip(filed[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(filed)].tolist(), strict=False))

    def windows(self, number: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct windows as three columns of numbers (0: padding), in rising order, and their counts. ``number``: of each code, 0 if rare."""
        known, flat = np.unique(number[self.flat], return_inverse=True)
        if not len(known) or known[0]:
            known, flat = np.r_[0, known], flat + 1
        wide = np.int64(len(known))
        at = np.flatnonzero(self.flat != PAD)
        first, second = flat[at], flat[at + 1]
        second = np.where(first == 0, 0, second)
        pairs, pair = np.unique(first * wide + second, return_inverse=True)
        third = np.where(second == 0, 0, flat[at + 2])
        triples, count = np.unique(pair * wide + third, return_counts=True)
        of, third = np.divmod(triples, wide)
        first, second = np.divmod(pairs[of], wide)
        return [known[first], known[second], known[third]], count


def cell_texts(cell: pa.Table, buckets: int) -> list[tuple[str, Texts]]:
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(cell.column("_lang").to_pylist(), texts_of(cell.column("_text")), strict=True):
        by_lang.setdefault(lang, []).append(text)
    return [(lang, Texts(by_lang[lang], lang.encode(errors="surrogatepass"), buckets)) for lang in sorted(by_lang)]


def folded(first: np.ndarray, second: np.ndarray, third: np.ndarray, count: np.ndarray, least: int) -> list[np.ndarray]:
    """Windows (0: padding) summed, rare ones cut to the prefix that isn't rare; ``second`` with ``first`` must be here as a whole."""

    def summed(a, b, c, n):
        pairs, pair = np.unique((a << 32) | b, return_inverse=True)
        triples, at = np.unique((pair << 32) | c, return_inverse=True)
        total = np.bincount(at, n, len(triples)).astype(np.int64)
        of = triples >> 32
        return pairs[of] >> 32, pairs[of] & 0xFFFFFFFF, triples & 0xFFFFFFFF, total, of, np.bincount(of, total, len(pairs)).astype(np.int64)

    a, b, c, n, of, of_pair = summed(first, second, third, count)
    c = np.where(n >= least, c, 0)
    often = of_pair[of] >= least
    return list(summed(a, np.where(often, b, 0), np.where(often, c, 0), n)[:4])


def _counts(docs: DataFrame, text: str, lang: str, id: str, least: int, cell_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(words, lang, i1, i2, i3, f) of ``phrase_counts`` with numbers for words, and (i, word): what they stand for."""
    spark = docs.sparkSession
    base = docs.select(docs[id].cast("string").alias("_id"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("_lang"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("_text"))
    total = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cells = count_for(total, cell_bytes)
    by_cell = base.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(cells)).alias("_cell"), "_lang", "_text").repartition(parts(spark), "_cell").groupBy("_cell")

    def send_words(cell: pa.Table) -> pa.Table:
        number, out = cell.column("_cell")[0].as_py(), []
        for lang, t in cell_texts(cell, cells):
            counts = np.bincount(t.flat, minlength=len(t.words))[t.order]
            for b, x, z in t.slices:
                out.append((number, b, lang, zstandard.compress(b" ".join(t.words[c] for c in t.order[x:z].tolist()), 1), packed(np.zeros(z - x), counts[x:z])))
        return _table(out)

    def number_words(bucket: pa.Table) -> pa.Table:
        """For each cell the numbers of its words, 0 for rare ones; and under no cell each numbered word."""
        place, known, out = bucket.column("bucket")[0].as_py(), {}, []
        rows = [(c, g, zstandard.decompress(w).split(b" "), unpacked(n, 2)[1].tolist()) for c, g, w, n in zip(*(bucket.column(k).to_pylist() for k in ("cell", "lang", "words", "numbers")), strict=True)]
        for _, g, words, counts in rows:
            sums = known.setdefault(g, {})
            for w, n in zip(words, counts, strict=True):
                sums[w] = sums.get(w, 0) + n
        free = 0
        for g in sorted(known):
            often = sorted(w for w, n in known[g].items() if n >= least)
            numbers = 2 + (free + np.arange(len(often), dtype=np.int64)) * cells + place
            free += len(often)
            if len(numbers) and numbers[-1] >> 32:
                raise OverflowError("more than 2**32 words are frequent")
            known[g] = dict(zip(often, numbers.tolist(), strict=True))
            if often:
                out.append((None, place, g, zstandard.compress(b" ".join(often), 1), packed(numbers)))
        out += [(c, place, g, None, packed(np.zeros(len(words)), np.fromiter((known[g].get(w, 0) for w in words), np.int64, len(words)))) for c, g, words, _ in rows]
        return _table(out)

    def send_windows(cell: pa.Table, numbered: pa.Table) -> pa.Table:
        if not len(cell):
            return _table([])
        got = {(b, g): n for b, g, n in zip(*(numbered.column(k).to_pylist() for k in ("bucket", "lang", "numbers")), strict=True)}
        out = []
        for lang, t in cell_texts(cell, cells):
            number = np.zeros(len(t.words), np.int64)
            for b, x, z in t.slices:
                number[t.order[x:z]] = unpacked(got[b, lang], 2)[1]
            columns, counts = t.windows(number)
            bucket = (columns[0] * 0x9E3779B1 + columns[1] * 0x85EBCA77) % 0x7FFFFFFF % cells
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
            for x, z in zip(cuts, [*cuts[1:], len(order)], strict=False):
                some = order[x:z]
                out.append((None, int(bucket[some[0]]), lang, None, packed(*(c[some] for c in columns), counts[some])))
        return _table(out)

    def sum_windows(bucket: pa.Table) -> pa.Table:
        rows = [unpacked(x, 4) for x in bucket.column("numbers").to_pylist()]
        *words, n = folded(*(np.concatenate(c) for c in zip(*rows, strict=True)), least)
        return pa.table([pa.array([bucket.column("lang")[0].as_py()] * len(n), pa.string()), *(pa.array(w, mask=w == 0) for w in words), pa.array(n)], ["lang", "i1", "i2", "i3", "c"])

    row = "cell long, bucket long, lang string, words binary, numbers binary"
    numbered = written(by_cell.applyInArrow(send_words, row).groupBy("bucket").applyInArrow(number_words, row))
    windows = by_cell.cogroup(numbered.where("cell IS NOT NULL").groupBy(F.col("cell").alias("_cell"))).applyInArrow(send_windows, row)
    rows = windows.groupBy("bucket", "lang").applyInArrow(sum_windows, "lang string, i1 long, i2 long, i3 long, c long")
    summed = rows.rollup("lang", "i1", "i2", "i3").agg(F.sum("c").alias("f"), F.grouping_id().alias("_level"))
    level = F.col("_level")
    words = F.when(level == 0, 3).when(level == 1, 2).when(level == 3, 1).when(level == 7, 0)
    real = F.when(level == 0, F.col("i3").isNotNull()).when(level == 1, F.col("i2").isNotNull()).when(level == 3, F.col("i1").isNotNull()).otherwise(level == 7)
    counts = summed.where(real & ((level == 7) | (F.col("f") >= least))).select(words.alias("words"), "lang", "i1", "i2", "i3", "f")

    def named(batches):
        for batch in batches:
            for w, n in zip(batch.column("words").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(n, 1)[0]), pa.array(zstandard.decompress(w).split(b" "), pa.binary())], names=["i", "word"])

    return counts, numbered.where("cell IS NULL").select("words", "numbers").mapInArrow(named, "i long, word binary")


def _with_words(df: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with each column of numbers as the column of its word."""
    for i, w in columns.items():
        df = df.join(names.select(F.col("i").alias(i), F.col("word").alias(w)), i, "left").drop(i)
    return df


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", least: int = 10, cell_bytes: int = 12_000_000) -> DataFrame:
    """(words, lang, f, w1, w2, w3): f of every phrase of 1 to 3 words with ``least`` occurrences, and of every language (words = 0); words are binary.

    Null texts are empty and null languages ``und``; a language whose texts have no word has no row. Rows that repeat count again;
    null ids are as good as any. Each cell of about ``cell_bytes`` of text, dealt by a hash of id and text, is one task's memory.
    """
    counts, names = _counts(docs, text, lang, id, least, cell_bytes)
    return _with_words(counts, names, {"i1": "w1", "i2": "w2", "i3": "w3"})


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"cell": pa.int64(), "bucket": pa.int64(), "lang": pa.string(), "words": pa.binary(), "numbers": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", least: int = 10, percent: int = 50, top: int = 2000, cell_bytes: int = 12_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 or 3 words by score, then a, then bytes of the phrase.

    a is the phrase's count, at least ``least``; l and r those of its two parts at the cut with the lowest score (ties: the first cut),
    score floor(10**6 * a * a / (l * r)), n the language's words. A phrase inside a longer one with ``percent`` of its count or more is
    left out. Sums are decimals of 38 digits. Nulls and repeated rows are as in ``phrase_counts``; no documents give no rows.
    """
    counts, names = _counts(docs, text, lang, id, least, cell_bytes)
    counts = written(counts)
    of = lambda k, *names: counts.where(F.col("words") == k).select("lang", *[F.col(f"i{i + 1}").alias(n) for i, n in enumerate(names[:-1])], F.col("f").alias(names[-1]))
    score = lambda a, l, r: F.expr(f"cast((cast(1000000 AS DECIMAL(38,0)) * {a} * {a}) div (cast({l} AS DECIMAL(38,0)) * {r}) AS BIGINT)")
    three = of(3, "i1", "i2", "i3", "a")
    longer = three.select("lang", "i1", "i2", "a").union(three.select("lang", "i2", "i3", "a")).groupBy("lang", "i1", "i2").agg(F.max("a").alias("_longer"))
    two = of(2, "i1", "i2", "a").join(longer, ["lang", "i1", "i2"], "left").where(f"_longer IS NULL OR 100 * _longer < {percent} * a").drop("_longer")
    two = two.join(of(1, "i1", "l"), ["lang", "i1"]).join(of(1, "i2", "r"), ["lang", "i2"])
    two = two.select("lang", "i1", "i2", F.lit(None).cast("long").alias("i3"), "a", "l", "r", score("a", "l", "r").alias("score"))
    three = three.join(of(2, "i1", "i2", "l2"), ["lang", "i1", "i2"]).join(of(2, "i2", "i3", "r1"), ["lang", "i2", "i3"]).join(of(1, "i1", "l1"), ["lang", "i1"]).join(of(1, "i3", "r2"), ["lang", "i3"])
    three = three.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    low = F.col("s1") <= F.col("s2")
    three = three.select("lang", "i1", "i2", "i3", "a", F.when(low, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(low, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    found = _with_words(two.union(three), names, {"i1": "w1", "i2": "w2", "i3": "w3"})
    phrase = F.concat("w1", F.lit(b" "), "w2", F.when(F.col("w3").isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b" "), "w3"))).alias("_phrase")
    ranked = in_order(found.select("lang", phrase, "a", "l", "r", "score"), [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("_phrase")])
    starts = ranked.groupBy("lang").agg(F.min("_rank").alias("_start")).join(of(0, "n"), "lang")
    ranked = ranked.join(starts, "lang").withColumn("rank", F.col("_rank") - F.col("_start") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("_phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
