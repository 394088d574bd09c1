"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, ragged, small_batches, texts_of
from .words import Known, word_spans

#: ASCII letters in lower case, and signs that may close a word; the sign that ends the tokenizer's special strings isn't one.
LETTER = np.isin(np.arange(256), np.arange(97, 123))
SIGN = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != ">"])
#: Bytes of words that may go to the tokenizer many at a time.
PLAIN = LETTER | np.isin(np.arange(256), [*range(65, 91), *range(128, 256)])
#: Words that are encoded together.
JOINED = 100


def _closing_signs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the signs after their last letter split off, where that letter is an ASCII one: there the tokenizer splits, too."""
    if not len(first):
        return first, last
    tail = np.maximum.accumulate(np.where(SIGN[data], -1, np.arange(len(data))))[last - 1] + 1
    hit = np.flatnonzero((tail > first) & (tail < last))
    hit = hit[LETTER[data[tail[hit] - 1]]]
    at = np.r_[first, tail[hit]]
    order = np.argsort(at, kind="stable")
    ends = last.copy()
    ends[hit] = tail[hit]
    return at[order], np.r_[ends, last[hit]][order]


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokenizer lower-cases and never joins across white space.

    Each distinct word, known by its 64-bit hash, is encoded once and kept; the store is emptied when it holds ``limit`` words, so
    memory is bounded whatever the text. Runs of letters go to the tokenizer many at a time and are cut
    at the ids that end a word; everything else goes word by word. The result equals encoding the whole
    text, special-token strings included.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.codes, self.flat, self.start, self.size = Known(), Grown(dtype=np.int32), Grown(dtype=np.int64), Grown(dtype=np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and how many each has."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, words: list[bytes]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        plain = np.logical_and.reduceat(PLAIN[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes) - sizes)
        many, single = np.flatnonzero(plain), np.flatnonzero(~plain)
        groups = [many[k : k + JOINED] for k in range(0, len(many), JOINED)]
        ids, n = self._ids([b" ".join([words[k] for k in g.tolist()]).decode("utf-8", "replace") for g in groups])
        last = np.cumsum(n)
        ends = np.flatnonzero(self.ends[ids]) + 1
        upto = np.searchsorted(ends, np.r_[0, last], side="right")
        whole = (np.diff(upto) == np.fromiter(map(len, groups), np.int64, len(groups))) & (ends[upto[1:] - 1] == last if len(ends) else np.zeros(len(groups), bool))
        size, start = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        good = np.repeat(whole, [len(g) for g in groups])
        mine = ends[np.repeat(whole, np.diff(upto))]
        before = np.r_[0, ends][:-1][np.repeat(whole, np.diff(upto))]
        before = np.maximum(before, np.repeat(last - n, [len(g) for g in groups])[good])
        start[many[good]], size[many[good]] = self.flat.n + before, mine - before
        self.flat.add(ids)
        single = np.r_[single, many[~good]]
        ids, n = self._ids([words[k].decode("utf-8", "replace") for k in single.tolist()])
        start[single], size[single] = self.flat.n + np.cumsum(n) - n, n
        self.flat.add(ids)
        self.start.add(start)
        self.size.add(size)

    def _code(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts, and how many words each text has."""
        if len(self.codes) > self.limit:
            self._clear()
        texts = texts_of(column)
        raw = b" ".join(texts)
        start, end, h = word_spans(raw, _closing_signs)
        marks = np.flatnonzero(np.frombuffer(raw, np.uint8) == ord("<"))
        for k in np.unique(np.searchsorted(start, marks, side="right") - 1).tolist():  # may be a special string, whose case counts
            h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
        codes, new = self.codes.of(h)
        if len(new):
            self._learn([raw[a:z] for a, z in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return codes, np.diff(np.searchsorted(start, np.r_[0, ends]))

    def lengths(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        codes, words = self._code(column)
        total = np.r_[0, np.cumsum(self.size.a[codes], dtype=np.int64)]
        return np.diff(total[np.r_[0, np.cumsum(words)]])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        codes, words = self._code(column)
        sizes = self.size.a[codes]
        ids, total = self.flat.a[ragged(self.start.a[codes], sizes)], np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        at = total[np.r_[0, np.cumsum(words)]].tolist()
        return [ids[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row (n_tokens long) for each document; null and empty texts have none, so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(coder.lengths(b.column(0)), pa.int64())], ["n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs): documents of each exact encoded length; summed before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def context_report(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """What every context limit keeps, from suffix sums over the histogram.

    One row for each length that occurs, read as a limit L: ``docs`` of exactly L, ``docs_over`` (longer than
    L), ``tokens_kept`` = sum(min(length, L)), ``tokens_cut`` = sum(max(length - L, 0)), ``docs_total``,
    ``tokens_total`` and ``rank_share``, the share of documents of at most L tokens (its inverse is the
    quantile). Limits between two lengths follow from these rows without the documents. Suffix sums run
    inside blocks of ``block`` lengths; sums of whole blocks, at most one row for each ``block`` lengths,
    are added to them. No documents: no rows.
    """
    h = histogram.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("docs").cast("long").alias("docs"), F.floor(F.col("n_tokens") / block).alias("_b"))
    sums = h.groupBy("_b").agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("_t"))
    listed = sums.agg(F.collect_list(F.struct("_b", "_d", "_t")).alias("_all"))
    from pyspark.sql import Window

    w = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inner = h.withColumns({"_di": F.coalesce(F.sum("docs").over(w), F.lit(0)), "_ti": F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(w), F.lit(0))})
    later = lambda f: F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.when(x["_b"] > F.col("_b"), x[f]).otherwise(F.lit(0).cast("long")))
    whole = lambda f: F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x[f])
    full = inner.crossJoin(F.broadcast(listed)).withColumns({"docs_over": F.col("_di") + later("_d"), "_over": F.col("_ti") + later("_t"), "docs_total": whole("_d"), "tokens_total": whole("_t")})
    cut = F.col("_over") - F.col("docs_over") * F.col("n_tokens")
    return full.select("n_tokens", "docs", "docs_over", (F.col("tokens_total") - cut).alias("tokens_kept"), cut.alias("tokens_cut"), "docs_total", "tokens_total", ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("rank_share"))


