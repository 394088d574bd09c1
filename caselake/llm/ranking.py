"""Ranked lexical search: the highest-scoring documents of each item, by branch and bound over document tries.

The texts are read once for each block of items: a document keeps its number of terms and, of the block's terms, those it
holds with their counts. Each task then builds tries over some ten thousand documents at a time. A document's terms stand
in order of falling document frequency, so documents share the paths of their common terms; a node knows, of the documents
below it, the largest count of each term and the smallest m and id. No document below scores more than those maxima with that m, so an
item's depth-first walk, best child first, leaves out each subtree that can't reach the item's best so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.graph import written
from caselake.operators.ranks import in_order

from .common import small_batches, texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each byte of UTF-8 as it counts in a term, and a space for those that end one.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents and term entries of one trie, and documents of a leaf.
TRIE_DOCS, TRIE_ENTRIES, LEAF = 16_384, 2_000_000, 32
#: Terms of a block of items; an item with more is a block of its own.
BLOCK_TERMS = 50_000
NO_ID = np.iinfo(np.int64).max
FOUND = "part int, item int, doc_id long, score long"


def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Trie:
    """Documents (ids, m) and their entries (terms by place in the order of frequency, counts), as a path-compressed trie.

    Nodes are runs of the documents sorted by their lists of terms; a run is cut where neighbours share no longer list than all of it
    shares, down to leaves of ``LEAF`` documents or of documents with one list. Small siblings share a leaf.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, lists: list[np.ndarray], counts: list[np.ndarray], terms: int) -> None:
        keys = [x.astype(">u4").tobytes() for x in lists]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        self.ids, self.m, self.terms = ids[order], m[order], terms
        self.ptr = np.cumsum([0, *(len(lists[k]) for k in order)])
        self.term, self.tf = np.concatenate([lists[k] for k in order]), np.concatenate([counts[k] for k in order])
        self.shared = np.zeros(len(ids), np.int64)
        for k in range(1, len(ids)):
            a, b = lists[order[k - 1]], lists[order[k]]
            n = min(len(a), len(b))
            unlike = a[:n] != b[:n]
            self.shared[k] = unlike.argmax() if unlike.any() else n
        self._grow()

    def _grow(self) -> None:
        span, children = [(0, len(self.ids))], [[]]
        k = 0
        while k < len(span):
            lo, hi = span[k]
            inner = self.shared[lo + 1 : hi]
            depth = inner.min() if len(inner) else 0
            if hi - lo > LEAF and inner.max() > depth or hi - lo > LEAF and depth < (self.ptr[lo + 1 : hi + 1] - self.ptr[lo:hi]).max():
                cuts = [lo, *(lo + 1 + np.flatnonzero(inner == depth)).tolist(), hi]
                at = lo
                for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
                    # a sibling that starts at a joins the run before it only while both together are a small leaf
                    if b - at > LEAF:
                        children[k].append(len(span))
                        span.append((at, a))
                        children.append([])
                        at = a
                children[k].append(len(span))
                span.append((at, hi))
                children.append([])
            k += 1
        self.span, self.children = span, children
        self.low_m = np.array([self.m[a:b].min() for a, b in span])
        self.low_id = np.array([self.ids[a:b].min() for a, b in span])
        most, have = np.zeros(self.terms, np.int64), [None] * len(span)
        for k in range(len(span) - 1, -1, -1):
            a, b = self.ptr[span[k][0]], self.ptr[span[k][1]]
            parts = [have[c] for c in children[k]] or [(self.term[a:b], self.tf[a:b])]
            for t, tf in parts:
                np.maximum.at(most, t, tf)
            t = np.unique(np.concatenate([x for x, _ in parts]))
            have[k] = t, most[t]
            most[t] = 0
        term, node, tf = np.concatenate([t for t, _ in have]), np.repeat(np.arange(len(span)), [len(t) for t, _ in have]), np.concatenate([x for _, x in have])
        by_term = np.argsort(term, kind="stable")
        self.node, self.most, self.first = node[by_term], tf[by_term], np.searchsorted(term[by_term], np.arange(self.terms + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, a score that no document below it exceeds."""
        out = np.zeros(len(self.span), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            rows = slice(self.first[t], self.first[t + 1])
            out[self.node[rows]] += w * score(self.most[rows], self.low_m[self.node[rows]])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: Best) -> None:
        """Offer ``best`` each document that can be among an item's best. ``weight_of``: zeros, one for each term."""
        bound = self.bounds(terms, weights)
        weight_of[terms] = weights
        stack = [0]
        while stack:
            k = stack.pop()
            if not best.takes(int(bound[k]), int(self.low_id[k])):
                continue
            if self.children[k]:
                stack += sorted(self.children[k], key=bound.__getitem__)
                continue
            lo, hi = self.span[k]
            a, b = self.ptr[lo], self.ptr[hi]
            w = weight_of[self.term[a:b]]
            hit = np.flatnonzero(w)
            doc = np.repeat(np.arange(hi - lo), np.diff(self.ptr[lo : hi + 1]))[hit]
            total = np.zeros(hi - lo, np.int64)
            np.add.at(total, doc, w[hit] * score(self.tf[a:b][hit], self.m[lo:hi][doc]))
            best.offer(total, self.ids[lo:hi])
        weight_of[terms] = 0


class Best:
    """The ``top`` documents so far, highest score first, ties to the smaller id."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def takes(self, most: int, low_id: int) -> bool:
        """Whether a document with at most this score and at least this id could be among them."""
        if most <= 0 or len(self.ids) < self.top:
            return most > 0
        worst = int(self.scores[-1])
        return most > worst or most == worst and low_id < int(self.ids[-1])

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores > 0
        if len(self.ids) == self.top:
            keep &= (scores > self.scores[-1]) | (scores == self.scores[-1]) & (ids < self.ids[-1])
        if keep.any():
            s, i = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((i, -s))[: self.top]
            self.scores, self.ids = s[order], i[order]


def item_terms(items: DataFrame, id: str, text: str, block_terms: int) -> DataFrame:
    """(item, term, block): each item's terms once, items in blocks of about ``block_terms`` terms. Rows of one id are one item; ids may be null."""
    words = F.regexp_extract_all(F.translate(items[text].cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    each = written(items.select(items[id].cast("long").alias("item"), F.explode(words).alias("term")).distinct())
    sizes = in_order(each.groupBy("item").agg(F.count("*").alias("_terms")), [F.col("item")], {"_before": "_terms"})
    blocks = sizes.select(F.col("item").alias("_item"), F.floor(F.col("_before") / block_terms).cast("int").alias("block"))
    return written(each.join(blocks, F.col("item").eqNullSafe(F.col("_item"))).select("item", "term", "block"))


def restricted(docs: DataFrame, code: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, codes, tfs) of documents (_id, _text binary): how many terms a text has, and of the terms in ``code`` which it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = code.get
        for batch in batches:
            n, sizes, codes, tfs = [], [0], [], []
            for raw in texts_of(batch.column("_text")):
                words = raw.translate(FOLD).split()
                n.append(len(words))
                seen = Counter(map(get, words))
                seen.pop(None, None)
                codes += seen.keys()
                tfs += seen.values()
                sizes.append(len(codes))
            lists = (pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, kind)) for v, kind in ((codes, pa.int32()), (tfs, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<bigint>")


def _searched(vectors: DataFrame, place: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """(part, item, doc_id, score): the best documents of each item in each task. ``place``: a code's place in the order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, weight_of = [Best(top) for _ in items], np.zeros(len(place), np.int64)

        def grown(parts: list[tuple]) -> None:
            trie = Trie(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]], [x for p in parts for x in p[3]], len(place))
            for (terms, weights), b in zip(items, best, strict=True):
                trie.search(terms, weights, weight_of, b)

        held, docs, entries = [], 0, 0
        for batch in batches:
            codes, tfs = batch.column("codes"), batch.column("tfs")
            ptr = codes.offsets.to_numpy()
            t, f = place[codes.values.to_numpy()], tfs.values.to_numpy()
            order = np.lexsort((t[ptr[0] : ptr[-1]], np.repeat(np.arange(len(codes)), np.diff(ptr)))) + ptr[0]
            t, f, cuts = t[order], f[order], (ptr[1:-1] - ptr[0])
            held.append((batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("m").to_numpy(), np.split(t, cuts), np.split(f, cuts)))
            docs, entries = docs + len(codes), entries + len(t)
            if docs >= TRIE_DOCS or entries >= TRIE_ENTRIES:
                grown(held)
                held, docs, entries = [], 0, 0
        if held:
            grown(held)
        part = TaskContext.get().partitionId()
        item = np.repeat(np.arange(len(items)), [len(b.ids) for b in best]).astype(np.int32)
        ids, scores = (np.concatenate([getattr(b, k) for b in best]) if best else np.zeros(0, np.int64) for k in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), part, np.int32)), pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["part", "item", "doc_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def _first(df: DataFrame, by: list[str], top: int) -> DataFrame:
    best: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``top`` documents with the highest score above 0, ties by ascending id.

    Rows of ``items`` with one id (null too) are one item with the terms of all its texts. Each row of ``docs`` is a document, also
    where ids repeat; null ids stand after all others and come back as null. Null texts and texts without terms
    match nothing and don't count. Ids are read as long, no other columns are read. No documents, items or common terms give no rows.

    The items' terms and weights go to all tasks, in blocks of about ``block_terms`` terms, so their size is
    bounded whatever the number of items; a block costs a pass over the texts. Tasks send ``top`` rows an item, which meet in two steps.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(docs[id].cast("long").alias("_id"), docs[text].cast("string").cast("binary").alias("_text")).where("_text is not null")
    asked = item_terms(items, item, item_text, block_terms)
    blocks = asked.agg(F.max("block")).first()[0]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(-1 if blocks is None else blocks + 1):
        rows = asked.where(F.col("block") == block).select("item", F.col("term").cast("binary").alias("term")).collect()
        words = sorted({bytes(r["term"]) for r in rows})
        code = {w: k for k, w in enumerate(words)}
        vectors = written(restricted(base, code))
        n_docs, n_terms = vectors.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
        if not n_terms:
            continue
        counted = vectors.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
        known = {r["code"]: (r["df"], r["w"]) for r in counted.withColumn("w", F.expr(f"cast(floor(1000 * ln((2 * {n_docs}L + 2) / (2 * df + 1))) as bigint)")).collect()}
        order = sorted(range(len(words)), key=lambda c: (-known.get(c, (0, 0))[0], c))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        lists: dict = {}
        for r in rows:
            c = code[bytes(r["term"])]
            if c in known:
                lists.setdefault(r["item"], []).append((int(place[c]), known[c][1]))
        names = list(lists)
        pairs = [tuple(np.array(x, np.int64) for x in zip(*lists[k], strict=True)) for k in names]
        with_m = vectors.where("size(codes) > 0").select("doc_id", F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L").alias("m"), "codes", "tfs")
        found = _first(_searched(with_m, place, pairs, top).withColumn("_group", F.shiftright("part", 7)), ["item", "_group"], top)
        found = _first(found, ["item"], top)
        ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
        out = out.union(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))  # the ids of one block
    return out
