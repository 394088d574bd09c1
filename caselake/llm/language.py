"""Language ID: unigram models over a fixed public vocabulary, every segmentation of a word summed by a forward pass.

A word is taken with the mark that starts it in the vocabulary. Its probability in a language is the sum over all its segmentations into pieces of the
product of the language's piece probabilities. Those are learned by expectation maximisation over the same
lattices, from a bounded sample of labelled documents. A text's score is the sum over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Codes, Grown, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: In learning, and only there, longer words teach in parts of this size.
PART = 32
#: Words of up to so many characters are scored together; each longer one alone.
SHORT = 64
#: Positions after which sums are scaled anew, so that those of long words don't vanish.
SCALED = 16
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-7


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model as text, its control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]


def words_of(text: str | None) -> list[str]:
    """Runs of letters; numbers that aren't digits, such as fractions and Roman numerals, are none."""
    words = LETTERS.findall(text.lower()) if text else []
    if "".join(words).isalpha() or not words:
        return words
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


class Lattices:
    """Edges (word, start, end, piece) of many words' piece lattices."""

    def __init__(self, pieces: list[str]) -> None:
        self.at = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, words: list[str]) -> np.ndarray:
        """Rows of edges; a character that no piece covers is an edge of piece -1."""
        get, most, out = self.at.get, self.longest, []
        for k, word in enumerate(words):
            n = len(word)
            for i in range(n):
                one = get(word[i])
                out.append((k, i, i + 1, -1 if one is None else one))
                for j in range(i + 2, min(n, i + most) + 1):
                    p = get(word[i:j])
                    if p is not None:
                        out.append((k, i, j, p))
        return np.array(out, np.int32).reshape(-1, 4)


def forward(edges: np.ndarray, n_words: int, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]; p: (pieces + 1, languages), the last row for uncovered characters."""
    return scaled_forward(edges, n_words, sizes, p, 0)[0]


def scaled_forward(edges: np.ndarray, n_words: int, sizes: np.ndarray, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``forward`` and the logarithm of what each word's last sum was multiplied by; sums are scaled where ``longest``, the longest piece, is given."""
    alpha, scale = np.zeros((n_words, int(sizes.max(initial=0)) + 1, p.shape[1])), np.zeros((n_words, p.shape[1]))
    alpha[:, 0] = 1
    edges = edges[np.lexsort((edges[:, 0], edges[:, 2]))]
    for step in np.split(edges, np.searchsorted(edges[:, 2], np.arange(2, alpha.shape[1]))) if len(edges) else []:
        if len(step):
            first, at = np.flatnonzero(np.r_[True, step[1:, 0] != step[:-1, 0]]), step[0, 2]
            now = np.add.reduceat(alpha[step[:, 0], step[:, 1]] * p[step[:, 3]], first, axis=0)
            word = step[first, 0]
            alpha[word, at] = now
            if longest and at % SCALED == 0:
                now = np.maximum(now, 1e-300)
                scale[word] -= np.log(now)
                low = max(0, at - longest)
                alpha[word, low : at + 1] /= now[:, None]
    return alpha, scale


def log_likelihood(lattices: Lattices, words: list[str], p: np.ndarray) -> np.ndarray:
    """log P(word) for each language, over all segmentations of the whole word with its mark."""
    marked = [MARK + w for w in words]
    sizes, out = np.fromiter(map(len, marked), np.int64, len(marked)), np.zeros((len(marked), p.shape[1]))
    short = np.flatnonzero(sizes <= SHORT)
    for some in [short, *np.flatnonzero(sizes > SHORT)[:, None]]:
        if len(some):
            alpha, scale = scaled_forward(lattices.edges([marked[k] for k in some]), len(some), sizes[some], p, lattices.longest)
            out[some] = np.log(np.maximum(alpha[np.arange(len(some)), sizes[some]], 1e-300)) - scale
    return out


def learn(lattices: Lattices, counts: list[Counter], n_pieces: int, steps: int = 3) -> np.ndarray:
    """Piece probabilities of each language by expectation maximisation over its word counts; (n_pieces + 1, languages)."""
    out = np.full((n_pieces + 1, len(counts)), UNKNOWN)
    for k, c in enumerate(counts):
        weights = Counter()
        for w, n in c.items():
            for i in range(0, len(w) + 1, PART):
                weights[(MARK + w)[i : i + PART]] += n
        words = list(weights)
        sizes, mass = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(weights.values(), float, len(words))
        edges = lattices.edges(words)
        known = edges[:, 3] >= 0
        p = np.full((n_pieces + 1, 1), 1.0 / n_pieces)
        p[-1] = UNKNOWN
        for _ in range(steps if len(words) else 0):
            alpha = forward(edges, len(words), sizes, p)[:, :, 0]
            back = edges.copy()
            back[:, 1], back[:, 2] = sizes[edges[:, 0]] - edges[:, 2], sizes[edges[:, 0]] - edges[:, 1]
            beta = forward(back, len(words), sizes, p)[:, :, 0]
            total = alpha[np.arange(len(words)), sizes]
            w = edges[:, 0]
            use = mass[w] * alpha[w, edges[:, 1]] * p[edges[:, 3], 0] * beta[w, sizes[w] - edges[:, 2]] / np.maximum(total[w], 1e-300)
            got = np.bincount(edges[known, 3], use[known], n_pieces)
            p[:-1, 0] = (got + 0.01) / (got.sum() + 0.01 * n_pieces)
        out[:-1, k] = p[:-1, 0]
    return out


def fit(docs: DataFrame, pieces: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 300, max_langs: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from at most ``sample_docs`` labelled documents of each language.

    The sample is the rows of smallest hash of the id, the same whatever the partitions; whole texts are
    used, and their word counts are gathered on the driver. Rows without a language or id teach nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("i is not null and l is not null")
    langs = sorted(r[0] for r in rows.select("l").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = rows.select("i", "l").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs).drop("r")  # each task keeps its smallest before the shuffle

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, Counter] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(x, Counter()).update(words_of(t))
            cols = list(zip(*[(x, w, n) for x, c in got.items() for w, n in c.items()], strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["l", "w", "n"])

    sample = rows.join(F.broadcast(chosen), ["i", "l"]).select("l", "t").mapInArrow(count, "l string, w string, n long")
    counts = {x: Counter() for x in langs}
    for b in sample.groupBy("l", "w").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for x, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts[x][w] = n
    return langs, learn(Lattices(pieces), [counts[x] for x in langs], len(pieces))


def predict(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language under equal priors.

    Texts that are null or without a letter, and every text when no language was learned, get ``und`` and 0.
    Ties go to the language first in the alphabet. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((pieces, p))
    kept = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = model.value
        lattices, codes, values = Lattices(known), Codes(), Grown(len(langs))
        for b in batches:
            if len(codes) > 500_000:
                codes, values = Codes(), Grown(len(langs))
            got = [codes.of(words_of(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            for k in range(0, len(codes.new), 20_000):
                values.add(log_likelihood(lattices, codes.new[k : k + 20_000], table))
            codes.new = []
            pred, score = [], []
            for c in got:
                if not len(c) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = values.a[c].sum(axis=0)
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    out = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return kept.select("*", docs[text].cast("string").alias(f"_text_{len(kept.columns)}_{uuid.uuid4().hex}")).mapInArrow(run, out)
