"""Stages of the corpus pipeline; each calls one operator and returns the columns of ``documents`` but the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators.ranks import in_order

from . import language, lines, packing, setjoin, suffixes
from .common import stored
from .queries import HELD_OUT, PIECE_BPE, WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, with the predicted one as ``lang``: those without text or letters go."""
    known = language.vocabulary(public_tokenizers.path(PIECE_BPE))
    langs, p = language.fit(docs.where(f"not {HELD_OUT}"), known)
    found = language.predict(docs.select(*COLUMNS), known, langs, p).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; a document whose every line went keeps an empty text."""
    return lines.drop_similar_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id. Five words a shingle, similarity 0.8.

    Rows are judged one by one: where ids repeat, which is rare, rows get numbers by id and text of their own, and of rows alike in both the
    first stays. Rows of a null id stay, and so do null and empty texts; columns but those of ``documents`` go; an empty table stays empty.
    """
    near = lambda rows, id: setjoin.jaccard_components(rows, id=id, words=5, percent=80).where("component_id < _id").select(F.col("_id").alias(id)).distinct()
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(near(docs, "doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    rows = stored(in_order(docs.select(*COLUMNS), [F.col(c) for c in COLUMNS]))
    numbered = rows.where("doc_id is not null")
    return rows.join(near(numbered, "_rank"), "_rank", "left_anti").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 50-byte string that an earlier document has too go; split characters are read as replacement signs."""
    kept = suffixes.repeated_spans(docs, keep=("doc_id", "lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return kept.select("_extra.doc_id", text.alias("text"), "_extra.lang", "_extra.source", F.length(text).cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens from every document that is left."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(WORD_BPE)))
