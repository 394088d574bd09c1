"""The pipeline's stages with nulls, repeated rows and ids, clashing extra columns and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from caselake.llm import language, stages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rank int, component_id string, key int"
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of old herbs and honey tonight in the great hall"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA)


ROWS = [(1, WORDS), (2, WORDS + " again"), (3, WORDS + " again"), (3, "something else entirely that nobody else has written down so far"), (4, None), (5, ""), (None, WORDS), (6, "123 ½ ²"), (7, WORDS), (7, WORDS), (8, "other " * 40)]


def test_near_copies_go_row_by_row(spark):
    got = stages.ngram_jaccard_join(spark, docs(spark, ROWS), "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("1", WORDS), ("3", ROWS[3][1]), ("4", ""), ("5", ""), ("None", WORDS), ("6", "123 ½ ²"), ("8", "other " * 40)])
    once = stages.ngram_jaccard_join(spark, docs(spark, [r for k, r in enumerate(ROWS) if k not in (3, 9)]), "").collect()
    assert sorted(r["doc_id"] for r in once if r["doc_id"]) == [1, 4, 5, 6, 8]


def test_texts_without_letters_have_no_language(spark):
    assert language.words_of("½ ² Ⅳ 12 _") == [] and language.words_of("Ünïcode 3x") == ["ünïcode", "x"]
    got = stages.language_id(spark, docs(spark, ROWS), "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "7", "7", "8", "None"]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_every_stage_and_the_whole(spark, rows):
    d = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == COLUMNS, name
        d = spark.createDataFrame([tuple(r) for r in d.collect()], d.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    assert len(packed) >= len({r["doc_id"] for r in packed}) and bool(packed) == bool(rows)
