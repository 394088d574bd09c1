"""The corpus pipeline: documents in, packed sequences out; each stage calls one operator of ``caselake.llm``.

Every stage works on all its predecessor kept and is written as Parquet before the next one starts. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselake.llm import stages
from caselake.operators.graph import shared_folder

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("suffix_array_dedup", stages.suffix_array_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The tokenizer, the language models and the suffix sort are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = posixpath.join(shared, f"pipeline-{uuid.uuid4().hex}", name)
            docs.write.parquet(out)
            docs = spark.read.parquet(out)
    return docs
