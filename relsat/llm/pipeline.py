"""The stages of the corpus pipeline, for ``corpus_pipeline.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relsat.llm import decontaminate, jaccard, language, mixing, token_files
from relsat.operators.staging import forget, staged

STAGES = [
    ("language_id", language.stage),
    ("jaccard_join", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
    ("token_files", token_files.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and
    removed when the next one is written.

    Nulls, empty and long texts, repeated rows and numbers, ties and empty tables are each
    stage's own matter, as its module states; columns beyond those of ``documents``, whatever
    their names, are carried along up to the last stage. ``token_files.stage`` takes a folder
    in which the files stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return docs
