"""From raw documents to encoded training text: language, near duplicates, mixture, pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from harmonium.llm.jaccard_join import stage_near_duplicates
from harmonium.llm.langid import stage_language
from harmonium.llm.mixing import stage_mix
from harmonium.llm.sentencepiece import stage_encode
from harmonium.session import shared_folder, tune

#: Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
STAGES = [
    ("language_id", stage_language),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("pfair_mixing", stage_mix),
    ("sentencepiece", stage_encode),
]

#: No stage after mixing is expressible in SQL (hashed trigram models, piece lattices); tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    tune(spark)
    root = f"{shared_folder(spark)}/harmonium/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
