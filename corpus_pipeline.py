"""A training-corpus pipeline over documents, in stages that each call one operator of treedelta.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treedelta.llm import mixing, neardup, pieces, quality, secrets
from treedelta.llm.common import written

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("secret scans", secrets.stage),
    ("mixing sources to target weights", mixing.stage),
    ("SentencePiece encoding and decoding", pieces.stage),
]

#: Some stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage{at}")
    return docs
