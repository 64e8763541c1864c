"""Counts of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = (("Insert", "addition"), ("Delete", "deletion"), ("Update", "modification"), ("Move", "move"))


def _sentence(prefix: Column | None = None) -> Column:
    parts = [F.when(F.col(f"n_{a.lower()}") > 0, F.concat(F.col(f"n_{a.lower()}").cast("string"), F.lit(f" {w}"), F.when(F.col(f"n_{a.lower()}") > 1, "s").otherwise(""))) for a, w in _WORDS]
    text = F.concat_ws(", ", *parts)
    full = text if prefix is None else F.concat(prefix, F.lit(": "), text)
    return F.when(text == "", F.lit("no logical changes")).otherwise(full)


def action_counts(changes: DataFrame, *by: str) -> DataFrame:
    """n_insert, n_delete, n_update and n_move."""
    return changes.groupBy(*by).agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a, _ in _WORDS])


def summarize(changes: DataFrame, by: str | None = None) -> DataFrame:
    """summary of all changes, or of each value of `by`, which then leads the sentence."""
    counts = action_counts(changes, *([by] if by else []))
    return counts.withColumn("summary", _sentence(F.col(by) if by else None))


def summary_by(changes: DataFrame, *by: str) -> DataFrame:
    """Counts on all levels of a rollup; null stands for all."""
    return changes.rollup(*by, "action").agg(F.count("*").alias("n_changes"))
