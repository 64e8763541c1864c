"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator of one row, so that later uses refer to them and don't repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole to the driver and all executors.

    Files of ids pack so well that their size, which a plan goes by, says little about their rows.
    """
    return df.hint("merge")
