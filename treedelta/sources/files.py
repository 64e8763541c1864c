"""Pairs of files from two directories, and single pairs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import pair_snapshots

#: Directories that are never looked into.
SKIP_DIRS = ".git node_modules dist build out target .next .turbo .cache vendor __pycache__ .venv".split()


def _relative(root: str) -> Column:
    # binaryFile gives URIs with a scheme; what follows the root is the path.
    clean = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return F.substring(clean, F.lit(len(root.rstrip("/")) + 2), F.length(clean))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and content (UTF-8, other bytes replaced) of all regular files below a directory but for SKIP_DIRS."""
    base = str(Path(root).resolve()) if "://" not in root else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "content")
    rows = files.select(_relative("/" + base.split("://", 1)[-1].lstrip("/")).alias("path"), "content")
    kept = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in SKIP_DIRS])))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"))


def diff_directories(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Pairs of the union of both directories' relative paths."""
    return pair_snapshots(read_files(spark, old), read_files(spark, new))


def read_file_pair(spark: SparkSession, old: str, new: str) -> DataFrame:
    """One pair; an error names the file that can't be read."""
    texts = []
    for path in (old, new):
        try:
            texts.append(Path(path).read_text(encoding="utf-8", errors="replace"))
        except OSError as error:
            raise FileNotFoundError(f"cannot read {path}: {error.strerror}") from error
    return spark.createDataFrame([(0, old, new, *texts)], "pair_id long, old_path string, new_path string, old_source string, new_source string")
