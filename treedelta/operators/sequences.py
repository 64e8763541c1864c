"""Line and word diffs, trees, and longest increasing runs as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..adapters.prose import diff_words
from ..kernel.pair import parse_tree
from ..kernel.script import increasing
from ..kernel.sequence import Hunk, diff_lines, diff_sequences, common_length
from ..kernel.tree import Tree
from ..schemas import HUNK, TREE_NODE, spark_type

HUNKS = T.ArrayType(spark_type(HUNK))


def _hunks(make, old: pa.Array, new: pa.Array) -> pa.Array:
    rows = []
    for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True):
        found: list[Hunk] = make(a or "", b or "")
        rows.append([dict(zip(("op", "old_text", "new_text"), h, strict=True)) for h in found])
    return pa.array(rows, pa.list_(HUNK))


@F.arrow_udf(HUNKS)
def line_hunks(old: pa.Array, new: pa.Array) -> pa.Array:
    """Hunks of lines; null counts as empty."""
    return _hunks(diff_lines, old, new)


@F.arrow_udf(HUNKS)
def word_hunks(old: pa.Array, new: pa.Array) -> pa.Array:
    """Hunks of words and white space; null counts as empty."""
    return _hunks(diff_words, old, new)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])))
def line_ops(old: pa.Array, new: pa.Array) -> pa.Array:
    """Insert, Delete and Equal of the lines between common head and tail."""
    rows = [[{"op": o, "text": t} for o, t in diff_sequences((a or "").split("\n"), (b or "").split("\n"))] for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))


@F.arrow_udf(T.IntegerType())
def lcs_length(old: pa.Array, new: pa.Array) -> pa.Array:
    """Length of a longest common subsequence of two arrays of strings."""
    return pa.array([common_length(a or [], b or []) for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(T.IntegerType())
def increasing_length(values: pa.Array) -> pa.Array:
    """Length of a longest strictly increasing subsequence of an array of numbers."""
    return pa.array([len(increasing(v or [])) for v in values.to_pylist()], pa.int32())


def trimmed(old: Column, new: Column) -> tuple[Column, Column]:
    """Lengths of the common head and tail of two arrays, without Python; the tail leaves out the head."""
    n = F.least(F.size(old), F.size(new))

    def run(a: Column, b: Column, most: Column) -> Column:
        # The place of the first difference among the leading `most` items.
        differ = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: ~x.eqNullSafe(y))
        at = F.array_position(differ, F.lit(True))
        return F.when(most <= 0, F.lit(0)).when(at == 0, most).otherwise(at - 1).cast("int")

    head = run(old, new, n)
    return head, run(F.reverse(old), F.reverse(new), n - head)


#: Texts, or nodes, of one Arrow batch that parse gives back.
BATCH_TEXTS, BATCH_NODES = 2_000, 20_000


def parse(df: DataFrame, text_col: str, tier: int, id_col: str = "pair_id", extension: str = "") -> DataFrame:
    """One row per node of each text's tree, in postorder; texts that can't be parsed have none.

    Texts are dealt over all tasks first, since small texts come in files that are one task's work.
    """
    schema = pa.schema([("pair_id", pa.int64()), *TREE_NODE])

    def batch_of(keys: list, found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(found[f.name], f.type) for f in TREE_NODE]], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, n = [], {f.name: [] for f in TREE_NODE}, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    columns = Tree(parse_tree(text or "", tier, extension)).columns()
                except Exception:  # noqa: BLE001, S112 - no tree, no rows
                    continue
                n += 1
                keys += [key] * len(columns["node_id"])
                for name, values in found.items():
                    values += columns[name]
                if n >= BATCH_TEXTS or len(keys) >= BATCH_NODES:
                    yield batch_of(keys, found)
                    keys, found, n = [], {f.name: [] for f in TREE_NODE}, 0
        if keys:
            yield batch_of(keys, found)

    rows = df.select(F.col(id_col).cast("long").alias("pair_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id", F.xxhash64("text"))
    return dealt.mapInArrow(make, T.StructType([T.StructField("pair_id", T.LongType()), *spark_type(TREE_NODE).fields]))


def reordered(siblings: DataFrame) -> DataFrame:
    """Of siblings kept by a parent (pair_id, parent_id, old_pos, new_pos) those outside a longest run that kept its order."""

    def outside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("old_pos", kind="stable").reset_index(drop=True)
        return pdf[~pdf.index.isin(increasing(pdf.new_pos.tolist()))]

    return siblings.groupBy("pair_id", "parent_id").applyInPandas(outside, siblings.schema)
