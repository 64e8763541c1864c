"""Diffs of keyed rows, in Catalyst alone: what tree matching comes to for flat objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def row_value_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """keys, column, from_value, to_value of each column that differs, null-safe, in rows of both sides; values as strings."""
    columns = columns or [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("was"))
    b = new.select(*keys, F.struct(*columns).alias("now"))
    both = a.join(b, keys).filter(~F.col("was").eqNullSafe(F.col("now")))
    cells = F.filter(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"was.{c}").cast("string").alias("from_value"), F.col(f"now.{c}").cast("string").alias("to_value"), F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")).alias("same")) for c in columns]),
        lambda x: ~x["same"],
    )
    return both.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.column", "x.from_value", "x.to_value")


def rows_inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is only in new."""
    return new.join(old.select(*keys), keys, "left_anti")


def rows_deleted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is only in old."""
    return old.join(new.select(*keys), keys, "left_anti")


def uncovered(nodes: DataFrame, partners: DataFrame) -> DataFrame:
    """Unmatched nodes whose parent is matched or absent: one per subtree that came or went.

    nodes has pair_id, node_id and parent_id; partners has pair_id and node_id.
    """
    free = nodes.join(partners, ["pair_id", "node_id"], "left_anti")
    parents = free.select("pair_id", F.col("node_id").alias("parent_id"))
    return free.join(parents, ["pair_id", "parent_id"], "left_anti")


def unique_anchors(old: DataFrame, new: DataFrame, key: Column | str) -> DataFrame:
    """Pairs of rows whose key occurs once on either side: matches that depend on no order."""
    once = lambda rows, name: rows.groupBy(F.col(key) if isinstance(key, str) else key).agg(F.count("*").alias("n"), F.min("node_id").alias(name)).filter("n = 1").drop("n")
    k = key if isinstance(key, str) else "key"
    return once(old, "old_id").join(once(new, "new_id"), k)


#: Containers of an item in one list at most; items of an old container that count in one task at most, about.
LIST, PART = 1_000, 100_000


def _lists(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """Per item, and what else is given, its containers and their sizes as lists of bounded length."""
    at = F.row_number().over(Window.partitionBy("item").orderBy("container")) - 1
    return rows.withColumn("at", F.floor(at / LIST)).groupBy("item", "at", *by).agg(F.collect_list(F.struct("container", "n")).alias(name)).drop("at")


def shared_descendants(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_container, new_container, common, n_old, n_new, and the Dice coefficient of containers given as distinct (container, item) rows.

    Old containers are dealt by ranges, and an item goes to each range that has it once, with all of its
    containers, so pairs are counted where they are made and never shuffled.  A container of very many
    items has several tasks, each with its share of the new containers.  Where containers are so few that
    each task would make most pairs many times, items stay where they met and counts of pairs are added up.
    """
    spark = old.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    old, new = (written(side.select("container", "item").filter("container IS NOT NULL"), "items") for side in (old, new))
    (rows_a, old_n, items), (rows_b, new_n, _) = (side.agg(F.count("*"), F.approx_count_distinct("container"), F.approx_count_distinct("item")).first() for side in (old, new))
    few = old_n * new_n * tasks < rows_a * rows_b / max(items, 1)
    sizes = lambda rows: rows.groupBy("container").agg(F.count("*").alias("n"))
    ranges = written(sizes(old), "sizes").repartitionByRange(tasks, "container").select("*", F.lit(0).alias("range") if few else F.spark_partition_id().alias("range"), (F.lit(0) if few else F.floor(F.col("n") / PART)).cast("int").alias("more"))
    olds = _lists(old.filter("item IS NOT NULL").join(ranges.hint("merge"), "container"), "olds", "range", "more")
    news = _lists(new.filter("item IS NOT NULL").join(sizes(new).hint("merge"), "container"), "news")
    share = F.transform(F.sequence(F.lit(0), F.col("more")), lambda k: F.struct(k.alias("part"), F.filter("news", lambda x: F.pmod(F.xxhash64(x["container"]), F.col("more") + 1) == k).alias("news")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("news")))
    parts = olds.join(news.hint("merge"), "item").select("range", "olds", F.inline(F.when(F.col("more") == 0, whole).otherwise(share)))
    dealt = parts.select(F.lit(0).alias("task"), "olds", "news") if few else parts.select(F.pmod(F.col("range") + F.col("part"), F.lit(tasks)).alias("task"), "olds", "news").repartitionById(tasks, "task")
    pairs = dealt.select("task", F.explode("olds").alias("o"), "news").select("task", "o", F.explode("news").alias("w"))
    keys = [F.col("o.container").alias("old_container"), F.col("w.container").alias("new_container"), F.col("o.n").alias("n_old"), F.col("w.n").alias("n_new")]
    both = pairs.groupBy("task", *keys).agg(F.count("*").alias("common")).drop("task")
    return both.select("old_container", "new_container", "common", "n_old", "n_new", (2 * F.col("common") / (F.col("n_old") + F.col("n_new"))).alias("dice"))
