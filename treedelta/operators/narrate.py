"""Sentences for edit actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanize_kind, nearest_named, preview, subject
from ..plans.barrier import apart


def drop_redundant_updates(actions: DataFrame, file_col: str = "file_path") -> DataFrame:
    """Of a file's updates with equal from and to one stays: the first that has a name, else the first."""
    text = lambda c: F.coalesce(F.col(f"detail.{c}"), F.lit(""))
    unnamed = F.coalesce(F.col("node.label"), F.lit("")) == ""
    # Other actions are alone in their group, so the actions are computed and dealt once.
    alone = F.when(F.col("action") != "Update", F.col("seq"))
    w = Window.partitionBy(file_col, "pair_id", alone, text("from"), text("to")).orderBy(unnamed, "seq")
    return actions.withColumn("td_at", F.row_number().over(w)).filter("td_at = 1").drop("td_at")


def distinct_updates(diffs: DataFrame) -> DataFrame:
    """Rows of diff_pairs whose actions lack redundant updates (see drop_redundant_updates), each with its seq: a pair's actions are one row, so none is dealt."""
    text = lambda a, c: F.coalesce(a["detail"][c], F.lit(""))
    # Equal updates stand side by side once sorted, the one that stays first.
    key = lambda a, i: F.struct(text(a, "from").alias("from"), text(a, "to").alias("to"), (F.coalesce(a["node"]["label"], F.lit("")) == "").alias("unnamed"), i.alias("seq"))
    updates = F.array_sort(F.filter(F.transform("actions", lambda a, i: F.when(a["action"] == "Update", key(a, i))), lambda x: x.isNotNull()))
    rows = apart(diffs, {"td_updates": updates})
    first = lambda x, i: (i == 0) | (x["from"] != F.get("td_updates", i - 1)["from"]) | (x["to"] != F.get("td_updates", i - 1)["to"])
    kept = F.transform(F.filter("td_updates", first), lambda x: x["seq"])
    others = F.filter(F.transform("actions", lambda a, i: F.when(a["action"] != "Update", i)), lambda x: x.isNotNull())
    numbered = apart(rows, {"td_kept": F.concat(kept, others)})
    return numbered.select("pair_id", "file_path", "tier", "actions", "td_kept")


def distinct_actions(diffs: DataFrame) -> DataFrame:
    """drop_redundant_updates(edit_actions(diffs)) of rows of diff_pairs, without a shuffle."""
    rows = distinct_updates(diffs)
    one = F.transform("td_kept", lambda i: F.struct(i.alias("seq"), F.get("actions", i).alias("a")))
    return rows.select("pair_id", "file_path", "tier", F.inline(one)).select("pair_id", "file_path", "tier", "seq", "a.*")


def _scope(near: Column) -> Column:
    return F.concat(humanize_kind(near["kind"]), F.lit(" `"), near["label"], F.lit("`"))


def description(bare: Column | None = None, what: Column | None = None, scope: Column | None = None) -> Column:
    """The sentence of one action; its parts are made here unless they are given."""
    bare = humanize_kind(F.col("node.kind")) if bare is None else bare
    what = subject(bare, F.col("node.label"), F.col("node.value")) if what is None else what
    scope = _scope(nearest_named(F.col("context"))) if scope is None else scope
    within = F.coalesce(F.concat(F.lit(" in "), scope), F.lit(""))
    out_of = F.coalesce(F.concat(F.lit(" from "), scope), F.lit(""))
    quoted = lambda c: F.concat(F.lit("`"), F.coalesce(c, F.lit("")), F.lit("`"))
    was, now, named = F.col("detail.from"), F.col("detail.to"), F.coalesce(F.col("node.label"), F.lit("")) != ""
    target = F.when(named, F.concat(F.lit("value of "), bare, F.lit(" `"), F.col("node.label"), F.lit("`"))).otherwise(bare)
    value = (
        F.when(was.isNotNull() & now.isNotNull(), F.concat(F.lit("changed "), target, F.lit(" from "), quoted(preview(was, 40)), F.lit(" to "), quoted(preview(now, 40)), within))
        .when(was.isNotNull(), F.concat(F.lit("removed "), target, within))
        .when(now.isNotNull(), F.concat(F.lit("set "), target, F.lit(" to "), quoted(preview(now, 40)), within))
        .otherwise(F.concat(F.lit("modified "), what, within))
    )
    both = (F.coalesce(F.col("from_parent.label"), F.lit("")) != "") & (F.coalesce(F.col("to_parent.label"), F.lit("")) != "")
    move = F.when(both, F.concat(F.lit("moved "), what, F.lit(" from "), F.col("from_parent.label"), F.lit(" to "), F.col("to_parent.label"))).otherwise(
        F.concat(F.lit("moved "), what, F.lit(" to position "), (F.col("to_position") + 1).cast("string"), within)
    )
    return (
        F.when(F.col("action") == "Insert", F.concat(F.lit("added "), what, within))
        .when(F.col("action") == "Delete", F.concat(F.lit("removed "), what, out_of))
        .when(F.col("action") == "Move", move)
        .when(F.col("detail.kind") == "Renamed", F.concat(F.lit("renamed "), bare, F.lit(" "), quoted(was), F.lit(" to "), quoted(now), within))
        .otherwise(value)
    )


def narrate(actions: DataFrame, file_col: str = "file_path") -> DataFrame:
    """The actions that are left without redundant updates, with their description."""
    return narrated(drop_redundant_updates(actions, file_col))


def narrated(actions: DataFrame) -> DataFrame:
    """The actions with their description."""
    rows = apart(actions, {"td_bare": humanize_kind(F.col("node.kind")), "td_near": nearest_named(F.col("context"))})
    rows = apart(rows, {"td_what": subject(F.col("td_bare"), F.col("node.label"), F.col("node.value")), "td_scope": _scope(F.col("td_near"))})
    return rows.withColumn("description", description(*[F.col(c) for c in ("td_bare", "td_what", "td_scope")])).drop("td_bare", "td_near", "td_what", "td_scope")
