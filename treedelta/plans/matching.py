"""Matching of tree rows by joins: no pair of trees is one Python call, nor one task.

Trees are rows of pair_id, node_id (postorder), parent_id, pos, subtree_size, kind, label and value,
both sides of a pair under one pair_id.  A match is a row of pair_id, old_id and new_id.

Equal nodes are claimed by place: both sides are numbered in order, and equal numbers meet, so that n
equal records give n rows and not n * n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.correlate import settled
from ..session import fresh_path, written
from .barrier import large
from .hierarchy import ancestor_ids, subtree_hashes

_LINK = "pair_id long, old_id int, new_id int"


class _Links:
    """What has been linked: rounds are added to one folder, so that reading them is one scan, however many there are."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, fresh_path(spark, "links")
        self.add(spark.createDataFrame([], _LINK))

    def add(self, rows: DataFrame) -> None:
        rows.select("pair_id", "old_id", "new_id").write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(_LINK).parquet(self.path)

    def free(self, nodes: DataFrame, side: str) -> DataFrame:
        """Nodes of a side without a partner."""
        return _free(nodes, self.all(), side)


def _free(nodes: DataFrame, links: DataFrame, side: str) -> DataFrame:
    """Nodes of a side that no link has."""
    return nodes.join(large(links.select("pair_id", F.col(f"{side}_id").alias("node_id"))), ["pair_id", "node_id"], "left_anti")


def _side(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with height, hashes of their subtrees and their parents' kinds, and the nodes' ancestors; each written once."""
    ancestors = ancestor_ids(nodes)
    deepest = ancestors.groupBy("pair_id", F.col("ancestor").alias("node_id")).agg((F.max("depth") + 1).alias("height"))
    up = nodes.select("pair_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    whole = nodes.drop("height").join(large(subtree_hashes(nodes)), ["pair_id", "node_id"]).join(large(up), ["pair_id", "parent_id"], "left").join(large(deepest), ["pair_id", "node_id"], "left")
    columns = ["pair_id", "node_id", "parent_id", "pos", "subtree_size", "kind", "label", "value", "hash", "structure"]
    return written(whole.select(*columns, F.coalesce("height", F.lit(1)).alias("height"), F.coalesce("parent_kind", F.lit("")).alias("parent_kind")), "nodes"), ancestors


def _by_place(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys and equal numbers in postorder."""
    place = F.row_number().over(Window.partitionBy("pair_id", *keys).orderBy("node_id"))
    side = lambda rows, name: rows.select("pair_id", *keys, F.col("node_id").alias(f"{name}_id"), place.alias("td_place"))
    return side(old, "old").join(large(side(new, "new")), ["pair_id", *keys, "td_place"]).select("pair_id", "old_id", "new_id")


def _topdown(old: DataFrame, new: DataFrame, links: _Links, min_height: int) -> None:
    """Link equal subtrees, from the highest down; each link's descendants are linked with it.

    Only nodes whose ancestors are all unmatched are left at a height.  Equals are claimed first below
    parents of one kind at one place, then below parents of one kind, then anywhere, each time in order.
    Below min_height an equal has to be the only one of its new tree.  In a round each pair goes on to
    its next height that has candidates on both sides, so rounds are few where most is matched near the top.
    """
    both = ["pair_id", "hash"]
    shared = written(old.select(*both).intersect(new.select(*both)), "shared")
    able = lambda rows, side: rows.join(large(shared), both, "left_semi").select(F.lit(side).alias("side"), *both, "node_id", "pos", "subtree_size", "height", "parent_kind")
    candidates = written(able(old, "old").unionByName(able(new, "new")), "candidates")
    while True:
        open_ = links.free(candidates.filter("side = 'old'"), "old").unionByName(links.free(candidates.filter("side = 'new'"), "new"))
        meet = open_.groupBy(*both).agg(F.count_distinct("side").alias("n"), F.max("height").alias("height")).filter("n = 2")
        top = meet.groupBy("pair_id").agg(F.max("height").alias("top"))
        left = written(open_.join(large(meet.select(*both)), both, "left_semi").join(large(top), "pair_id"), "frontier")
        level, candidates = left.filter("height = top"), left.filter("height < top").drop("top")
        if left.isEmpty():
            return
        a, b = level.filter("side = 'old'"), level.filter("side = 'new'")
        only = b.groupBy(*both).agg(F.count("*").alias("td_n")).filter("td_n = 1").drop("td_n")
        b = b.filter(F.col("height") >= min_height).unionByName(b.filter(F.col("height") < min_height).join(large(only), both, "left_semi").select(*b.columns))
        first = _by_place(a, b, ["hash", "parent_kind", "pos"])
        second = _by_place(_free(a, first, "old"), _free(b, first, "new"), ["hash", "parent_kind"])
        near = first.unionByName(second)
        claimed = near.unionByName(_by_place(_free(a, near, "old"), _free(b, near, "new"), ["hash"]))
        sizes = a.select("pair_id", F.col("node_id").alias("old_id"), "subtree_size")
        ranges = claimed.join(large(sizes), ["pair_id", "old_id"]).withColumn("td_step", F.explode(F.sequence(F.lit(0), F.col("subtree_size") - 1)))
        links.add(ranges.select("pair_id", (F.col("old_id") - F.col("td_step")).alias("old_id"), (F.col("new_id") - F.col("td_step")).alias("new_id")))


def _wishes(counts: DataFrame, old: DataFrame, new: DataFrame, ratio: float) -> DataFrame:
    """What containers ask for: of all with common descendants those alike enough, or any for a root."""
    size = lambda rows, side: rows.select("pair_id", F.col("node_id").alias(f"{side}_id"), F.col("subtree_size").alias(f"{side}_size"), F.col("parent_id").alias(f"{side}_up"))
    both = counts.join(large(size(old, "old")), ["pair_id", "old_id"]).join(large(size(new, "new")), ["pair_id", "new_id"])
    dice = 2 * F.col("common") / (F.col("old_size") + F.col("new_size") - 2)
    whole = lambda c: F.shiftleft("pair_id", 31).bitwiseOR(F.col(c).cast("long"))
    return both.withColumn("score", dice).filter((F.col("score") >= ratio) | (F.col("old_up") < 0)).select(whole("old_id").alias("asks"), whole("new_id").alias("offer"), "score", F.col("new_id").alias("first"), F.lit(1).alias("room"))


def _containers(old: DataFrame, new: DataFrame, above_old: DataFrame, above_new: DataFrame, links: _Links, ratio: float) -> None:
    """Link unmatched nodes with children, from the lowest up, by the share of descendants that are partners; pair_id below 2**32."""
    inner = lambda rows, side: written(links.free(rows.filter("subtree_size > 1"), side), "containers")
    ours, theirs = inner(old, "old"), inner(new, "new")

    def above(ancestors: DataFrame, free: DataFrame, side: str) -> DataFrame:
        """(pair_id, old_id or new_id, old_up or new_up, kind, height): the free ancestors of each node."""
        named = free.select("pair_id", F.col("node_id").alias("ancestor"), "kind", *(["height"] if side == "old" else []))
        return written(ancestors.join(large(named), ["pair_id", "ancestor"]).withColumnsRenamed({"node_id": f"{side}_id", "ancestor": f"{side}_up"}).drop("depth"), "above")

    up_old, up_new = above(above_old, ours, "old"), above(above_new, theirs, "new")
    low = F.lit((1 << 31) - 1).cast("long")
    # In a round each pair goes on to its next height that has containers.
    ranks = written(ours.select("pair_id", "height").distinct().withColumn("round", F.row_number().over(Window.partitionBy("pair_id").orderBy("height"))), "rounds")
    by_round = written(up_old.join(large(ranks), ["pair_id", "height"]).drop("height"), "above")
    for h in range(1, (ranks.agg(F.max("round")).first()[0] or 0) + 1):
        pairs = links.all()
        free = up_new.join(large(pairs.select("pair_id", F.col("new_id").alias("new_up"))), ["pair_id", "new_up"], "left_anti")
        met = pairs.join(large(by_round.filter(F.col("round") == h)), ["pair_id", "old_id"]).join(large(free), ["pair_id", "new_id", "kind"])
        counts = met.groupBy("pair_id", F.col("old_up").alias("old_id"), F.col("new_up").alias("new_id")).agg(F.count("*").alias("common"))
        wishes = written(_wishes(counts, ours, theirs, ratio), "wishes")
        taken = settled(wishes)
        links.add(taken.select(F.shiftright("asks", 31).alias("pair_id"), F.col("asks").bitwiseAND(low).cast("int").alias("old_id"), F.col("offer").bitwiseAND(low).cast("int").alias("new_id")))


def _leaves(old: DataFrame, new: DataFrame, links: _Links) -> None:
    """Link the childless children of matched nodes that are left: the k-th of a kind with the k-th."""
    left = lambda rows, side: links.free(rows.filter("subtree_size = 1"), side)
    parents = links.all().select("pair_id", F.col("old_id").alias("td_up"), F.col("new_id").alias("td_under"))
    under = left(old, "old").withColumnRenamed("parent_id", "td_up").join(large(parents), ["pair_id", "td_up"])
    found = _by_place(under, left(new, "new").withColumnRenamed("parent_id", "td_under"), ["td_under", "kind"])
    links.add(written(found, "leaves"))  # a folder isn't added to while it is read


def _lone_containers(old: DataFrame, new: DataFrame, links: _Links) -> None:
    """Link unmatched nodes with children by kind and structure, the k-th with the k-th: first below partners, then anywhere."""
    inner = lambda rows, side: links.free(rows.filter("subtree_size > 1"), side)
    parents = links.all().select("pair_id", F.col("old_id").alias("parent_id"), F.col("new_id").alias("td_under"))
    under = inner(old, "old").join(large(parents), ["pair_id", "parent_id"])
    links.add(written(_by_place(under, inner(new, "new").withColumn("td_under", F.col("parent_id")), ["td_under", "kind", "structure"]), "lone"))
    links.add(written(_by_place(inner(old, "old"), inner(new, "new"), ["kind", "structure"]), "lone"))


def match_nodes(old: DataFrame, new: DataFrame, min_height: int = 2, ratio: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, new, links): all phases in order, and both sides' rows with the heights and hashes that were used."""
    (a, above_a), (b, above_b) = _side(old), _side(new)
    links = _Links(old.sparkSession)
    _topdown(a, b, links, min_height)
    _containers(a, b, above_a, above_b, links, ratio)
    _leaves(a, b, links)
    _lone_containers(a, b, links)
    _leaves(a, b, links)
    return a, b, links.all()


def match_topdown(old: DataFrame, new: DataFrame, min_height: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, new, links) of the first phase alone: equal subtrees."""
    (a, _), (b, _) = _side(old), _side(new)
    links = _Links(old.sparkSession)
    _topdown(a, b, links, min_height)
    return a, b, links.all()


def edit_rows(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """The edits that explain a matching: pair_id, phase, action, node_id (the new one, but for Delete), kind, label, detail, from_value, to_value, from_position, to_position.

    A matched node reports a new label and a new value.  It has moved if both of its parents live on but aren't
    partners, or, among siblings that stayed, if it isn't in a longest run that kept its order.
    Deletes and inserts stand for whole subtrees; a new root without a partner isn't one.  Any matching may be given.
    """
    from ..operators.sequences import reordered

    side = lambda rows, s: rows.select("pair_id", *[F.col(c).alias(f"{s}_{c}") for c in ("parent_id", "pos", "kind", "label", "value")], F.col("node_id").alias(f"{s}_id"))
    both = links.join(large(side(old, "old")), ["pair_id", "old_id"]).join(large(side(new, "new")), ["pair_id", "new_id"])
    up_old = links.select("pair_id", F.col("old_id").alias("old_parent_id"), F.col("new_id").alias("td_new_up"))
    up_new = links.select("pair_id", F.col("new_id").alias("new_parent_id"), F.col("old_id").alias("td_old_up"))
    kin = written(both.join(large(up_old), ["pair_id", "old_parent_id"], "left").join(large(up_new), ["pair_id", "new_parent_id"], "left"), "kin")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, phase: int, action: str, node: str, s: str, detail=none, was=none, now=none, at=number, to=number) -> DataFrame:
        return df.select("pair_id", F.lit(phase).alias("phase"), F.lit(action).alias("action"), F.col(node).alias("node_id"), F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_label").alias("label"), detail.alias("detail"), was.alias("from_value"), now.alias("to_value"), at.alias("from_position"), to.alias("to_position"))

    name = lambda c: F.coalesce(F.col(c), F.lit("unnamed"))
    renamed = rows(kin.filter(~F.col("old_label").eqNullSafe(F.col("new_label"))), 0, "Update", "new_id", "new", F.lit("Renamed"), name("old_label"), name("new_label"))
    changed = rows(kin.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))), 0, "Update", "new_id", "new", F.lit("ValueChanged"), F.col("old_value"), F.col("new_value"))
    places = {"at": F.col("old_pos"), "to": F.col("new_pos")}
    elsewhere = kin.filter("td_new_up IS NOT NULL AND td_old_up IS NOT NULL AND td_new_up <> new_parent_id")
    stayed = kin.filter("td_new_up = new_parent_id").select("pair_id", F.col("old_parent_id").alias("parent_id"), "old_pos", "new_pos")
    out_of_line = Window.partitionBy("pair_id", "parent_id").orderBy("old_pos")
    # Only parents in which some neighbour's order is reversed need a longest run.
    uneven = stayed.withColumn("td_back", F.col("new_pos") < F.lag("new_pos").over(out_of_line)).groupBy("pair_id", "parent_id").agg(F.max("td_back").alias("td_back")).filter("td_back").drop("td_back")
    lines = reordered(stayed.join(large(uneven), ["pair_id", "parent_id"], "left_semi")).select("pair_id", F.col("parent_id").alias("old_parent_id"), "old_pos", F.lit(True).alias("td_out"))
    shifted = kin.filter("td_new_up = new_parent_id").join(large(lines), ["pair_id", "old_parent_id", "old_pos"], "left_semi")
    moved = rows(elsewhere.unionByName(shifted), 1, "Move", "new_id", "new", **places)
    gone, come = _free(old, links, "old"), _free(new, links, "new")
    inside = lambda df: df.select("pair_id", F.col("node_id").alias("parent_id"))
    deleted = rows(side(gone.join(large(inside(gone)), ["pair_id", "parent_id"], "left_anti"), "old"), 2, "Delete", "old_id", "old")
    roots = new.filter("parent_id < 0").select("pair_id", F.col("node_id").alias("parent_id"))
    covered = inside(come).join(large(roots), ["pair_id", "parent_id"], "left_anti")
    inserted = rows(side(come.filter("parent_id >= 0").join(large(covered), ["pair_id", "parent_id"], "left_anti"), "new"), 3, "Insert", "new_id", "new", to=F.col("new_pos"))
    return renamed.unionByName(changed).unionByName(moved).unionByName(deleted).unionByName(inserted)
