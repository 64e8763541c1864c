"""Relational plans over trees in postorder rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .barrier import large

#: Two primes below 2**31, and a base for each.
_MODULI = ((2147483629, 1103515245), (2147483587, 1664525))
_BITS = 31


def ancestor_chains(nodes: DataFrame, first: Column) -> DataFrame:
    """pair_id, node_id and chain: the arrays `first` of each node and its ancestors, nearest first, joined to one, by pointer doubling.

    nodes has pair_id, node_id and parent_id (null or negative for roots).  A round appends to each
    node's array that of the node where it ends, so k rounds reach 2**k levels up; a node stays one row,
    and each round is written to the shared folder.
    """
    known = written(nodes.select("pair_id", "node_id", F.when(F.col("parent_id") >= 0, F.col("parent_id")).alias("td_next"), first.alias("chain")), "ancestors")
    while not known.filter("td_next IS NOT NULL").isEmpty():
        above = known.select("pair_id", F.col("node_id").alias("td_next"), F.col("td_next").alias("td_far"), F.col("chain").alias("td_more"))
        longer = F.when(F.col("td_more").isNull(), F.col("chain")).otherwise(F.concat("chain", "td_more"))
        known = written(known.join(large(above), ["pair_id", "td_next"], "left").select("pair_id", "node_id", F.col("td_far").alias("td_next"), longer.alias("chain")), "ancestors")
    return known.drop("td_next")


def ancestor_ids(nodes: DataFrame) -> DataFrame:
    """pair_id, node_id, ancestor and depth (1: the parent) of each node's ancestors; nodes as in ancestor_chains."""
    parent = F.col("parent_id")
    found = ancestor_chains(nodes, F.when(parent >= 0, F.array(parent)).otherwise(F.slice(F.array(parent), 1, 0)))
    return found.select("pair_id", "node_id", F.posexplode("chain").alias("td_at", "ancestor")).select("pair_id", "node_id", "ancestor", (F.col("td_at") + 1).alias("depth"))


def ancestry(nodes: DataFrame) -> DataFrame:
    """pair_id, node_id, depth and ancestor of each node, nearest first, the root included, with the ancestor's kind and label."""
    faces = nodes.select("pair_id", F.col("node_id").alias("ancestor"), "kind", "label")
    return ancestor_ids(nodes).join(large(faces), ["pair_id", "ancestor"]).select("pair_id", "node_id", "depth", "ancestor", "kind", "label")


def _power(base: int, modulus: int, exponent: Column) -> Column:
    """base ** exponent, by the exponent's bits."""
    squares = reduce(lambda done, _: [*done, done[-1] ** 2 % modulus], range(_BITS - 1), [base % modulus])
    step = lambda out, k: out * F.when(exponent.bitwiseAND(1 << k) != 0, F.lit(squares[k])).otherwise(F.lit(1)) % modulus
    return reduce(step, range(_BITS), F.lit(1).cast("long"))


def subtree_hashes(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """pair_id, node_id, hash (of kinds, labels, values and shape) and structure (of kinds and shape) of each node's subtree; 62 bits.

    In postorder a subtree is a run of ids, told by the sizes and faces in it, so its hash is a
    difference of prefix sums of face * base ** id, divided by base ** first id: one window for each pair
    and one join, however deep the trees.  nodes has pair_id, node_id (counting from 0 in a pair), subtree_size, kind,
    label and value; levels isn't needed.
    """
    del levels
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))
    faces = {"hash": F.xxhash64("kind", mark("label"), mark("value"), "subtree_size"), "structure": F.xxhash64("kind", "subtree_size")}
    upto = Window.partitionBy("pair_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    parts = {f"td_{name}{k}": F.pmod(face, F.lit(p)) * _power(base, p, F.col("node_id")) % p for name, face in faces.items() for k, (p, base) in enumerate(_MODULI)}
    base = nodes.select("pair_id", "node_id", "subtree_size", *[c.alias(n) for n, c in parts.items()])
    sums = base.select("pair_id", "node_id", "subtree_size", *[F.sum(n).over(upto).alias(n) for n in parts])
    before = sums.select("pair_id", F.col("node_id").alias("td_before"), *[F.col(n).alias(f"{n}_b") for n in parts])
    both = sums.withColumn("td_before", F.col("node_id") - F.col("subtree_size")).join(large(before), ["pair_id", "td_before"], "left")

    def whole(name: str) -> Column:
        one, two = (F.pmod(F.col(f"td_{name}{k}") - F.coalesce(f"td_{name}{k}_b", F.lit(0)), F.lit(p)) * _power(pow(base, -1, p), p, F.col("td_before") + 1) % p for k, (p, base) in enumerate(_MODULI))
        return F.shiftleft(one, 31).bitwiseOR(two).alias(name)

    return both.select("pair_id", "node_id", whole("hash"), whole("structure"))


def with_heights(nodes: DataFrame) -> DataFrame:
    """The rows with height: 1 for leaves, else one more than the highest child's."""
    deepest = ancestor_ids(nodes).groupBy("pair_id", F.col("ancestor").alias("node_id")).agg((F.max("depth") + 1).alias("height"))
    return nodes.join(large(deepest), ["pair_id", "node_id"], "left").withColumn("height", F.coalesce("height", F.lit(1)))
