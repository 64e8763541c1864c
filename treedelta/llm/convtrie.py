"""The prefix trie of conversations, as the Cartesian tree over the LCP array of the sorted conversations.

Conversations are range-partitioned and sorted by their turns (128 bits each), so that every node of
the trie is an interval of the order.  An entry lcp[i] is the number of turns that conversation i
shares with the one before it.  A block is one partition of the order.

1. Each block computes its entries of the LCP array and its strict minima from either end: the values
   than which nothing between them and that end is as small.
2. All nearest smaller values, in parallel: such a minimum is seen by the blocks beyond that end up to
   the first whose own minimum is as small; the minima of the blocks (one number each) tell which.
   What a block sees before it is the stack that a sequential scan would have at its start, what it
   sees after it closes the intervals that are open at its end.
3. So each block gives all intervals (left end, depth) with members in it, with what these add to
   them and with their parents; equal entries of an interval are one node.  One aggregation adds up
   the blocks' parts.
4. Depths between an interval's parent and its own are nodes of the same members; what a
   conversation shares with neither neighbour are nodes of its own.

saved_tokens of a node at depth d: every member but the first shares its first lcp turns with the one
before it, so the sum over the subtree is that of cum[lcp[i]] over these, less (n - 1) cum[d - 1].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: A rebuilt conversation c takes its first turns, fewer than HEADS, from conversation c - c % FAMILY.
FAMILY, HEADS = 5, 9
#: An interval is hot if it holds more than this share of all entries equal to its depth; there are fewer than 1 / HOT_SHARE of these.
HOT_SHARE = 1 / 1000

_ENTRIES = "td_block long, at long, conv_id long, len int, lcp int, next int, cum array<long>, least int, lasts array<int>, places array<long>, firsts array<int>"
_PARTS = "left long, depth int, n long, conv_id long, leaves long, sums long, equal long, first long, ends array<long>, cum array<long>, above int, above_left long"


def turn_lists(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, keys, bytes): each conversation's turns in order, as 128 bits of role and text, and as bytes of the text.

    Turns go by turn (null first), then role and text; null roles and texts count as empty.
    Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary")))
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))
    lists = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "bytes"))).alias("turns"))
    return lists.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("bytes"))


def rebuilt(lists: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % family, where h = crc32(c) % heads."""
    head = lists.select(F.col("conv_id").alias("td_head"), F.col("keys").alias("td_keys"), F.col("bytes").alias("td_bytes"))
    joined = lists.join(head, F.col("conv_id") - F.col("conv_id") % family == F.col("td_head"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")

    def own(column: str, other: str) -> Column:
        shared = F.coalesce(F.slice(other, F.lit(1), h), F.slice(column, 1, 0))
        return F.concat(shared, F.slice(column, h + 1, F.size(column)))

    return joined.select("conv_id", own("keys", "td_keys").alias("keys"), own("bytes", "td_bytes").alias("bytes"))


def _shared(a: list[bytes], b: list[bytes]) -> int:
    """How many turns two conversations begin with in common."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def _strict(values: list[int]) -> list[int]:
    """Where a value is less than all before it."""
    found = []
    for i, x in enumerate(values):
        if not found or x < values[found[-1]]:
            found.append(i)
    return found


def _entries(key: tuple, rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """One block's entries of the LCP array, and in one row more its least entry and its strict minima from either end."""
    rows, bound = rows.sort_by("place"), bounds.to_pylist()[0]
    keys, start, n = rows.column("keys").to_pylist(), bound["start"], rows.num_rows
    lcp = [-1 if bound["before"] is None else _shared(bound["before"], keys[0]), *map(_shared, keys[:-1], keys[1:])]
    after = -1 if bound["after"] is None else _shared(keys[-1], bound["after"])
    firsts, lasts = _strict(lcp), [n - 1 - i for i in _strict(lcp[::-1])]
    longs, ints = pa.int64(), pa.int32()
    cum = [np.cumsum(x, dtype=np.int64).tolist() for x in rows.column("bytes").to_pylist()]
    none = [None] * n
    columns = [
        pa.array([key[0].as_py()] * (n + 1), longs),
        pa.array([*range(start, start + n), None], longs),
        pa.array([*rows.column("conv_id").to_pylist(), None], longs),
        pa.array([*map(len, keys), None], ints),
        pa.array([*lcp, None], ints),
        pa.array([*lcp[1:], after, None], ints),
        pa.array([*cum, None], pa.list_(longs)),
        pa.array([*none, min(lcp)], ints),
        pa.array([*none, [lcp[i] for i in lasts]], pa.list_(ints)),
        pa.array([*none, [start + i for i in lasts]], pa.list_(longs)),
        pa.array([*none, [lcp[i] for i in firsts]], pa.list_(ints)),
    ]
    return pa.table(columns, ["td_block", "at", "conv_id", "len", "lcp", "next", "cum", "least", "lasts", "places", "firsts"])


def _seen(minima: dict[int, int]):
    """Each minimum from an end of a block, once for each block beyond that end that sees it; place is null for those seen after a block."""
    blocks = np.array(sorted(minima), dtype=np.int64)
    least = np.array([minima[b] for b in blocks.tolist()], dtype=np.int64)

    def row(to: np.ndarray, value: int, place: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array([value] * len(to), pa.int32()), pa.array([place] * len(to), pa.int64())], names=["td_block", "value", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lasts, places, firsts in zip(*(batch.column(c).to_pylist() for c in ("td_block", "lasts", "places", "firsts")), strict=True):
                own = int(np.searchsorted(blocks, block))
                # The first block with as small an entry sees it still.
                right, left = np.minimum.accumulate(least[own + 1 :]), np.minimum.accumulate(least[:own][::-1])
                for value, place in zip(lasts, places, strict=True):
                    yield row(blocks[own + 1 : own + 2 + int(np.searchsorted(-right, -value))], value, place)
                for value in firsts:
                    yield row(blocks[max(own - 1 - int(np.searchsorted(-left, -value)), 0) : own], value, None)

    return run


class _Interval:
    """An open interval, and what its members in this block add to it."""

    __slots__ = ("conv", "cum", "depth", "ends", "equal", "first", "leaves", "left", "n", "sums")

    def __init__(self, depth: int, left: int) -> None:
        self.depth, self.left, self.n, self.leaves, self.sums, self.equal = depth, left, 0, 0, 0, 0
        self.conv = self.cum = self.first = None
        self.ends: list[int] = []

    def take(self, n: int, conv: int | None, leaves: int, sums: int, cum: list[int] | None) -> None:
        """Members of an interval inside this one, or a conversation."""
        self.n, self.leaves, self.sums = self.n + n, self.leaves + leaves, self.sums + sums
        if n:
            self.conv = conv if self.conv is None else min(self.conv, conv)
            self.cum = self.cum if self.cum is not None else cum

    def row(self, above: _Interval) -> dict:
        own = {k: getattr(self, k) for k in ("left", "depth", "n", "leaves", "sums", "equal", "first", "ends")}
        return own | {"conv_id": self.conv, "cum": self.cum[: self.depth], "above": above.depth, "above_left": above.left}


_PART_SCHEMA = pa.schema(
    [("left", pa.int64()), ("depth", pa.int32()), ("n", pa.int64()), ("conv_id", pa.int64()), ("leaves", pa.int64()), ("sums", pa.int64()), ("equal", pa.int64())]
    + [("first", pa.int64()), ("ends", pa.list_(pa.int64())), ("cum", pa.list_(pa.int64())), ("above", pa.int32()), ("above_left", pa.int64())]
)


def _parts(key: tuple, rows: pa.Table, seen: pa.Table) -> pa.Table:
    """One block's parts of the intervals, from the stack of what it sees before it to what it sees after it."""
    del key
    stack, out, left = [], [], 0
    both = list(zip(seen.column("value").to_pylist(), seen.column("place").to_pylist(), strict=True))
    for value, place in sorted(x for x in both if x[1] is not None):
        stack.append(_Interval(value, left))  # an interval begins at the nearest smaller entry
        left = place
    stack = stack or [_Interval(-1, 0)]  # what all conversations are in

    def close(depth: int, left: int) -> None:
        """End intervals deeper than depth; one of this depth is open then, from where the last one ended began, or else from left."""
        while stack[-1].depth > depth:
            last = stack.pop()
            left = last.left
            if stack[-1].depth < depth:
                stack.append(_Interval(depth, left))
            stack[-1].take(last.n, last.conv, last.leaves, last.sums, last.cum)
            if last.n:
                out.append(last.row(stack[-1]))
        if stack[-1].depth < depth:
            stack.append(_Interval(depth, left))

    for r in rows.sort_by("at").to_pylist():
        at, lcp, cum = r["at"], r["lcp"], r["cum"]
        if at:
            close(lcp, at - 1)
            stack[-1].equal += 1
            stack[-1].sums += cum[lcp - 1] if lcp else 0
        if r["next"] > lcp:
            stack.append(_Interval(r["next"], at))
        top = stack[-1]
        top.take(1, r["conv_id"], int(r["next"] < r["len"]), 0, cum)
        if r["len"] > top.depth:
            own = _Interval(r["len"], at)
            own.take(1, r["conv_id"], 1, 0, cum)
            own.ends, own.first = [r["conv_id"]], at
            out.append(own.row(top))
        else:
            top.ends.append(r["conv_id"])
            top.first = at if top.first is None else top.first
    for value in sorted({x for x, place in both if place is None} | {-1}, reverse=True):
        if stack[-1].depth > value:
            close(value, 0)
    return pa.Table.from_pylist(out, schema=_PART_SCHEMA)


def trie_nodes(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, keys, bytes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.

    conv_id is the smallest member, the root has depth 0 and no parent_conv_id, and ends are the
    members that end at the node, ascending.  Conversations without turns end at the root; without
    conversations there is no root.  One conv_id is one conversation.  A conversation is one row
    of arrays (24 bytes a turn), and the ends of one node are one array.
    """
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = lists.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    place = F.monotonically_increasing_id()
    ordered = written(order.select(F.shiftright(place, 33).alias("td_block"), place.alias("place"), "conv_id", "keys", "bytes"), "conversations")
    # One row for each block, so at most `parts`.
    blocks = ordered.groupBy("td_block").agg(F.count("*").alias("n"), F.min_by("keys", "place").alias("head"), F.max_by("keys", "place").alias("tail"))
    line = Window.orderBy("td_block")
    bounds = blocks.select("td_block", (F.sum("n").over(line) - F.col("n")).alias("start"), F.lag("tail").over(line).alias("before"), F.lead("head").over(line).alias("after"))
    entries = written(ordered.groupBy("td_block").cogroup(bounds.groupBy("td_block")).applyInArrow(_entries, _ENTRIES), "lcp")
    ends = entries.filter("at IS NULL").select("td_block", "least", "lasts", "places", "firsts")
    minima = {r["td_block"]: r["least"] for r in ends.select("td_block", "least").collect()}
    seen = ends.mapInArrow(_seen(minima), "td_block long, value int, place long")
    rows = entries.filter("at IS NOT NULL").select("td_block", "at", "conv_id", "len", "lcp", "next", "cum")
    found = rows.groupBy("td_block").cogroup(seen.groupBy("td_block")).applyInArrow(_parts, _PARTS)
    total = lambda c: F.sum(c).alias(c)
    own = F.flatten(F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "ends")))).getField("ends")).alias("ends")
    whole = found.groupBy("left", "depth").agg(
        total("n"), F.min("conv_id").alias("conv_id"), total("leaves"), total("sums"), total("equal"), own, F.first("cum", ignorenulls=True).alias("cum"), F.max("above").alias("above"), F.max("above_left").alias("above_left")
    )
    intervals = written(whole, "intervals")
    hot = F.col("equal") > HOT_SHARE * entries.count()
    parent = lambda which, name: intervals.filter(which).select(F.col("left").alias("above_left"), F.col("depth").alias("above"), F.col("conv_id").alias(name))
    known = intervals.join(F.broadcast(parent(hot, "hot_parent")), ["above_left", "above"], "left").join(parent(~hot, "cold_parent"), ["above_left", "above"], "left")
    nodes = known.withColumn("d", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    last, top = F.col("d") == F.col("depth"), F.col("d") == F.col("above") + 1
    before = F.when(F.col("d") > 1, F.get("cum", F.col("d") - 2)).otherwise(F.lit(0))
    return nodes.select(
        "conv_id",
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None)).when(top, F.coalesce("hot_parent", "cold_parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("equal") + 1 - F.size("ends")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("sums") - F.when(F.col("n") > 1, (F.col("n") - 1) * before).otherwise(F.lit(0))).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.slice("ends", 1, 0)).alias("ends"),
    )


def conversation_trie(df: DataFrame, heads: int = HEADS, family: int = FAMILY, **columns: str) -> DataFrame:
    """The prefix trie of a table of turns, whose conversations are rebuilt first (heads=0: taken as they are); see turn_lists and trie_nodes."""
    lists = turn_lists(df, **columns)
    return trie_nodes(rebuilt(lists, heads, family) if heads else lists)


def op12(spark, sf_dir) -> DataFrame:
    """All nodes, with a digest of their ends."""
    nodes = conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.withColumn("ends_sha256", F.sha2(F.array_join(F.col("ends").cast("array<string>"), ",").cast("binary"), 256)).drop("ends")
