"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a hash string of 64 bits, the signs of random projections, and
keeps the strings sorted.  A query descends in every tree at once to its longest prefixes: the vectors
that share its first k bits are one range of the sorted array, found by bisection.  Then all trees
ascend together, one bit at a time, until the ranges hold enough vectors; those are compared with the
query in double precision.  "Enough" is `effort` of the index for each query.

Rows are dealt into index blocks by a hash of their vector, and queries into blocks of their own;
each pair of blocks is one task of bounded memory, which builds the block's forest.  The nearest of all
index blocks are merged by a sort on the query.  Copies of one vector share a block, so only one of
each has to be in the forest, with all of its ids behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TREES, BITS = 12, 64
#: Rows of an index block and of a query block.
INDEX_ROWS, QUERY_ROWS = 32_768, 8_192
#: Share of a block's vectors that the trees' ranges have to hold, repeats counted, before the ascent ends.
EFFORT = 1.5
#: Every row whose id is divisible by this is a query.
EVERY = 50
NEAREST = 5


def _planes(size: int, tree: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, tree, size])).standard_normal((size, BITS))


def hashes(vectors: np.ndarray, tree: int, seed: int = 3) -> np.ndarray:
    """Hash strings as 64-bit integers, first bit highest."""
    signs = vectors @ _planes(vectors.shape[1], tree, seed) > 0
    return np.packbits(signs, axis=1).view(">u8").reshape(-1).astype(np.uint64)


class Forest:
    """Sorted hash strings of one block in each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES) -> None:
        self.vectors, self.sorted, self.order = vectors, [], []
        for t in range(trees):
            strings = hashes(vectors, t)
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.sorted.append(strings[order])

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, the range of the longest common prefix length at which all trees together hold `enough` rows."""
        low = np.zeros((len(queries), len(self.sorted)), dtype=np.int64)
        high = np.full_like(low, len(self.vectors))
        strings = [hashes(queries, t) for t in range(len(self.sorted))]
        open_ = np.arange(len(queries))
        for k in range(BITS, 0, -1):
            fill = np.uint64((1 << (BITS - k)) - 1)
            lo = np.stack([np.searchsorted(s, x[open_] & ~fill, "left") for s, x in zip(self.sorted, strings, strict=True)], axis=1)
            hi = np.stack([np.searchsorted(s, x[open_] | fill, "right") for s, x in zip(self.sorted, strings, strict=True)], axis=1)
            done = (hi - lo).sum(axis=1) >= enough
            low[open_[done]], high[open_[done]] = lo[done], hi[done]
            open_ = open_[~done]
            if len(open_) == 0:
                break
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The rows in one query's ranges, each once, ascending."""
        mark = np.zeros(len(self.vectors), dtype=bool)
        for order, a, b in zip(self.order, low, high, strict=True):
            mark[order[a:b]] = True
        return np.flatnonzero(mark)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by its largest component, so that no square is too large or too small; cosines stay the same."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of scaled vectors in double precision; a row's value doesn't depend on the rows around it."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _nearest(index: pa.Table, queries: pa.Table, nearest: int, effort: float) -> pa.Table:
    """Of one index block: the nearest ids of each query of one query block."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if index.num_rows and queries.num_rows:
        matrix = lambda t: np.stack([np.asarray(x, dtype=np.float64) for x in t.column("vec").to_pylist()])
        own, asked, ids, asks = scaled(matrix(index)), scaled(matrix(queries)), index.column("ids").to_pylist(), queries.column("query_id").to_pylist()
        forest = Forest(own)
        low, high = forest.ranges(asked, min(len(own) * len(forest.sorted), max(32 * nearest, int(effort * len(own)))))
        for q, (query_id, a, b) in enumerate(zip(asks, low, high, strict=True)):
            rows = forest.candidates(a, b)
            score = cosines(asked[q], own[rows])
            if len(rows) > nearest + 1:
                # One vector may be the query's own.
                floor = np.partition(score, len(score) - nearest - 1)[len(score) - nearest - 1]
                rows, score = rows[score >= floor], score[score >= floor]
            found = sorted(((-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in ids[r] if i != query_id))[:nearest]
            out["query_id"] += [query_id] * len(found)
            out["vec_id"] += [i for _, i in found]
            out["score"] += [-s for s, _ in found]
    return pa.Table.from_pydict(out, schema=schema)


def usable(vector):
    """The vector takes part: not null or empty, no null or non-finite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, every: int = EVERY, effort: float = EFFORT) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row whose id is divisible by `every`.

    Rows with the query's own id aren't candidates; equal scores go by the smaller id.  A query has
    fewer rows if there are fewer candidates.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors are only compared with
    those of their length.  Of rows equal in id and vector one takes part; an id with several
    vectors asks with each and is named by its best.  Other columns are ignored; an empty table
    gives an empty one.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    # Ids of one vector: the least ones are enough, one more than asked for since one may be the
    # query's.  They are gathered in 64 parts first, so that a common vector isn't gathered at once.
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, nearest + 1)
    top = Window.partitionBy("vec", "part").orderBy("id")
    parts = rows.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = parts.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= nearest + 1)
    distinct = written(some.groupBy("vec").agg(least(F.collect_list("id")).alias("ids")), "vectors")
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    n_index, n_query = max(1, -(-distinct.count() // INDEX_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("vec").alias("length")
    index = distinct.select(F.pmod(F.xxhash64("vec"), F.lit(n_index)).cast("int").alias("i"), blocks(n_query).alias("q"), length, "vec", "ids")
    asked = queries.select(blocks(n_index).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int").alias("q"), length, "vec", "query_id")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, nearest, effort)

    keys = ["i", "q", "length"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranks = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark, sf_dir) -> DataFrame:
    """The five nearest of every fiftieth embedding."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
