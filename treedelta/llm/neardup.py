"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words.  A shingle weighs its count in the text times its inverse document
frequency, -ln((1 + frequency) / (1 + documents)), but that of a share of RAREST at most: shingles in a
smaller share of all documents all weigh the same, at every size of the input.  Frequencies come from a count-min sketch of
two rows over all documents, from which the mean noise of a cell is taken; what noise is left shrinks
against the documents' number as that grows.  Each text gets SAMPLES samples (shingle, level) that two
texts share with a probability of their weighted Jaccard similarity; BANDS bands of ROWS samples make
its buckets.

Texts of equal words are one node.  Two nodes link if the weighted Jaccard similarity of their whole
vectors is 0.8 or more.  In each bucket all nodes are first compared with one hub, the node with the most
company in its other buckets.  Open are then the nodes of buckets that hold strays, nodes outside their hub's
class.  Of the pairs of a bucket only those are formed that can be near, told by an exact prefix filter: in one
order of all shingles, rare ones first, the first shingle that two near nodes share has before it at most
1 - threshold of the weight of either.  Each open node has these shingles as keys, with its weight
from there on, of which two nodes share no more than the lesser; a node leaves a key at which no other
node's size and weight could make it near.  Keys whose nodes are of one class go.  At the others,
nodes outside the key's largest class become hubs, in rounds of up to 64, 4096 and so on of a key, and are
compared with the key's nodes of other classes that share a bucket with them.  A stray that joins the largest
class before its turn needs none.  No link between classes is lost within a bucket, and no pair within a
class is formed.  Lost are pairs that share no bucket: (1 - s^ROWS)^BANDS of those of similarity s, 0.06 % at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FLUSH_CELLS, SKETCH_SCHEMA, aside, batch_word_hashes, cells, grams, int64, lean, merged_sketch, mix, seen_twice, sketch_rows, small_batches, table, text_key, written

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 14
SAMPLES = ROWS * BANDS
#: log2 of the cells in each of the two rows of the sketch of document frequencies.
IDF_BITS = 20
#: Shares of documents below this count as this.
RAREST = 2.0**-8
#: Least and largest log2 of the cells of the sketch that tells common shingles; beyond, it only spares fewer comparisons.
CELL_BITS = (16, 28)
#: Hubs of a round at one key are so many times those of the round before.
MORE_HUBS = 64
_BLOCK = 4096
#: Draws of the samples come from a fixed pool of so many triples, picked by a hash of shingle and sample.
_POOL_BITS = 16
#: Shingles of one text whose samples are drawn at a time.
_AT_ONCE = 4096


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, 1 / r, and offsets for ln a = ln c - r (t - beta) - r, with r and c of Gamma(2, 1) and beta uniform."""
    draw = np.random.Generator(np.random.PCG64(5))
    n = 1 << _POOL_BITS
    r, c, beta = draw.gamma(2, 1, n), draw.gamma(2, 1, n), draw.random(n)
    return r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32)


_R, _LN_C, _BETA = _pool()
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit shingle hashes and their counts; a text of one to four words is one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    found = grams(words, min(SHINGLE, len(words)))
    return np.unique((found >> np.uint64(32)).astype(np.uint32), return_counts=True)


def _rarity(keys: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """-ln of the share of documents; of the sketch's two rows the one that names the shingle rarer."""
    one, two = cells(keys.astype(np.uint64), IDF_BITS)
    return np.maximum(idf[0, one], idf[1, two])


def _weights(keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts times IDF, which is that of a share of RAREST at most."""
    return counts * np.minimum(_rarity(keys, idf), np.float32(-np.log(RAREST)))


def signature(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES samples of a weighted set, as hashes of (shingle, level)."""
    best, out = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.uint64)
    every = np.arange(SAMPLES)
    wide = mix(keys.astype(np.uint64) + np.uint64(1))
    ln_w = np.log(weights).astype(np.float32)
    for at in range(0, len(keys), _AT_ONCE):
        own = wide[at : at + _AT_ONCE]
        pick = ((own[None, :] * _SALTS[:, None]) >> np.uint64(64 - _POOL_BITS)).astype(np.int32)
        r = _R[pick]
        level = np.floor(ln_w[None, at : at + _AT_ONCE] / r + _BETA[pick])
        ln_a = _LN_C[pick] - r * (level - _BETA[pick] + np.float32(1))
        least = ln_a.argmin(axis=1)
        value = ln_a[every, least]
        better = value < best
        best[better] = value[better]
        sample = mix(own[least] ^ (level[every, least].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        out[better] = sample[better]
    return out


def _bands(samples: np.ndarray) -> np.ndarray:
    """One key per band, which holds the band's number."""
    rows = samples.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        total = mix(total + rows[:, k])
    return total


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted sparse vectors: sum of least by sum of largest weights; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    most = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - least
    return least / most if most > 0 else 0.0


def idf_table(vectors: DataFrame) -> np.ndarray:
    """-ln of the share of documents of each cell of both rows of the sketch, from all vectors."""
    blocks = (2 << IDF_BITS) // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(2 << IDF_BITS, dtype=np.int32), 0
        for batch in batches:
            keys = [np.unique(np.frombuffer(x, "<u4")) for x in batch.column(0).to_pylist()]
            docs += sum(1 for k in keys if len(k))
            if keys:
                for row, at in enumerate(cells(np.concatenate(keys).astype(np.uint64), IDF_BITS)):
                    found[row << IDF_BITS : (row + 1) << IDF_BITS] += np.bincount(at, minlength=1 << IDF_BITS).astype(np.int32)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(blocks)], pa.int32()), pa.array([np.array([docs], "<i4").tobytes(), *[x.astype("<i4").tobytes() for x in found.reshape(blocks, _BLOCK)]], pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 if key[0].as_py() < 0 else _BLOCK, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    merged = vectors.select("vector").mapInArrow(lean(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    found = {r["block"]: np.frombuffer(r["counts"], "<i8") for r in merged.toLocalIterator()}
    if not found:
        return np.ones((2, 1 << IDF_BITS), dtype=np.float32)
    docs, counts = float(found[-1][0]), np.concatenate([found[b] for b in range(blocks)]).reshape(2, -1).astype(np.float64)
    # What other shingles leave in a cell on average; a shingle that is looked up is in one document at least.
    noise = (counts.sum(axis=1, keepdims=True) - counts) / ((1 << IDF_BITS) - 1)
    share = (1 + np.maximum(counts - noise, 1.0)) / (1 + docs)
    # A lone document's shingles must weigh something.
    return np.maximum(-np.log(share), 0.05).astype(np.float32)


def _vectors(texts: DataFrame) -> DataFrame:
    """node and the vector (sorted shingle hashes, each as often as it occurs) of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = batch_word_hashes(batch.column("text"))
            vectors = [np.repeat(*shingles(words[offsets[i] : offsets[i + 1]])).astype("<u4").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(vectors, pa.binary())], names=["node", "vector"])

    return texts.mapInArrow(lean(make), "node binary, vector binary")


def _buckets(vectors: DataFrame, idf) -> DataFrame:
    """(node, band): the buckets of each vector; an empty one has none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands = [], []
            for node, vector in zip(batch.column("node").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                keys, counts = np.unique(np.frombuffer(vector, "<u4"), return_counts=True)
                if len(keys):
                    nodes += [node] * BANDS
                    bands.append(int64(_bands(signature(keys, _weights(keys, counts, idf.value)))))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))], names=["node", "band"])

    return vectors.mapInArrow(lean(make), "node binary, band long")


def _near(pairs: DataFrame, vectors: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, weighted) of the pairs of nodes whose similarity is the threshold or more, from whole vectors."""
    left = pairs.join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a")
    both = left.join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b").select("a", "b", "va", "vb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)

        def vector(x: bytes) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.unique(np.frombuffer(x, "<u4"), return_counts=True)
            return keys, _weights(keys, counts, idf.value)

        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)):
                if last[0] != y:
                    last = (y, vector(y))
                out[i] = weighted_jaccard(vector(x), last[1])
            near = pa.array(np.flatnonzero(out >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near), pa.array(out).take(near)], names=["a", "b", "weighted"])

    # Not a function in a filter: Spark would run it twice, in two Python workers of each task.
    return both.mapInArrow(lean(compare), "a binary, b binary, weighted double")


def components(edges: DataFrame, what: str = "classes") -> DataFrame:
    """(node, root) of the nodes of edges (a, b): each gets the least node of its component.

    Every node points to the least node that it or one of its neighbours points to, and pointers are
    followed twice as far in each round, until nothing changes; rounds grow with the logarithm of the
    longest chain.  Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{what}-edges", narrow=True)
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{what}-0", narrow=True)
    at = 0
    while True:
        at += 1
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "other").alias("root"))
        up = roots.select(F.col("node").alias("via"), F.col("root").alias("above"))
        new = lower.join(up, lower["root"] == up["via"], "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root"))
        new = written(new, f"{what}-{at}", narrow=True)
        if new.filter("root <> was").limit(1).count() == 0:
            return new.select("node", "root")
        roots = new.select("node", "root")


def _commons(one: DataFrame):
    """The sketch that tells common shingles, as a broadcast, and its bits.

    A shingle is common if it is estimated to occur in two or more of these nodes; estimates are never too low.
    """
    held = one.agg(F.coalesce(F.sum(F.length("vector") / 4), F.lit(0))).first()[0]
    bits = min(max(int(np.ceil(np.log2(max(2.0 * held, 2.0)))), CELL_BITS[0]), CELL_BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for into, at in zip(held, cells(np.unique(np.frombuffer(x, "<u4")).astype(np.uint64), bits), strict=True):
                    into.append(at)
                size += len(held[0][-1])
            if size > FLUSH_CELLS:
                yield from sketch_rows(held, bits)
                held, size = [[], []], 0
        if size:
            yield from sketch_rows(held, bits)

    return one.sparkSession.sparkContext.broadcast(merged_sketch(one.select("vector").mapInArrow(lean(count), SKETCH_SCHEMA), bits)), bits


def _shares(one: DataFrame, idf, sent, bits: int) -> DataFrame:
    """Of each node: reach, total and common weight; two nodes share no more than the lesser of their common weights."""

    @F.arrow_udf("total double, common double")
    def shares(vectors: pa.Array) -> pa.Array:
        out = []
        for x in vectors.to_pylist():
            keys, counts = np.unique(np.frombuffer(x, "<u4"), return_counts=True)
            weights = _weights(keys, counts, idf.value).astype(np.float64)
            out.append((weights.sum(), weights[seen_twice(sent.value, keys.astype(np.uint64), bits)].sum()))
        columns = zip(*out, strict=True) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(list(c), pa.float64()) for c in columns], ["total", "common"])

    return one.select("node", "reach", shares("vector").alias("s")).select("node", "reach", "s.*")


def _keys(open_: DataFrame, idf, sent, bits: int, floor: float) -> DataFrame:
    """(node, root, total, key, rest): the shingles that may be the first that a node shares with a near one.

    rest is the node's weight of common shingles from the key on, in an order in which rare shingles stand first; what
    a near node shares from there on is all that the two share, so it is at least `floor` of the total.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, x in enumerate(batch.column("vector").to_pylist()):
                keys, counts = np.unique(np.frombuffer(x, "<u4"), return_counts=True)
                weights = _weights(keys, counts, idf.value).astype(np.float64)
                common = np.flatnonzero(seen_twice(sent.value, keys.astype(np.uint64), bits))
                common = common[np.lexsort((keys[common], -_rarity(keys[common], idf.value)))]
                rest = weights[common][::-1].cumsum()[::-1]
                may = rest >= floor * weights.sum()
                n = int(may.sum())
                held.append((np.full(n, i), np.full(n, weights.sum()), keys[common][may].astype(np.int64), rest[may]))
                size += n
                if size > FLUSH_CELLS or i + 1 == batch.num_rows:
                    at, *rows = (pa.array(np.concatenate(c)) for c in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("root").take(at), *rows], names=["node", "root", "total", "key", "rest"])
                    held, size = [], 0

    return open_.select("node", "root", "vector").mapInArrow(lean(make), "node binary, root binary, total double, key long, rest double")


def _moved(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """The rows with each named column's node replaced by its root, where it has one."""
    for i, c in enumerate(columns):
        to = roots.select(F.col("node").alias(f"td_n{i}"), F.col("root").alias(f"td_r{i}"))
        rows = rows.join(to, F.col(c) == F.col(f"td_n{i}"), "left").withColumn(c, F.coalesce(f"td_r{i}", c)).drop(f"td_n{i}", f"td_r{i}")
    return rows


def _linked(df: DataFrame, text_col: str, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """The links, and (node, root) tables that are to be followed one after the other to a node's class."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    texts = df.select(text_key(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vectors = written(_vectors(texts), "vectors")
    idf = spark.sparkContext.broadcast(idf_table(vectors))
    # Copies bring the same rows; one of each is enough.
    buckets = written(_buckets(vectors, idf).distinct(), "buckets")
    full = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(buckets.join(full, "band"), "shared")
    # Whole numbers: their sum doesn't depend on the order of rows, so that reruns agree in their hubs.
    reach = shared.groupBy("node").agg(F.sum(F.round(F.log("n") * (1 << 20)).cast("long")).alias("reach"))
    one = written(vectors.join(reach, "node").groupBy("node").agg(F.first("vector").alias("vector"), F.first("reach").alias("reach")), "wanted")
    sent, bits = _commons(one)
    known = _shares(one, idf, sent, bits)
    placed = written(shared.select("band", "node").join(known, "node"), "placed")
    hubs = written(placed.groupBy("band").agg(F.max(F.struct("reach", "node", "total", "common")).alias("hub"), F.min("total").alias("least")), "hubs", narrow=True)
    floor = threshold - 1e-6
    # A bound of the similarity of two nodes from what they can share.
    possible = lambda ta, ca, tb, cb: F.least(ca, cb) / (ta + tb - F.least(ca, cb)) >= floor
    stars = placed.join(hubs, "band").filter(F.col("node") != F.col("hub.node"))
    stars = stars.filter(possible(F.col("total"), F.col("common"), F.col("hub.total"), F.col("hub.common"))).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    links = written(_near(stars, one, idf, threshold), "links", narrow=True)
    roots = [components(links, "stars")]
    rows = placed.join(hubs.select("band", F.col("hub.node").alias("hub"), "least"), "band").filter("node <> hub")
    # No partner can have a larger bound than one of the bucket's least size that shares all that is common.
    able = F.col("common") / (F.col("total") + F.greatest(F.col("least") - F.col("common"), F.lit(0.0))) >= floor
    rows = _moved(rows.filter(able).withColumn("root", F.col("node")), roots[0], "root", "hub")
    stray = F.col("root") != F.col("hub")
    rows = rows.select("band", "node", "root", "hub")
    open_ = rows.join(rows.filter(stray).select("band").distinct(), "band", "left_semi").select("node", "root").distinct()
    keyed = written(_keys(one.select("node", "vector").join(open_, "node"), idf, sent, bits, floor), "keys")
    # At a key no partner is smaller than the smallest node or has more weight left than the one with the most.
    best = written(keyed.groupBy("key").agg(F.min("total").alias("least"), F.max("rest").alias("most"), F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other"), "best", narrow=True)
    keyed = keyed.join(best, "key").filter(possible(F.col("total"), F.col("rest"), F.col("least"), F.col("most"))).select("key", "node", "root", "total", "rest")
    keyed = written(keyed, "keyed", narrow=True)
    sizes = keyed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("first"), (F.sum("n") - F.max("n")).alias("strays")).filter("strays > 0")
    rows = keyed.join(largest, "key").withColumn("hub", F.col("first.root"))
    # A stray's place among those of its key, in no particular order, says in which round it is a hub.
    place = F.shiftrightunsigned(F.xxhash64("key", "node"), 11) / F.lit(float(1 << 53)) * F.col("strays")
    turn = F.when(stray, F.floor(F.log(F.greatest(place, F.lit(1.0))) / F.log(F.lit(float(MORE_HUBS))) + 1e-9).cast("int"))
    rows = rows.withColumn("turn", turn).select("key", "node", "root", "hub", "total", "rest", "turn")
    # Pairs are those that share a bucket.
    held = shared.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("band").alias("bands"))
    rows = written(rows.join(held, "node"), "open-0", narrow=True)
    last = rows.agg(F.max("turn")).first()[0]
    for at in range(0 if last is None else last + 1):
        asked = rows.filter((F.col("turn") == at) & stray)
        keys = asked.select("key").distinct()
        a, b = asked.alias("a"), rows.join(keys, "key", "left_semi").filter((F.coalesce("turn", F.lit(at)) >= at) | ~stray).alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & possible(*[F.col(f"{s}.{c}") for s in "ab" for c in ("total", "rest")]) & F.arrays_overlap("a.bands", "b.bands"))
        pairs = met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        more = written(_near(pairs, one, idf, threshold), f"links-{at}", narrow=True)
        links = links.unionByName(more)
        if more.limit(1).count():
            ends = more
            for known_roots in roots:
                ends = _moved(ends, known_roots, "a", "b")
            roots.append(components(ends.filter("a <> b"), f"round-{at}"))
            rows = _moved(rows, roots[-1], "root", "hub")
        rows = written(rows.filter(~stray | (F.col("turn") > at)), f"open-{at + 1}", narrow=True) if at < last else rows
    return links, roots


def near_duplicate_links(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b, weighted) that tie the nodes of each class together."""
    return _linked(df, text_col, threshold)[0]


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Of each node: its least id, its class's root and least id, the node that stays in the class, and its links."""
    links, roots = _linked(df, text_col, threshold)
    ids = df.select(F.col(id_col).alias("id"), text_key(text_col).alias("node")).groupBy("node").agg(F.min("id").alias("id"))
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = ids.join(counts, "node", "left").withColumn("root", F.col("node"))
    for found in roots:
        placed = _moved(placed, found, "root")
    placed = written(placed.select("node", "id", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "placed", narrow=True)
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    return placed.join(least, "root").select(F.col("node").alias("td_node"), F.col("first.id").alias("class_id"), F.col("first.node").alias("td_first"), "n_links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows with class_id (the least id of the row's class), n_links and is_kept.

    Texts of equal bytes are one node; nodes whose weighted Jaccard similarity over TF-IDF
    shingles of five words is `threshold` or more are linked where they share a band; a class is a
    connected component.  n_links counts the links found to other nodes.  is_kept marks the row
    that stays in its class, by least id, then text; rows equal in both are all marked.  Texts without
    words are alike only if they are equal, null counting as empty; a null id stands after all
    others, and a class of null ids has a null class_id.  Columns of the three names are replaced,
    others are kept; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c not in {"class_id", "n_links", "is_kept"}]
    classes = _classes(df, id_col, text_col, threshold)
    out, back = aside(df, keep)
    rows = df.select(*out, F.col(id_col).alias("td_id"), text_key(text_col).alias("td_own"))
    done = rows.join(classes, F.col("td_own") == F.col("td_node"))
    stays = F.col("td_id").eqNullSafe(F.col("class_id")) & (F.col("td_own") == F.col("td_first"))
    return done.select(*back, "class_id", "n_links", stays.alias("is_kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near_duplicates; rows equal in id and text count as one.

    The rows that stay are found by id and text together, so that a large class isn't dealt to one task.
    """
    first = _classes(df, id_col, text_col, threshold).select(F.col("class_id").alias("td_class"), "td_first").distinct()
    out, back = aside(df, df.columns)
    rows = df.select(*out, F.col(id_col).alias("td_id"), text_key(text_col).alias("td_own"))
    kept = rows.join(first, F.col("td_id").eqNullSafe(F.col("td_class")) & (F.col("td_own") == F.col("td_first")), "left_semi")
    return kept.dropDuplicates(["td_id", "td_own"]).select(*back)


def op5(spark, sf_dir) -> DataFrame:
    """Each document's class."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "is_kept")


def stage(spark, docs, sf_dir) -> DataFrame:
    """One document of each class stays; of equal rows one."""
    del spark, sf_dir
    return keep_first(docs)
