"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from other characters to a whitespace mark, and none holds a line
feed.  So a marked text falls apart into chunks (marks, then other characters up to the next mark or
line feed; or one line feed) that are segmented alone.

The texts are read once, into blocks of documents: a block has a list of its distinct chunks, and its
documents are the places of their chunks in that list, packed.  The blocks' lists, dealt by buckets of
chunks, make one table of distinct chunks: a bucket's chunks meet in one task, which segments each
once by the library.  The ids go back to their block, and from there to the documents by position.  A
frequent chunk thus is dealt once per block, not once per word; the documents stay in files bucketed by block.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, fresh_path, give_back, lean, named, small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: A block takes documents up to so many characters, or one longer document.
BLOCK_CHARS = 20 << 20
#: Buckets of chunks for each shuffle partition; a task holds the distinct chunks of one bucket at a time.
BUCKETS_EACH = 2
#: What a model's normaliser must leave alone but for the marks.
PROBES = ("a  b", " a ", "\ufb01 \u212b \uff41\t\xa0b", "a\nb", "e\u0301 \xe9", "A\u200bb")


class Pieces:
    """A model whose chunks can be segmented alone; others are refused."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross whitespace marks")
        if any(self.model.normalize(t) != MARK + t.replace(" ", MARK) for t in PROBES):
            raise ValueError("this model's normaliser changes texts beyond whitespace marks")
        byte = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        plain = lambda i, p: b"" if self.model.is_control(i) else byte[i] or p.replace(MARK, " ").encode()
        self.spelled = [None if self.model.is_unknown(i) else plain(i, p) for i, p in enumerate(pieces)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Each chunk's ids."""
        # After a line feed the library sees no start of text; the mark and the line feed before it go.
        return [x[2:] for x in self.model.encode(["\n" + c for c in chunks], num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids), from spelled pieces where these are valid UTF-8."""
        try:
            text = b"".join(map(self.spelled.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):  # an unknown piece, or bytes that need replacement
            return self.model.decode(ids)
        return text[1:] if text[:1] == " " and self.model.id_to_piece(ids[0])[0] == MARK else text


@cache
def pieces(path: str) -> Pieces:
    """One per worker."""
    return Pieces(path)


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(values: list[int] | np.ndarray) -> bytes:
    """Integers below 2**32, byte plane by byte plane."""
    return _shrunk(np.ascontiguousarray(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_grown(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _null_rows(schema: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a schema in which the columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


class _Block:
    """Documents whose chunks are numbered together."""

    def __init__(self, number: int) -> None:
        self.number, self.chars, self.slabs = number, 0, 0
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # each new chunk gets the next number

    def lists(self, buckets: int) -> dict[int, list[str]]:
        """The chunks of each bucket."""
        found = defaultdict(list)
        for c in self.known:
            found[zlib.crc32(c.encode()) % buckets].append(c)
        return found


def _blocks(buckets: int):
    """Rows of three forms: a document with td_slab and td_n (how many chunks it has) and the columns beside
    td_text; a slab's td_places, those of its documents together; and a block's td_chunks of one td_bucket with their td_places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema = _Block(TaskContext.get().partitionId() << 32), None

        def slab(batch: pa.RecordBatch, places: list[list[int]]) -> Iterator[pa.RecordBatch]:
            n = len(places)
            same = lambda value, type_, k: pa.array([value] * k, type_)
            at = {"td_block": (block.number, pa.int64()), "td_slab": (block.slabs, pa.int32())}
            own = {f.name: batch.column(f.name) for f in batch.schema if f.name != "td_text"}
            yield _null_rows(schema, n, td_seq=pa.array(range(n), pa.int32()), td_n=pa.array(list(map(len, places)), pa.int64()), **{c: same(*x, n) for c, x in at.items()}, **own)
            yield _null_rows(schema, 1, td_places=pa.array([_packed([x for p in places for x in p])], pa.binary()), **{c: same(*x, 1) for c, x in at.items()})
            block.slabs += 1

        def lists() -> Iterator[pa.RecordBatch]:
            found = block.lists(buckets)
            if not found:
                return
            # No chunk but the line feed itself holds one.
            texts = [_shrunk("\n".join("" if c == "\n" else c for c in x).encode()) for x in found.values()]
            # Ascending places, as steps.
            places = [_packed(np.diff([block.known[c] for c in x], prepend=0)) for x in found.values()]
            number = pa.array([block.number] * len(found), pa.int64())
            yield _null_rows(schema, len(found), td_block=number, td_bucket=pa.array(list(found), pa.int32()), td_places=pa.array(places, pa.binary()), td_chunks=pa.array(texts, pa.binary()))

        for batch in batches:
            if schema is None:
                fixed = [("td_block", pa.int64()), ("td_slab", pa.int32()), ("td_seq", pa.int32()), ("td_n", pa.int64()), ("td_bucket", pa.int32()), ("td_places", pa.binary()), ("td_chunks", pa.binary())]
                schema = pa.schema([*fixed, *[(f.name, f.type) for f in batch.schema if f.name != "td_text"]])
            places, start = [], 0
            for i, text in enumerate(batch.column("td_text").to_pylist()):
                size = len(text or "")
                if block.chars and block.chars + size > BLOCK_CHARS:
                    if places:
                        yield from slab(batch.slice(start, len(places)), places)
                    yield from lists()
                    block, places, start = _Block(block.number + 1), [], i
                places.append(list(map(block.known.__getitem__, CHUNK.findall(MARK + text.replace(" ", MARK)))) if text else [])
                block.chars += size
            if places:
                yield from slab(batch.slice(start, len(places)), places)
        if schema is not None:
            yield from lists()

    return run


def _segmented(path: str):
    """The ids of lists of chunks that come bucket by bucket; a chunk is segmented once, for its bucket is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, known = pieces(path), None, {}
        for batch in batches:
            counts, ids = [], []
            for bucket, text in zip(batch.column("td_bucket").to_pylist(), batch.column("td_chunks").to_pylist(), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                chunks = [c or "\n" for c in _grown(text).decode().split("\n")]
                new = [c for c in chunks if c not in known]
                known.update(zip(new, own.segment(new), strict=True))
                found = list(map(known.__getitem__, chunks))
                counts.append(_packed(list(map(len, found))))
                ids.append(_packed([x for f in found for x in f]))
            yield pa.RecordBatch.from_arrays([batch.column("td_block"), batch.column("td_places"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["td_of", "td_at", "td_counts", "td_ids"])

    return run


def _joined(path: str, names: list[str]):
    """Of one block: its documents and slabs, and the ids of its chunks; gives the documents with ids and decoded, slab by slab."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = join(rows, found)
        give_back()
        return out

    def join(rows: pa.Table, found: pa.Table) -> pa.Table:
        own = pieces(path)
        at, counts, ids = ([_unpacked(x) for x in found.column(c).to_pylist()] for c in ("td_at", "td_counts", "td_ids"))
        at = [np.cumsum(x) for x in at]
        at, counts, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, counts, ids))
        length, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        length[at], start[at] = counts, np.cumsum(counts) - counts
        is_slab = pc.is_null(rows.column("td_n"))
        slabs = rows.filter(is_slab)
        places = dict(zip(slabs.column("td_slab").to_pylist(), slabs.column("td_places").to_pylist(), strict=True))
        documents = rows.filter(pc.invert(is_slab)).sort_by([("td_slab", "ascending"), ("td_seq", "ascending")])
        slab_of, n_of = (documents.column(c).to_numpy() for c in ("td_slab", "td_n"))
        documents, done = documents.select(names), []
        for s in sorted(places):
            place, own_rows = _unpacked(places[s]), np.flatnonzero(slab_of == s)
            n = n_of[own_rows]
            long = length[place]
            ends = np.cumsum(long)
            here = ids[np.repeat(start[place] - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            texts = pa.array([own.decode(here[a:b].tolist()) if b > a else "" for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(here.astype("<i4")))
            beside = documents.slice(int(own_rows[0]), len(own_rows)).combine_chunks()  # a slab has a document at least, and they are in order of slabs
            done.append(pa.table([*beside.columns, lists, texts], [*names, "td_ids", "td_decoded"]))
        return pa.concat_tables(done)

    return run


def decoded(ids: Column, path: str) -> Column:
    """The text of ids; null for null ids."""

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        own = pieces(path)
        return pa.array([None if x.values is None else own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if len(x.values) else "" for x in lists], pa.string())

    return decode(ids)


def public_model() -> str:
    """The default model; the library that holds it is only needed here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with `ids` (array<int>, without begin or end ids) and `decoded`, beside the columns named in keep (all, if not given).

    A null or empty text has no ids and decodes to the empty text.  Columns named ids or decoded are
    replaced; equal rows get equal ids, an empty table gives an empty one.  Kept columns are written
    once with the places, so leave out the text where it isn't needed.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = path or public_model()
    if not Path(path).exists():
        raise FileNotFoundError(path)
    out, back = aside(df, [c for c in (df.columns if keep is None else keep) if c not in {"ids", "decoded"}])
    rows = df.select(*out, F.col(f"`{text_col}`").cast("string").alias("td_text"))
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "td_text"]
    whole = T.StructType([*T.StructType.fromDDL("td_block long, td_slab int, td_seq int, td_n long, td_bucket int, td_places binary, td_chunks binary"), *kept])
    # Files bucketed by block: the documents are joined where they lie.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, name = fresh_path(spark, "blocks"), f"treedelta_blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(lean(_blocks(BUCKETS_EACH * parts)), whole).write.option("compression", "zstd").option("path", at).bucketBy(parts, "td_block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay in the shared folder
    documents = blocks.filter("td_bucket IS NULL").drop("td_bucket", "td_chunks")
    lists = blocks.filter("td_bucket IS NOT NULL").select("td_block", "td_bucket", "td_places", "td_chunks")
    by_bucket = lists.repartition("td_bucket").sortWithinPartitions("td_bucket")
    found = by_bucket.mapInArrow(lean(_segmented(path)), "td_of long, td_at binary, td_counts binary, td_ids binary")
    result = T.StructType([*kept, T.StructField("td_ids", T.ArrayType(T.IntegerType())), T.StructField("td_decoded", T.StringType())])
    done = documents.groupBy("td_block").cogroup(found.groupBy("td_of")).applyInArrow(_joined(path, [f.name for f in kept]), result)
    return done.select(*back, F.col("td_ids").alias("ids"), F.col("td_decoded").alias("decoded"))


def digests(rows: DataFrame) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded text."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3(spark, sf_dir) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def stage(spark, docs, sf_dir) -> DataFrame:
    """The ids of each document; the text goes."""
    del spark, sf_dir
    keep = [c for c in docs.columns if c not in {"text", "ids"}]
    return encode_documents(docs, keep=keep).select(*named(keep), "ids")
