"""Token ids in Arrow stream files: equal-length sequences and masks as fixed-size-list batches.

Documents are range-partitioned and sorted by id; each partition writes one shard of two stream
files under the shared folder: `tokens` holds all ids one after another, cut into sequences of
SEQUENCE ids (the last one padded, its mask false there), and `index` holds doc_id, start and
n_tokens of each document.  Ids are 16-bit where the vocabulary allows.  Batches have no offsets
arrays and no nulls, so a mapped file gives any sequence and mask as a numpy view (TokenShard).
A task writes under names of its own attempt and only what successful tasks report is read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitTable, fresh_path, small_batches, table

SEQUENCE, BATCH = 1024, 128
TABLE_WORDS = 500_000
LONG_WORD = 200
#: Only white space that every library takes for such; other kinds stay within a word.
WORD = re.compile(r"[^ \t-\r]+")
#: Fixed value: the pattern of the tokenizer, and the same for texts of ASCII and Latin-1 in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
#: What sends a text the long way: other characters, and what may be a special token.
OTHER = re.compile(r"[^\t-\r -~ª²³µ¹º¼-¾À-ÿ]|<\|")
INDEX_ROWS = 8192


class Words:
    """A tokenizer with tables of the units that it has met.

    White space is dropped before the vocabulary's merges, and neither the normaliser nor the
    pattern looks across it, so the ids of a text are those of its words.  In texts of ASCII and
    Latin-1 (all but rare documents here) the pattern is applied to the lower-case text, and a unit
    is one of its matches; new units are joined by spaces and merged in one call by the same model
    behind a plainer pre-tokenizer, and taken apart after the ids that end a word.  In other texts
    a unit is a word, and the whole tokenizer encodes it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.wide = self.own.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.type = "<u4" if self.wide else "<u2"
        self.plain = Tokenizer(self.own.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The short way is for the one pattern that UNIT restates; other tokenizers go by words.
        steps = json.loads(self.own.to_str())["pre_tokenizer"].get("pretokenizers", [])
        self.short = any(x.get("pattern") == {"Regex": PATTERN} for x in steps)
        self.units, self.words = UnitTable(self._merged, TABLE_WORDS, LONG_WORD), UnitTable(self._whole, TABLE_WORDS, LONG_WORD)

    def _merged(self, units: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode(" ".join(units), add_special_tokens=False).ids, dtype=self.type)
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.own.encode_batch(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian."""
        easy = [self.short and t is not None and OTHER.search(t) is None for t in texts]
        parts = [UNIT.findall(t.lower()) if e else WORD.findall(t or "") for t, e in zip(texts, easy, strict=True)]
        tables = [(table_, table_.of(set().union(*[p for p, e in zip(parts, easy, strict=True) if e == kind]))) for table_, kind in ((self.units, True), (self.words, False))]
        return [b"".join(map(tables[0 if e else 1][1].__getitem__, p)) for p, e in zip(parts, easy, strict=True)]


@cache
def words(path: str) -> Words:
    """One per worker."""
    return Words(path)


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _schema(wide: bool, sequence: int) -> pa.Schema:
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("tokens", pa.list_(pa.field("item", ids, nullable=False), sequence), nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), sequence), nullable=False)])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """One shard."""

    def __init__(self, folder: str, name: str, wide: bool, sequence: int) -> None:
        self.fs, path = _at(folder)
        self.fs.create_dir(path, recursive=True)
        self.dtype, self.sequence, self.total, self.docs = np.dtype("<u4" if wide else "<u2"), sequence, 0, 0
        self.files = [self.fs.open_output_stream(f"{path}/{name}.{kind}.arrows") for kind in ("tokens", "index")]
        self.schema = _schema(wide, sequence)
        self.tokens, self.index = (pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, _INDEX), strict=True))
        self.parts: list[bytes] = []
        self.held, self.rows = 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.total, n))
        self.parts.append(ids)
        self.total, self.held, self.docs = self.total + n, self.held + n, self.docs + 1
        if self.held >= self.sequence * BATCH:
            self._flush(last=False)
        if len(self.rows) >= INDEX_ROWS:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.parts), dtype=self.dtype)
        n = len(values) if last else len(values) // self.sequence * self.sequence
        rest = values[n:]
        rows = -(-n // self.sequence)
        filled, mask = np.zeros(rows * self.sequence, dtype=self.dtype), np.arange(rows * self.sequence) < n
        filled[:n] = values[:n]
        for at in range(0, rows, BATCH):
            cut = slice(at * self.sequence, min(at + BATCH, rows) * self.sequence)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), type=f.type) for x, f in zip((filled, mask), self.schema, strict=True)]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [rest.tobytes()], len(rest)

    def _flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)], schema=_INDEX))
        self.rows = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_index()
        for x in (self.tokens, self.index, *self.files):
            x.close()


class TokenShard:
    """Random access to one shard; local files are mapped, so that sequences are views of the file."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = _at(folder)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.files = [pa.memory_map(f"{path}/{name}.{kind}.arrows") if self.local else self.fs.open_input_file(f"{path}/{name}.{kind}.arrows") for kind in ("tokens", "index")]
        self.streams = [pa.ipc.open_stream(f) for f in self.files]

    def sequences(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids (rows x length) and masks of each batch."""
        for batch in self.streams[0]:
            ids, mask = batch.column("tokens"), batch.column("mask")
            n = ids.type.list_size
            yield ids.flatten().to_numpy(zero_copy_only=True).reshape(-1, n), mask.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def read(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Table]:
        """All batches, as views, and the index."""
        return list(self.sequences()), self.streams[1].read_all()

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the shard and ids of each document, batch by batch."""
        source, held, begin = self.sequences(), np.zeros(0, np.uint16), 0
        for batch in self.streams[1]:
            for doc_id, start, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts, have = [held[start - begin :]], len(held) - (start - begin)
                while have < n:
                    ids, mask = next(source)
                    parts.append(ids.reshape(-1)[mask.reshape(-1)] if not mask.all() else ids.reshape(-1))
                    have += len(parts[-1])
                held, begin = (np.concatenate(parts), start) if len(parts) > 1 else (parts[0], start)
                yield doc_id, start, held[:n]

    def close(self) -> None:
        for f in self.files:
            f.close()


def write_tokens(df: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Write all texts' ids, each followed by end_id, in ascending order of ids; returns the manifest.

    The manifest has shard, name, docs and tokens, one row per shard (one per shuffle partition at
    most), in order of shard.  Null ids come first; rows of one id are ordered by their text; a
    null text is empty and only has the end id; an empty table gives no shard.
    """
    spark = df.sparkSession
    small_batches(spark)
    wide = words(path).wide
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    run = uuid.uuid4().hex[:8]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, name = words(path), None, ""
        end = np.array([end_id], dtype=own.type).tobytes()
        task = TaskContext.get()
        for batch in batches:
            if out is None and batch.num_rows:
                name = f"shard-{task.partitionId():06d}-{run}-{task.attemptNumber()}-{task.taskAttemptId()}"
                out = _Writer(folder, name, wide, sequence)
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "docs": pa.array([out.docs], pa.int64()), "tokens": pa.array([out.total], pa.int64())})

    found = rows.mapInArrow(shard, "shard long, name string, docs long, tokens long").collect()
    return spark.createDataFrame(sorted(found), "shard long, name string, docs long, tokens long")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start over all shards, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each document, read from the files."""
    spark = manifest.sparkSession
    shards = sorted(manifest.collect())
    base, places = 0, []
    for s in shards:
        places.append((s["name"], base))
        base += s["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows = TokenShard(folder, name), []
                for doc_id, start, ids in shard.documents():
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, first + start, len(ids), zlib.crc32(raw)))
                    if len(rows) == INDEX_ROWS:
                        yield _result(rows)
                        rows = []
                shard.close()
                if rows:
                    yield _result(rows)

    names = spark.createDataFrame(places, "name string, first long").repartition(max(1, len(places)), "name")
    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def public_vocabulary() -> str:
    """The default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark, sf_dir) -> DataFrame:
    """All documents as token files, read back."""
    folder = fresh_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, folder, public_vocabulary()), folder)
