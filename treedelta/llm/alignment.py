"""Alignment of two tokenizers' tokens by their bytes, and how often each pair of tokens overlaps in the corpus.

A text begins with a space for both tokenizers: A gets it written out, B adds it by itself.  Neither has
tokens that cross from other characters to a space or a line feed, so a text falls apart into chunks
there, tokenized alone; a chunk's end is an end of tokens on both sides.  Inside mapInPandas, blocks of
documents get their distinct chunks tokenized once each, and a two-pointer merge of the cumulative
token ends cuts a chunk into groups and lists its links, the overlapping pairs of tokens.

Documents are written as places of chunks in their block, beside their block's pairs, each once with
how often the block links it.  Spark adds the pairs up over all blocks by groupBy, takes the maxima of
either side, and joins both back to the blocks' pairs; each block then sums them over its documents.
So a pair that all documents hold is one row per block, before any shuffle.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, fresh_path, give_back, small_batches, table
from .pieces import MARK, _packed, _unpacked, pieces

#: A block takes documents up to so many characters, or one longer document.
BLOCK_CHARS = 16 << 20
#: Longer chunks aren't kept from block to block, nor are more chunks than TABLE_CHUNKS.
LONG_CHUNK, TABLE_CHUNKS = 64, 150_000
#: Where white space other than spaces and line feeds occurs, cuts are sought one by one.
OTHER_SPACE = re.compile(r"[^\S \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
CHUNK = re.compile(r"[ \n]+[^ \n]*|[^ \n]+")

#: Tokens of A and of B, groups, the groups as text, and the links as 64-bit pairs of ids; -1 tokens of A if the bytes differ.
Chunk = tuple[int, int, int, str, bytes]


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cut) of each step of a two-pointer merge of two ascending arrays of token ends over the same bytes.

    At each step the tokens i and j overlap, so every step is a link and every link one step; the
    token that ends first steps on, or both do, and that is a cut between groups.
    """
    ends = np.union1d(ends_a, ends_b)
    before = np.concatenate([ends[:1] * 0, ends[:-1]])
    i, j = np.searchsorted(ends_a, before, side="right"), np.searchsorted(ends_b, before, side="right")
    return i, j, ends_a[i] == ends_b[j]


def _byte_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, and what they make of the chunks met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), pieces(path_b)
        self.a.encode_special_tokens = True
        values = _byte_values()
        self.bytes_a = {i: bytes(values[c] for c in t) if all(c in values for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.sizes_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.sizes_b = np.array([len(x or b"") for x in self.b.spelled], np.int64)
        ids = range(max(len(self.sizes_a), len(self.sizes_b)))
        self.texts = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;\n"], dtype=object)
        self.known: dict[str, Chunk] = {}

    def _right(self, chunks: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """The tokens of both sides spell the chunk."""
        spell = (lambda x: b"".join(map(self.bytes_a.__getitem__, x)), lambda x: b"".join([self.b.spelled[i] or b"" for i in x]))
        return [f(x) == c.encode() == g(y) for f, g in [spell] for c, x, y in zip(chunks, ids_a, ids_b, strict=True)]

    def _made(self, chunks: list[str]) -> dict[str, Chunk]:
        """All chunks at once: their bytes stand one after another, and a chunk's end is an end on both sides."""
        ids_a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        ids_b = self.b.segment([c.replace(" ", MARK) for c in chunks])
        right = self._right(chunks, ids_a, ids_b)
        made = {c: (-1, 0, 0, "", b"") for c, good in zip(chunks, right, strict=True) if not good}
        if made:
            chunks, ids_a, ids_b = ([x for x, good in zip(y, right, strict=True) if good] for y in (chunks, ids_a, ids_b))
        if not chunks:
            return made
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(chunks)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        i, j, cut = merge(ends_a, ends_b)
        links = ((flat_a[i] << 32) | flat_b[j]).astype(np.uint64).tobytes()
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        done = np.searchsorted(i, last_a, side="right")  # steps up to each chunk's end
        groups = np.diff(np.cumsum(cut)[done - 1], prepend=0)
        # The groups' tokens in the order of their text, each with the mark that follows it.
        group_a, group_b = i[cut] + 1, j[cut] + 1
        of_a, of_b = np.arange(len(flat_a)), np.arange(len(flat_b))
        before_b = np.concatenate([[0], group_b])
        text = np.empty(len(flat_a) + len(flat_b), dtype=object)
        mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        mark_a[group_a - 1], mark_b[group_b - 1] = 1, 2
        mark_b[last_b] = 3
        text[of_a + before_b[np.searchsorted(group_a, of_a, side="right")]] = self.texts[mark_a, flat_a]
        text[of_b + group_a[np.searchsorted(group_b, of_b, side="right")]] = self.texts[mark_b, flat_b]
        texts = "".join(text.tolist()).split("\n")
        at = [0, *(8 * done).tolist()]
        rows = zip(chunks, n_a.tolist(), n_b.tolist(), groups.tolist(), texts, at[:-1], at[1:], strict=False)
        made.update((c, (x, y, g, t, links[p:q])) for c, x, y, g, t, p, q in rows)
        return made

    def of(self, chunks: list[str]) -> list[Chunk]:
        """What is known of these distinct chunks."""
        if len(self.known) > TABLE_CHUNKS:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        made: dict[str, Chunk] = {}
        for at in range(0, len(new), 16384):
            made |= self._made(new[at : at + 16384])
        self.known |= {c: x for c, x in made.items() if len(c) <= LONG_CHUNK}
        return [made[c] if c in made else self.known[c] for c in chunks]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker."""
    return Aligner(path_a, path_b)


def chunks_of(text: str) -> Iterator[str] | list[str]:
    """A text with a space before it, cut where no token of either side crosses."""
    text = " " + text
    if OTHER_SPACE.search(text):
        return CUT.split(text)
    return CHUNK.findall(text) if len(text) < 1 << 20 else (m[0] for m in CHUNK.finditer(text))


class _Block:
    """Documents whose chunks are numbered together."""

    def __init__(self, number: int) -> None:
        self.number, self.chars = number, 0
        self.kept: list[str | None] = []
        self.places: list[np.ndarray] = []
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # each new chunk gets the next number

    def add(self, text: str | None, kept: str | None) -> None:
        self.chars += len(text or "")
        self.kept.append(kept)
        self.places.append(np.fromiter(map(self.known.__getitem__, chunks_of(text)), np.int32) if text else np.zeros(0, np.int32))

    def rows(self, own: Aligner, digest: bool) -> Iterator[pd.DataFrame]:
        """Rows of three forms: the documents with their counts and the chunks that they hold, each with how often; the block's
        chunks, as how many links each has and which of its pairs they are; and its pairs, with how often it links them."""
        chunks = own.of(list(self.known))
        counts = np.array([(*x[:3], len(x[4]) // 8) for x in chunks], np.int64).reshape(-1, 4)
        texts, links = [x[3] for x in chunks], np.frombuffer(b"".join([x[4] for x in chunks]), np.uint64)
        documents, uses = [], np.zeros(len(chunks), np.int64)
        for kept, places in zip(self.kept, self.places, strict=True):
            if len(places) == 0 or counts[places, 0].min() < 0:
                documents.append((kept, None, 0, 0, 0, 0, ""))
                continue
            place, times = np.unique(places, return_counts=True)
            uses[place] += times
            groups = ";".join(map(texts.__getitem__, places.tolist()))
            groups = hashlib.sha256(groups.encode()).hexdigest() if digest else groups
            documents.append((kept, _packed(np.concatenate([np.diff(place, prepend=0), times])), *(times @ counts[place]).tolist(), groups))
        at = pd.DataFrame(documents, columns=["td_kept", "td_places", *COUNTS], dtype=object)
        yield at.assign(td_block=self.number, td_seq=range(len(at))).reindex(columns=COLUMNS).astype(object)
        if len(links) == 0:
            return
        pairs, linked = np.unique(links, return_inverse=True)
        sizes = counts[:, 3]
        yield pd.DataFrame({"td_block": [self.number], "td_places": [_packed(np.concatenate([[len(sizes)], sizes, linked]))]}).reindex(columns=COLUMNS).astype(object)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, linked, np.repeat(uses, sizes))
        own_pairs = {"td_seq": range(len(pairs)), "td_a": (pairs >> np.uint64(32)).astype(np.int64), "td_b": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), "td_times": times}
        yield pd.DataFrame({"td_block": self.number, **own_pairs})[times > 0].reindex(columns=COLUMNS).astype(object)


def _blocks(path_a: str, path_b: str, digest: bool, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, block = aligner(path_a, path_b), _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for text, kept in zip(batch["td_text"], batch["td_kept"], strict=True):
                if block.chars and block.chars + len(text or "") > most:
                    yield from block.rows(own, digest)
                    block = _Block(block.number + 1)
                block.add(text, kept)
        if block.kept:
            yield from block.rows(own, digest)
        give_back()

    return run


#: Columns that are known before the corpus is counted.
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "groups"]
COLUMNS = ["td_block", "td_seq", "td_places", *COUNTS, "td_a", "td_b", "td_times", "td_kept"]
SUMS = ["n_best", "n_mutual", "count_sum"]
#: Kept columns go through pandas as JSON, which keeps nulls and large integers.
AS_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _summed(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """Of one block: its documents and chunks, and its pairs' counts; gives the documents with what their links sum up to."""
    chunks = rows[rows["td_seq"].isna()]
    documents = rows[rows["td_seq"].notna()].sort_values("td_seq")
    sums = np.zeros((len(documents), 3), np.int64)
    if len(chunks):
        packed = _unpacked(chunks["td_places"].iloc[0])
        sizes, linked = packed[1 : packed[0] + 1], packed[packed[0] + 1 :]
        of = np.zeros((int(linked.max()) + 1, 3), np.int64)
        of[counted["td_pair"].to_numpy(np.int64)] = counted[["best", "mutual", "times"]].to_numpy(np.int64)
        running = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(of[linked], axis=0)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        each = running[ends[1:]] - running[ends[:-1]]
        for k, packed in enumerate(documents["td_places"]):
            if packed is not None:
                place, times = np.split(_unpacked(packed), 2)
                sums[k] = times @ each[np.cumsum(place)]
    out = documents[["td_kept", *COUNTS]].astype(dict.fromkeys(COUNTS[:-1], np.int64))
    return out.assign(**{c: sums[:, k] for k, c in enumerate(SUMS)})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(td_a, td_b, times, best, mutual): the links of each pair of ids, and whether no pair of its B id (and of its A id as well) has more."""
    counts = pairs.groupBy("td_a", "td_b").agg(F.sum("td_times").alias("times"))
    most = lambda side: counts.groupBy(side).agg(F.max("times").alias(f"most_{side}"))
    joined = counts.join(most("td_b"), "td_b").join(most("td_a"), "td_a")
    best = F.col("times") == F.col("most_td_b")
    return joined.select("td_a", "td_b", "times", best.cast("int").alias("best"), (best & (F.col("times") == F.col("most_td_a"))).cast("int").alias("mutual"))


def public_tokenizer(name: str) -> str:
    """The path of a tokenizer; the library that holds them is only needed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def align_documents(df: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text", keep: list[str] | None = None, digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows with n_a, n_b, n_groups, n_links, groups, n_best, n_mutual and count_sum beside the columns named in keep (all, if not given).

    groups is `a1,a2|b1;a3|b2,b3` (digest: its SHA-256 in hex).  n_best counts the links whose pair has
    the most links of its B id in the corpus, ties included, n_mutual those that also have the most of
    their A id, count_sum adds up the links of the pairs of all links.  Null and empty texts, and
    those whose tokens' bytes aren't the text's with a space before it, have zeros and ''.  Special
    tokens in texts are plain text.  Equal rows get equal results and count each; an empty table gives
    an empty one.  Columns of the names above are replaced; kept ones are written once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path_a, path_b = path_a or public_tokenizer("byte_bpe_50k.json"), path_b or public_tokenizer("piece_bpe_32k.model")
    out, back = aside(df, [c for c in (df.columns if keep is None else keep) if c not in {*COUNTS, *SUMS}])
    beside = F.to_json(F.struct(*out), AS_JSON) if out else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("td_text"), beside.alias("td_kept"))
    long = ", ".join(f"{c} long" for c in COUNTS[:-1])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, name = fresh_path(spark, "chunks"), f"treedelta_chunks_{uuid.uuid4().hex}"
    made = rows.mapInPandas(_blocks(path_a, path_b, digest, block_chars), f"td_block long, td_seq long, td_places binary, {long}, groups string, td_a long, td_b long, td_times long, td_kept string")
    made.write.option("compression", "zstd").option("path", at).bucketBy(parts, "td_block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay in the shared folder
    pairs = blocks.filter("td_a IS NOT NULL").select("td_block", "td_seq", "td_a", "td_b", "td_times")
    counted = pairs.join(pair_counts(pairs), ["td_a", "td_b"]).select(F.col("td_block").alias("td_of"), F.col("td_seq").alias("td_pair"), "times", "best", "mutual")
    documents = blocks.filter("td_a IS NULL").drop("td_a", "td_b", "td_times")
    done = documents.groupBy("td_block").cogroup(counted.groupBy("td_of")).applyInPandas(_summed, f"td_kept string, {long}, groups string, " + ", ".join(f"{c} long" for c in SUMS))
    if out:
        done = done.withColumn("td_kept", F.from_json("td_kept", df.select(*out).schema, AS_JSON)).select("td_kept.*", *COUNTS, *SUMS)
    return done.select(*back, *COUNTS, *SUMS)


def op13(spark, sf_dir) -> DataFrame:
    """The alignment of every document, its groups as a digest."""
    rows = align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], digest=True)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_mutual")
