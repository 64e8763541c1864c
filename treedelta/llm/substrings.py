"""Substring dedup: windows of 50 words that repeat across documents, found behind a count-min prefilter.

Equal windows hold equal runs of 25 words, so the least hash among a window's 26 runs (its anchor) is
a property of the window's words: an anchor occurs at least as often as each of its windows.  The
first pass counts anchors, one for about every 13 windows, in a count-min sketch of two rows: each
partition counts its own cells, blocks of cells are added up across partitions, and only one bit
per cell is left, "two or more".  The second pass emits the windows whose anchor is estimated at two
or more in both rows and groups just these, exactly, by 128 bits of their words.  Estimates are never
too low, so no repeated window is lost; a sketch that is too narrow only lets more windows through.

A hash is a value modulo 2**64 with random 64-bit words; texts made to collide are out of scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_CELLS, SKETCH_SCHEMA, aside, batch_word_hashes, cells, grams, int64, merged_sketch, seen_twice, sketch_rows, small_batches, table, word_hashes

WINDOW = 50
RUN = 25
#: log2 of the cells in a row of the sketch; 16 MB a row are broadcast, whatever the input.
CELL_BITS = 27


def _anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window: a sliding minimum of the hashes of 25-word runs."""
    least = grams(words, RUN)
    span = WINDOW - RUN + 1
    if len(least) < span:
        return np.zeros(0, dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[: len(least) - (span - step)], least[span - step :])


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the whole batch, the starts of windows that lie within one text, and the text of each."""
    words, offsets = batch_word_hashes(texts)
    counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    start = np.arange(len(text)) - before[text] + offsets[:-1][text] if len(text) else np.zeros(0, np.int64)
    return words, start, text


def _second(words: np.ndarray) -> np.ndarray:
    """Another hash of each window, from other hashes of its words."""
    return grams(words * np.uint64(0xE7037ED1A0B428DB) ^ (words >> np.uint64(29)), WINDOW, seed=1)


def _runs(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a value or a text begins; a run of one anchor counts once."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return new


def _sketch(texts: DataFrame, bits: int) -> list[np.ndarray]:
    """The merged sketch of the anchors of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            words, start, text = _windows(batch.column(0))
            if len(start) == 0:
                continue
            anchors = _anchors(words)[start]
            for into, at in zip(held, cells(anchors[_runs(anchors, text)], bits), strict=True):
                into.append(at)
            size += len(held[0][-1])
            if size > FLUSH_CELLS:
                yield from sketch_rows(held, bits)
                held, size = [[], []], 0
        if size:
            yield from sketch_rows(held, bits)

    return merged_sketch(texts.mapInArrow(count, SKETCH_SCHEMA), bits)


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS) -> DataFrame:
    """(td_id, td_text, td_start): the windows of each text that also start in a text of a smaller id; equal windows of one text by their first start."""
    small_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("td_id"), F.xxhash64(text_col).alias("td_text"), F.col(text_col).alias("text")).filter("td_id is not null and text is not null")
    sent = df.sparkSession.sparkContext.broadcast(_sketch(texts.select("text"), cell_bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in batches:
            words, start, text = _windows(batch.column(2))
            if len(start) == 0:
                continue
            anchors = _anchors(words)[start]
            new = _runs(anchors, text)
            hit = seen_twice(rows, anchors[new], cell_bits)
            kept = np.flatnonzero(hit[np.cumsum(new) - 1])
            first = int64(grams(words, WINDOW))
            second = int64(_second(words))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))])
            # A window that a text holds several times is sent once, with its first start.
            order = np.lexsort((kept, second[start[kept]], first[start[kept]], text[kept]))
            sorted_ = kept[order]
            again = np.zeros(len(kept), dtype=bool)
            again[1:] = (text[sorted_[1:]] == text[sorted_[:-1]]) & (first[start[sorted_[1:]]] == first[start[sorted_[:-1]]]) & (second[start[sorted_[1:]]] == second[start[sorted_[:-1]]])
            kept = sorted_[~again]
            for at in range(0, len(kept), 65536):
                own = kept[at : at + 65536]
                of = text[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first[start[own]]),
                        pa.array(second[start[own]]),
                        batch.column(0).take(pa.array(of)),
                        batch.column(1).take(pa.array(of)),
                        pa.array((own - offsets[of]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "td_id", "td_text", "td_start"],
                )

    windows = texts.mapInArrow(emit, "h1 long, h2 long, td_id long, td_text long, td_start int")
    # One exchange serves both the least ids and the windows that look them up: to be reused it has
    # to carry the same columns, so the sums name those that only the windows need, too.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = windows.filter("h1 is not null and h2 is not null and td_id is not null and td_text is not null")  # what the join would only ask of one side
    dealt = whole.repartition(n, "h1", "h2")
    sums = dealt.groupBy("h1", "h2").agg(F.min("td_id").alias("least"), F.max("td_id").alias("most"), F.max("td_text").alias("any_text"), F.max("td_start").alias("any_start"))
    least = sums.filter("least < most and any_text is not null and any_start is not null").select("h1", "h2", "least")
    return dealt.join(least.hint("shuffle_hash"), ["h1", "h2"]).filter("td_id > least").select("td_id", "td_text", "td_start")


def _covered(text: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """Words of n that the windows at these starts, and the text's windows equal to them, cover."""
    words = word_hashes(text)
    first, second = grams(words, WINDOW), _second(words)
    at = np.flatnonzero(np.isin(first, first[starts]) & np.isin(second, second[starts]))
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS) -> DataFrame:
    """The input rows with n_words, n_removed and kept_text (the words that stay, joined by one space).

    A word goes if it lies in a window of 50 words that also starts in a document of a smaller id;
    windows are judged on the input.  Rows of one id are one document's: none is smaller.  A null id
    is neither smaller nor larger than others, so nothing is removed.  Null and empty texts have no
    words; an empty table gives an empty one.  Columns of the three names are replaced, others kept.
    """
    keep = [c for c in df.columns if c not in {"n_words", "n_removed", "kept_text"}]
    starts = repeated_windows(df, id_col, text_col, cell_bits).groupBy("td_id", "td_text").agg(F.collect_list("td_start").alias("starts"))
    out, back = aside(df, [c for c in keep if c != text_col])
    at = keep.index(text_col)
    back.insert(at, F.col("td_string").alias(text_col))
    rows = df.select(*out, F.col(text_col).alias("td_string"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_col).alias("own_text"))
    joined = rows.join(starts.hint("shuffle_hash"), (F.col("own_id") == F.col("td_id")) & (F.col("own_text") == F.col("td_text")), "left")

    @F.arrow_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        sizes, removed, kept = [], [], []
        for text, found in zip(texts, lists, strict=True):
            raw = (text.as_py() or "").encode()
            words = raw.split()
            sizes.append(len(words))
            if found.values is None:
                removed.append(0)
            else:
                gone = _covered(raw, found.values.to_numpy(), len(words))
                removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept_text"])

    done = joined.withColumn("td_out", cut(F.col("td_string"), F.col("starts")))
    return done.select(*back, "td_out.n_words", "td_out.n_removed", "td_out.kept_text")


def op7(spark, sf_dir) -> DataFrame:
    """What is left of every document."""
    left = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
