"""Suffix-array dedup: bytes that lie in 100-byte strings which also start earlier in the corpus.

The suffix array of a stretch of text is built by linear grouping (suffix_order): suffixes start in
groups by first byte, groups are processed in descending order, and each hands its members' previous
smaller suffixes, found by pointers, on to new groups, so that in the end a group holds the suffixes
of one Lyndon prefix; a second scan emits each group's order.  Nothing is renamed, nothing recurs.

A suffix array of the corpus isn't built in one place.  Each 100-byte window has an anchor, the least
hash of its 50-byte strings, and equal windows have equal anchors, so windows are dealt by anchors:

1. Blocks of documents send each anchor once.  What is found twice, over all blocks, can repeat.
2. Consecutive windows of one anchor are a record, a stretch of up to 150 bytes.  Blocks send the
   records of repeated anchors, of equal ones only the earliest; later ones repeat in whole.
3. A bucket of anchors again keeps the earliest of equal records; of anchors with different records
   left, suffix arrays put equal windows side by side, and all but the earliest go.
4. Blocks cut what the windows that go cover.

An anchor that stands in more than HOT different records (a line that many documents hold, each in
its own context) isn't gathered in one task: its windows go by 128 bits of their bytes instead, each
by itself.  Hashes are values modulo 2**64 with random words; texts made to collide are out of scope.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE_VALUES, _BYTES, aside, fresh_path, give_back, lean, mix, small_batches, table, written
from .pieces import _grown, _shrunk

WINDOW, GRAM = 100, 50
#: A block takes documents up to so many bytes, or one longer document; bytes are hashed in slices of less than 2**PLACE_BITS.
BLOCK_BYTES, PLACE_BITS = 8 << 20, 20
#: Different records of one anchor that are gathered in one task; beyond, windows go by themselves.
HOT = 4096
#: Buckets of anchors for each shuffle partition, and bytes of one suffix array.
BUCKETS_EACH, ARRAY_BYTES = 4, 1 << 16
LAST = np.iinfo(np.int64).max


def suffix_order(text: bytes) -> list[int]:
    """The starts of all suffixes, in order."""
    n = len(text)
    data = np.frombuffer(text, dtype=np.uint8)
    order = np.argsort(data, kind="stable")
    sizes = np.bincount(data, minlength=256)
    starts = np.cumsum(sizes) - sizes
    group = starts[data].tolist()  # of each suffix, the place where its group starts
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    at, place, end = order.tolist(), place.tolist(), [0] * n
    for a, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size:
            end[a] = a + size
    previous, high = [-1] * n, n
    while high > 0:
        low = group[at[high - 1]]
        members = at[low:high]
        if high - low > 1:
            members.sort()
        counts: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        high = low
        # Those that this group follows most often come highest in their own group.
        if len(counts) == 1:
            levels = [list(counts)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in counts.items():
                by_count.setdefault(k, []).append(p)
            levels = [by_count[k] for k in sorted(by_count, reverse=True)]
        for level in levels:
            ends: dict[int, int] = {}
            for p in level:
                g = group[p]
                e = end[g]
                if g not in ends:
                    ends[g] = e
                e -= 1
                end[g] = e
                other, own = at[e], place[p]
                at[e], at[own], place[p], place[other] = p, other, e, own
            for g, e in ends.items():
                new = end[g]
                if new == g:  # the whole group
                    end[g] = e
                else:
                    end[new] = e
                    for p in at[new:e]:
                        group[p] = new
    out, front = [0] * n, list(range(n))
    placed = bytearray(n)
    last = n
    for i in range(-1, n):
        s = (out[i] if i >= 0 else last) - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = previous[s]
    return out


def _slices(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Stretches of bytes with (document, its start there, the place in it from which the stretch begins) for each document in it."""
    most = (1 << PLACE_BITS) - 1
    parts, inside, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        if size and size + len(text) > most:
            yield b"".join(parts), inside
            parts, inside, size = [], [], 0
        if len(text) > most:
            for a in range(0, len(text) - WINDOW + 1, most - WINDOW + 1):
                yield text[a : a + most], [(k, 0, a)]
            continue
        inside.append((k, size, 0))
        parts.append(text)
        size += len(text)
    if parts:
        yield b"".join(parts), inside


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for polynomial hashes, and the inverse powers."""
    up, down = _BYTES(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return sums, down


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Sliding minima."""
    step = 1
    while step * 2 <= span:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = span - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def records(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The records of all texts: document, start, windows, anchor (44 bits) and a hash of the bytes.

    Of equal least hashes in a window the leftmost is its anchor, so a record has one place of it.
    """
    found = []
    for data, inside in _slices(texts):
        data = np.frombuffer(data, dtype=np.uint8)
        sums, down = _sums(data)
        n = len(data) - GRAM + 1
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        low = np.uint64((1 << PLACE_BITS) - 1)
        anchors = _least((hashes & ~low) | np.arange(n, dtype=np.uint64), WINDOW - GRAM + 1)
        new = np.ones(len(anchors), dtype=bool)
        new[1:] = anchors[1:] != anchors[:-1]
        begins = np.array([b for _, b, _ in inside])
        ends = np.append(begins[1:], len(data)) - WINDOW + 1  # of window starts
        new[begins] = True
        stops = ends[ends < len(anchors)]
        new[stops] = True
        starts = np.flatnonzero(new)
        wins = np.diff(np.append(starts, len(anchors)))
        of = np.searchsorted(begins, starts, side="right") - 1
        whole = starts < ends[of]  # windows that run on into the next document form records of their own
        starts, wins, of = starts[whole], wins[whole], of[whole]
        content = mix((sums[starts + wins + WINDOW - 1] - sums[starts]) * down[starts] + wins.astype(np.uint64))
        shift = np.array([a - b for _, b, a in inside])
        found.append((np.array([k for k, _, _ in inside])[of], starts + shift[of], wins, anchors[starts] >> np.uint64(PLACE_BITS), content))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(values: np.ndarray) -> bytes:
    """64-bit values, byte plane by byte plane."""
    return _shrunk(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(_grown(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _bucket(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchors) % np.uint64(buckets)).astype(np.int64)


def _listed(texts: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, distinct anchors, records of each, different ones of these) of a block."""
    _, _, _, anchor, content = records(texts)
    bucket = _bucket(anchor, buckets)
    order = np.lexsort((content, anchor, bucket))
    bucket, anchor, content = bucket[order], anchor[order], content[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = anchor[1:] != anchor[:-1]
    other = first.copy()
    other[1:] |= content[1:] != content[:-1]
    heads = np.flatnonzero(first)
    n = np.diff(np.append(heads, len(order)))
    kinds = np.add.reduceat(other, heads).astype(np.int64) if len(heads) else n
    cuts = np.searchsorted(bucket[heads], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        x = slice(cuts[b], cuts[b + 1])
        yield b, anchor[heads[x]], n[x], kinds[x]


_FIXED = [("td_block", pa.int64()), ("td_seq", pa.int32()), ("td_bucket", pa.int32()), ("td_list", pa.binary()), ("td_counts", pa.binary()), ("td_bytes", pa.binary())]
_ROW = "td_block long, td_seq int, td_bucket int, td_list binary, td_counts binary, td_bytes binary"


def _blocks(buckets: int, most: int):
    """Rows of two forms: a document with td_bytes; and a block's distinct anchors of one bucket, with how many records they have (2: more) and how many kinds of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, texts, size, schema = TaskContext.get().partitionId() << 32, [], 0, None

        def fill(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

        def lists() -> Iterator[pa.RecordBatch]:
            rows = [(b, _pack(np.diff(a, prepend=np.uint64(0))), np.stack([np.minimum(n, 2), np.minimum(k, 255)]).astype(np.uint8).tobytes()) for b, a, n, k in _listed(texts, buckets)]
            if rows:
                b, a, c = zip(*rows, strict=True)
                yield fill(len(rows), td_block=pa.array([number] * len(rows)), td_bucket=pa.array(b), td_list=pa.array(a, pa.binary()), td_counts=pa.array(map(_shrunk, c), pa.binary()))

        for batch in batches:
            schema = schema or pa.schema([*_FIXED, *[(f.name, f.type) for f in batch.schema if f.name != "td_bytes"]])
            raw = batch.column("td_bytes").to_pylist()
            at = 0
            while at < len(raw):
                if size and size + len(raw[at]) > most:
                    yield from lists()
                    number, texts, size = number + 1, [], 0
                to = at
                while to < len(raw) and (not size or size + len(raw[to]) <= most):
                    size += len(raw[to])
                    texts.append(raw[to])
                    to += 1
                    if to - at == len(raw):
                        break
                part, n = batch.slice(at, to - at), to - at
                own = {f.name: part.column(f.name) for f in part.schema}
                yield fill(n, td_block=pa.array([number] * n), td_seq=pa.array(range(len(texts) - n, len(texts))), **own)
                at = to
        if texts:
            yield from lists()

    return run


def _repeated(hot: int):
    """For each block's list of one bucket: 0 for anchors of one record in all blocks, 1 for repeated ones, 2 for those of more than `hot` kinds."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lists = [np.cumsum(_unpack(x, np.uint64)) for x in rows.column("td_list").to_pylist()]
        counts = [np.frombuffer(_grown(x), dtype=np.uint8).reshape(2, -1) for x in rows.column("td_counts").to_pylist()]
        _, where = np.unique(np.concatenate(lists), return_inverse=True)
        n, kinds = (np.bincount(where, weights=np.concatenate([c[i] for c in counts])) for i in (0, 1))
        flags = np.where(n < 2, 0, np.where(kinds > hot, 2, 1)).astype(np.uint8)[where]
        parts = [_shrunk(x.tobytes()) for x in np.split(flags, np.cumsum([len(x) for x in lists])[:-1])]
        give_back()
        return pa.table([rows.column("td_block"), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["td_of", "td_in", "td_flags"])

    return run


_SENT = pa.schema([("td_block", pa.int64()), ("td_to", pa.int32()), ("td_hot", pa.bool_()), ("td_items", pa.binary()), ("td_text", pa.binary())])


def _earliest(ids: np.ndarray, starts: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, is earliest) of each row, where rows of equal keys are a class and its earliest are those of the least (id, start)."""
    order = np.lexsort((starts, ids, *keys))
    first = np.zeros(len(order), dtype=bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[order][1:] != k[order][:-1]
    of = np.cumsum(first) - 1
    heads = order[first]
    least = np.empty(len(order), dtype=bool)
    least[order] = (ids[order] == ids[heads][of]) & (starts[order] == starts[heads][of])
    classes = np.empty(len(order), dtype=np.int64)
    classes[order] = of
    return classes, least


def _sent(buckets: int):
    def run(key: tuple, documents: pa.Table, flags: pa.Table) -> pa.Table:
        """Of one block: the records that go in whole (td_to null), and for each bucket the records, or the windows of hot anchors, that others may repeat."""
        documents = documents.sort_by("td_seq")
        texts, block = documents.column("td_bytes").to_pylist(), key[0].as_py()
        id_of = pc.fill_null(documents.column("td_id"), LAST).to_numpy()
        rows: list[tuple] = []

        def send(to: int | None, hot: bool, of: np.ndarray, start: np.ndarray, wins: np.ndarray, keys: list[np.ndarray], text: bytes | None) -> None:
            items = np.concatenate([[len(of)], of, start, wins, id_of[of], *[k.view(np.int64) for k in keys]]).astype(np.int64)
            rows.append((block, to, hot, _pack(items), text))

        of, start, wins, anchor, content = records(texts)
        marks = dict(zip(flags.column("td_in").to_pylist(), flags.column("td_flags").to_pylist(), strict=True))
        bucket = _bucket(anchor, buckets)
        order = np.lexsort((anchor, bucket))
        head = np.ones(len(order), dtype=bool)
        head[1:] = anchor[order][1:] != anchor[order][:-1]
        flag = np.zeros(len(order), dtype=np.uint8)
        if marks:
            flag[order] = np.concatenate([np.frombuffer(_grown(marks[b]), dtype=np.uint8) for b in sorted(marks)])[np.cumsum(head) - 1]
        kept = np.flatnonzero(flag)
        of, start, wins, anchor, content, bucket, flag = (x[kept] for x in (of, start, wins, anchor, content, bucket, flag))
        _, least = _earliest(id_of[of], start, content, anchor)
        own, hot = [np.flatnonzero(~least)], np.flatnonzero(least & (flag == 2))
        cold = np.flatnonzero(least & (flag == 1))
        cold = cold[np.argsort(bucket[cold], kind="stable")]
        cuts = np.searchsorted(bucket[cold], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            x = cold[cuts[b] : cuts[b + 1]]
            x = x[np.argsort(anchor[x], kind="stable")]
            text = b"".join([texts[k][a : a + w + WINDOW - 1] for k, a, w in zip(of[x].tolist(), start[x].tolist(), wins[x].tolist(), strict=True)])
            send(b, False, of[x], start[x], wins[x], [anchor[x]], _shrunk(text))
        gone = (of[own[0]], start[own[0]], wins[own[0]])
        if len(hot):
            each = np.repeat(hot, wins[hot])
            at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(wins[hot]) - wins[hot], wins[hot])
            h1, h2 = (np.empty(len(each), np.uint64) for _ in range(2))
            for k in np.unique(of[each]).tolist():
                here = of[each] == k
                h1[here], h2[here] = _window_hashes(texts[k], at[here])
            _, least = _earliest(id_of[of[each]], at, h1, h2)
            gone = tuple(np.concatenate(x) for x in zip(gone, (of[each[~least]], at[~least], np.ones((~least).sum(), np.int64)), strict=True))
            each, at, h1, h2 = each[least], at[least], h1[least], h2[least]
            to = _bucket(h1, buckets)
            for b in np.unique(to).tolist():
                x = np.flatnonzero(to == b)
                send(b, True, of[each[x]], at[x], np.ones(len(x), np.int64), [h1[x], h2[x]], None)
        if len(gone[0]):
            send(None, False, *gone, [], None)
        out = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()
        give_back()
        return out

    return run


def _window_hashes(text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at these ascending starts, stretch by stretch."""
    out, most = (np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)), 1 << PLACE_BITS
    order = np.argsort(starts, kind="stable")
    ascending, at = starts[order], 0
    while at < len(order):
        base = int(ascending[at])
        to = int(np.searchsorted(ascending, base + most))
        data = np.frombuffer(text[base : int(ascending[to - 1]) + WINDOW], dtype=np.uint8)
        sums, down = _sums(data)
        s = ascending[at:to] - base
        out[0][order[at:to]] = mix((sums[s + WINDOW] - sums[s]) * down[s])
        sums, down = _sums(np.bitwise_xor(data, np.uint8(0xA5)))
        middle = s + WINDOW // 3
        out[1][order[at:to]] = mix((sums[s + WINDOW] - sums[middle]) * down[middle] + mix((sums[middle] - sums[s]) * down[s]))
        at = to
    return out


def _equal_windows(texts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each of different texts that start at (id, start): which of its windows also start earlier in one of the others, by their suffix array."""
    data = b"".join(texts)
    wins = np.array([len(t) - WINDOW + 1 for t in texts])
    begins = np.cumsum(wins + WINDOW - 1) - (wins + WINDOW - 1)
    order = np.array(suffix_order(data))
    of = np.searchsorted(begins, order, side="right") - 1
    inside = order - begins[of]
    valid = inside < wins[of]
    order, of, inside = order[valid], of[valid], inside[valid]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), WINDOW)[order]
    new = np.ones(len(order), dtype=np.int64)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    _, least = _earliest(ids[of], starts[of] + inside, np.cumsum(new))
    gone = [np.zeros(w, dtype=bool) for w in wins.tolist()]
    for k, i in zip(of[~least].tolist(), inside[~least].tolist(), strict=True):
        gone[k][i] = True
    return gone


_GONE = pa.schema([("td_of", pa.int64()), ("td_gone", pa.binary())])


def _later(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one bucket: the windows of each block that also start earlier, as document, start and number."""
    del key
    blocks, items = rows.column("td_block").to_pylist(), [_unpack(x) for x in rows.column("td_items").to_pylist()]
    hot = np.array(rows.column("td_hot").to_pylist())
    out: list[list[np.ndarray]] = [[] for _ in blocks]

    def columns(which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The row of each item, and the items' columns."""
        parts = [items[k][1:].reshape(-1, items[k][0]) for k in which.tolist()]
        return np.repeat(which, [p.shape[1] for p in parts]), list(np.concatenate(parts, axis=1))

    def leave(row: np.ndarray, *runs: np.ndarray) -> None:
        for k in np.unique(row).tolist():
            out[k].append(np.stack([x[row == k] for x in runs]))

    if hot.any():
        row, (of, start, wins, ids, h1, h2) = columns(np.flatnonzero(hot))
        _, least = _earliest(ids, start, h1, h2)
        leave(row[~least], of[~least], start[~least], wins[~least])
    if not hot.all():
        which = np.flatnonzero(~hot)
        row, (of, start, wins, ids, anchor) = columns(which)
        texts: list[bytes] = []
        for k in which.tolist():
            text = _grown(rows.column("td_text")[k].as_py())
            ends = np.cumsum(items[k][1:].reshape(-1, items[k][0])[2] + WINDOW - 1).tolist()
            texts += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        numbers: dict[bytes, int] = {}
        kind = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
        _, least = _earliest(ids, start, kind)
        leave(row[~least], of[~least], start[~least], wins[~least])
        # One record of each kind; those of anchors with several go to suffix arrays, whole anchors together.
        ones = np.full(len(numbers), -1, np.int64)
        at = np.flatnonzero(least)
        ones[kind[at]] = at
        ones = ones[np.argsort(anchor[ones], kind="stable")]
        heads = np.flatnonzero(np.append(True, anchor[ones][1:] != anchor[ones][:-1]))
        several = [x for x in np.split(ones, heads[1:]) if len(x) > 1]
        twins: dict[int, list[int]] = {}
        for i in at.tolist():
            twins.setdefault(int(kind[i]), []).append(i)
        batch, size = [], 0
        for k, x in enumerate(several):
            batch.append(x)
            size += int(wins[x].sum()) + (WINDOW - 1) * len(x)
            if size < ARRAY_BYTES and k + 1 < len(several):
                continue
            own = np.concatenate(batch)
            for i, gone in zip(own.tolist(), _equal_windows([texts[i] for i in own.tolist()], ids[own], start[own]), strict=True):
                edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if len(a):
                    for t in twins[int(kind[i])]:
                        out[row[t]].append(np.stack([np.full(len(a), of[t]), start[t] + a, b - a]))
            batch, size = [], 0
    found = [(block, _pack(np.concatenate(x, axis=1).ravel())) for block, x in zip(blocks, out, strict=True) if x]
    give_back()
    return pa.Table.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([g for _, g in found], pa.binary())], schema=_GONE)


def _cut(names: list[str]):
    def run(documents: pa.Table, gone: pa.Table) -> pa.Table:
        """Of one block: the documents with what is left of their bytes."""
        documents = documents.sort_by("td_seq")
        runs = [_unpack(x).reshape(3, -1) for x in gone.column("td_gone").to_pylist()]
        of, start, wins = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(documents.num_rows + 1))
        sizes, removed, spans, kept = [], [], [], []
        for k, data in enumerate(documents.column("td_bytes").to_pylist()):
            sizes.append(len(data))
            x = order[cuts[k] : cuts[k + 1]]
            if len(x) == 0:
                removed.append(0)
                spans.append(0)
                kept.append(data)
                continue
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, start[x], 1)
            np.add.at(edge, start[x] + wins[x] + WINDOW - 1, -1)
            covered = np.cumsum(edge[:-1]) > 0
            removed.append(int(covered.sum()))
            spans.append(int((np.diff(covered.view(np.int8), prepend=np.int8(0)) == 1).sum()))
            kept.append(np.frombuffer(data, dtype=np.uint8)[~covered].tobytes())
        long = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
        out = pa.table([*documents.select(names).columns, *long, pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])
        give_back()
        return out

    return run


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept (the bytes that stay) beside the columns named in keep (all, if not given).

    A byte goes if it lies in a 100-byte string of its document that also starts earlier: in a
    document of smaller id, or in the same one before; n_spans counts the stretches that went.  Strings
    are judged on the input.  Rows of one id are one document, of which equal starts are neither
    earlier nor later; rows without id are one document after all others.  Null and empty texts have no
    bytes; an empty table gives an empty one.  Columns of the four names are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    out, back = aside(df, [c for c in (df.columns if keep is None else keep) if c not in made])
    rows = df.select(*out, F.col(f"`{id_col}`").cast("long").alias("td_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("td_bytes"))
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "td_bytes"]
    whole = T.StructType([*T.StructType.fromDDL(_ROW), *kept])
    names = [f.name for f in kept if f.name != "td_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_EACH * parts
    at, name = fresh_path(spark, "suffixes"), f"treedelta_suffixes_{uuid.uuid4().hex}"
    rows.mapInArrow(lean(_blocks(buckets, block_bytes)), whole).write.option("compression", "zstd").option("path", at).bucketBy(parts, "td_block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay in the shared folder
    documents = blocks.filter("td_bucket IS NULL")
    lists = blocks.filter("td_bucket IS NOT NULL").select("td_block", "td_bucket", "td_list", "td_counts")
    flags = lists.groupBy("td_bucket").applyInArrow(_repeated(hot), "td_of long, td_in int, td_flags binary")
    own = documents.select("td_block", "td_seq", "td_id", "td_bytes")
    sent = written(own.groupBy("td_block").cogroup(flags.groupBy("td_of")).applyInArrow(_sent(buckets), "td_block long, td_to int, td_hot boolean, td_items binary, td_text binary"), "records")
    later = sent.filter("td_to IS NOT NULL").groupBy("td_to").applyInArrow(_later, "td_of long, td_gone binary")
    whole_ones = sent.filter("td_to IS NULL").select(F.col("td_block").alias("td_of"), F.col("td_items").alias("td_whole"))
    gone = later.unionByName(whole_ones.mapInArrow(_runs, "td_of long, td_gone binary"))
    result = T.StructType([*[f for f in kept if f.name != "td_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary")])
    done = documents.drop("td_bucket", "td_list", "td_counts", "td_id").groupBy("td_block").cogroup(gone.groupBy("td_of")).applyInArrow(_cut(names), result)
    return done.select(*back, *made)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that go in whole, in the form of what buckets send back."""
    for batch in batches:
        items = [_unpack(x)[1:] for x in batch.column("td_whole").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("td_of"), pa.array([_pack(x[: 3 * (len(x) // 4)]) for x in items], pa.binary())], names=["td_of", "td_gone"])


def op11(spark, sf_dir) -> DataFrame:
    """What is left of every document, as a digest."""
    left = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
