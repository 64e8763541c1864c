"""Media columns: baseline JPEG written and read in numpy.

The writer stores bytes as a grayscale image whose 8x8 blocks are flat: with quantisation step 8 a
block of value v has the DC coefficient v - 128 and nothing else, so its unit, the block, is stored
without loss.  Its Huffman table gives category s (0 to 8) a code of 9 - s bits; with s bits of
magnitude and one bit for the end of the block every block takes 10 bits, which numpy packs and
unpacks at once.

The reader takes any baseline stream: it parses the markers, Huffman-decodes the scans (restart
intervals and subsampled chroma too) and keeps the DC coefficients of the first component, which
make a luminance thumbnail of one eighth of the size.  Streams whose blocks all take the same number
of bits by their own tables are decoded in one numpy pass, others symbol by symbol.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, small_batches, table

UNIT = 576
#: A side of an image has 8,191 blocks at most.
MOST_BLOCKS = 8191
#: Bits of the code of each category of the writer.
DC_LENGTHS = {s: 9 - s for s in range(9)}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table_bytes(kind: int, lengths: dict[int, int]) -> bytes:
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes([kind, *counts, *sorted(lengths, key=lambda s: (lengths[s], s))])


def _codes(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by the canonical rule."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


@cache
def _ten_bits() -> np.ndarray:
    """The ten bits of a block for each difference from -255 to 255 of two DC values."""
    table_ = _table_bytes(0, DC_LENGTHS)
    codes = _codes(list(table_[1:17]), table_[17:])
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, _ = codes[s]
        out[d + 255] = ((code << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
    return out


def _image(data: np.ndarray) -> bytes:
    """One image that holds a multiple of 576 bytes."""
    width = 24 if len(data) <= 24 * MOST_BLOCKS // UNIT * UNIT else UNIT
    height = len(data) // width
    bits = _ten_bits()[np.diff(data.astype(np.int16), prepend=np.int16(128)) + 255].astype(np.uint64).reshape(-1, 4)
    packed = (bits[:, 0] << np.uint64(30)) | (bits[:, 1] << np.uint64(20)) | (bits[:, 2] << np.uint64(10)) | bits[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0)
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _segment(0xDB, bytes([0] + [8] * 64)),
        _segment(0xC0, frame),
        _segment(0xC4, _table_bytes(0x00, DC_LENGTHS)),
        _segment(0xC4, _table_bytes(0x10, {0: 1})),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        scan,
        b"\xff\xd9",
    ])


def write(data: bytes) -> bytes:
    """Baseline JPEG that holds the bytes, whose number is a positive multiple of 576; long ones as several images in a row."""
    if not data or len(data) % UNIT:
        raise ValueError("a positive multiple of 576 bytes is needed")
    values = np.frombuffer(data, dtype=np.uint8)
    step = UNIT * MOST_BLOCKS
    return b"".join(_image(values[at : at + step]) for at in range(0, len(values), step))


class _Table:
    """A Huffman table as a lookup of 16 bits."""

    def __init__(self, counts: list[int], symbols: bytes) -> None:
        self.codes = _codes(counts, symbols)
        self.symbol, self.length = np.zeros(1 << 16, dtype=np.int16), np.zeros(1 << 16, dtype=np.int8)
        for s, (code, n) in self.codes.items():
            self.symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
            self.length[code << (16 - n) : (code + 1) << (16 - n)] = n


class _Bits:
    """Bits of one restart interval; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data + b"\x00" * 8, 0, len(data) * 8

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        i = self.at >> 3
        value = (int.from_bytes(self.data[i : i + 4], "big") >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, table_: _Table) -> int:
        if self.at >= self.size:
            raise ValueError("the scan ends early")
        bits = self.peek16()
        n = int(table_.length[bits])
        if n == 0:
            raise ValueError("no such Huffman code")
        self.at += n
        return int(table_.symbol[bits])


def _dc(bits: _Bits, dc: _Table, ac: _Table) -> int:
    """The difference of one block's DC; its AC coefficients are passed over."""
    s = bits.symbol(dc)
    raw = bits.take(s) if s else 0
    k = 1
    while k < 64:
        rs = bits.symbol(ac)
        if rs == 0:
            break
        bits.at += rs & 15
        k += (rs >> 4) + 1
    return raw if not s or raw >> (s - 1) else raw - (1 << s) + 1


def _even_width(dc: _Table, ac: _Table) -> int:
    """Bits of every block if all blocks of these tables take the same number, else 0."""
    widths = {n + s for s, (_, n) in dc.codes.items()}
    return widths.pop() + ac.codes[0][1] if len(widths) == 1 and list(ac.codes) == [0] else 0


def _even_scan(data: bytes, n: int, width: int, dc: _Table) -> np.ndarray:
    """DC differences of n blocks of `width` bits each."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) * 8 < n * width:
        raise ValueError("the scan ends early")
    if width == 10:
        whole = np.zeros(-(-n // 4) * 5, dtype=np.uint8)
        whole[: min(len(raw), len(whole))] = raw[: len(whole)]
        five = whole.reshape(-1, 5).astype(np.uint64)
        packed = (five[:, 0] << np.uint64(32)) | (five[:, 1] << np.uint64(24)) | (five[:, 2] << np.uint64(16)) | (five[:, 3] << np.uint64(8)) | five[:, 4]
        words = np.stack([(packed >> np.uint64(k)) & np.uint64(1023) for k in (30, 20, 10, 0)], axis=1).reshape(-1)[:n].astype(np.int64)
    else:
        bits = np.unpackbits(raw)[: n * width].reshape(n, width)
        words = bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
    known = np.full(1 << width, 1 << 20, dtype=np.int32)
    for s, (code, length) in dc.codes.items():
        tail = width - length - s
        for mag in range(1 << s):
            value = mag if not s or mag >> (s - 1) else mag - (1 << s) + 1
            known[((code << s) | mag) << tail] = value  # the end of the block is a zero code
    out = known[words]
    if (out == 1 << 20).any():
        raise ValueError("no such Huffman code")
    return out


def _one(data: bytes, at: int) -> tuple[int, int, np.ndarray, int]:
    """Width, height and thumbnail of the image that starts at `at`, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    at += 2
    steps: dict[int, np.ndarray] = {}
    tables: dict[int, _Table] = {}
    frame, interval, thumb = None, 0, None
    while True:
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9":
            raise ValueError("the image ends early")
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if frame is None or thumb is None:
                raise ValueError("no frame or no luminance scan")
            return frame[1], frame[0], thumb, at + 2
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                steps[key] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], dtype=">u2" if wide else np.uint8)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = _Table(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("8-bit samples only")
            frame = (height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline only")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("no frame")
            end = at
            while True:  # to the next marker that isn't a restart or a stuffed byte
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            got = _scan(data[at:end], frame, [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])], tables, steps, interval)
            thumb = got if got is not None else thumb
            at = end


def _scan(data: bytes, frame: tuple, parts: list[tuple[int, int]], tables: dict[int, _Table], steps: dict[int, np.ndarray], interval: int) -> np.ndarray | None:
    """The thumbnail, if the first component is in this scan."""
    height, width, comps = frame
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    first = comps[0]
    chosen = [(next(c for c in comps if c[0] == key), tables[t >> 4], tables[16 | (t & 15)]) for key, t in parts]
    if all(c is not first for c, _, _ in chosen):
        return None
    blocks = lambda side, own, most: -(-(-(-side * own // most)) // 8)
    wide, tall = blocks(width, first[1], most_h), blocks(height, first[2], most_v)
    if len(chosen) == 1:  # not interleaved: the component's own blocks
        mcus, grid_w, grid_h, shape = wide * tall, wide, tall, [(0, 0, 0)]
    else:
        mcu_w, mcu_h = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        mcus, grid_w, grid_h = mcu_w * mcu_h, mcu_w * first[1], mcu_h * first[2]
        shape = [(i, x, y) for i, (c, _, _) in enumerate(chosen) for y in range(c[2]) for x in range(c[1])]
    if interval:
        split, start, at = [], 0, 0
        while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
            if 0xD0 <= data[at + 1] <= 0xD7:
                split.append(data[start:at])
                start = at + 2
            at += 2
        split.append(data[start:])
    else:
        split = [data]
    grid, done = np.zeros((grid_h, grid_w), dtype=np.int64), 0
    even = _even_width(chosen[0][1], chosen[0][2]) if len(chosen) == 1 else 0
    for part in split:
        count = min(interval or mcus, mcus - done)
        part = part.replace(b"\xff\x00", b"\xff")  # noqa: PLW2901
        if even:
            grid.reshape(-1)[done : done + count] = np.cumsum(_even_scan(part, count, even, chosen[0][1]))
            done += count
            continue
        bits, last = _Bits(part), [0] * len(chosen)
        for m in range(done, done + count):
            for i, x, y in shape:
                last[i] += _dc(bits, chosen[i][1], chosen[i][2])
                if chosen[i][0] is first:
                    if len(chosen) == 1:
                        grid[m // grid_w, m % grid_w] = last[i]
                    else:
                        grid[m // mcu_w * first[2] + y, m % mcu_w * first[1] + x] = last[i]
        done += count
    if done < mcus:
        raise ValueError("the scan ends early")
    # A flat block's samples are the DC coefficient by one eighth of its quantisation step.
    values = grid[:tall, :wide] * int(steps[first[3]][0])
    return np.clip((values + 4) // 8 + 128, 0, 255).astype(np.uint8)


def read(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """Width, height and DC-only luminance thumbnail of each image of a stream; ValueError if it isn't baseline JPEG."""
    out, at = [], 0
    while at < len(media):
        width, height, thumb, at = _one(media, at)
        out.append((width, height, thumb))
    if not out:
        raise ValueError("no image")
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash and difference hash of a thumbnail, 64 bits each: cells of an 8x8 and an 8x9 grid against their mean and their neighbour."""

    def cells(tall: int, wide: int) -> np.ndarray:
        y, x = np.arange(tall) * thumb.shape[0] // tall, np.arange(wide) * thumb.shape[1] // wide
        edge = lambda at, n: np.maximum(np.append(at[1:], n), at + 1)
        sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
        sums[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
        y2, x2 = edge(y, thumb.shape[0]), edge(x, thumb.shape[1])
        total = sums[y2][:, x2] - sums[y][:, x2] - sums[y2][:, x] + sums[y][:, x]
        return total / ((y2 - y)[:, None] * (x2 - x)[None, :])

    square, steps = cells(8, 8), cells(8, 9)
    return np.packbits(square > square.mean()).tobytes().hex() + ":" + np.packbits(steps[:, 1:] > steps[:, :-1]).tobytes().hex()


def padded(text: str | None) -> bytes:
    """A text's bytes and bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


_READ = T.StructType([T.StructField("feature", T.StringType()), T.StructField("payload", T.BinaryType())])
_STORED = T.StructType([T.StructField("media", T.BinaryType()), *_READ.fields])


def _read_all(media: list[bytes | None]) -> list[pa.Array]:
    features, payloads = [], []
    for m in media:
        try:
            images = read(m)
            features.append(",".join(f"{w}x{h}:{thumbnail_hash(t)}" for w, h, t in images))
            payloads.append(b"".join(t.tobytes() for _, _, t in images))
        except (TypeError, ValueError, IndexError, KeyError, StopIteration, struct.error):
            features.append(None)
            payloads.append(None)
    return [pa.array(features, pa.string()), pa.array(payloads, pa.binary())]


@F.arrow_udf(_READ)
def read_media(media: pa.Array) -> pa.Array:
    """The thumbnails' bytes, and the feature: size and thumbnail hashes of each image.  Null where the bytes aren't baseline JPEG."""
    return pa.StructArray.from_arrays(_read_all(media.to_pylist()), ["feature", "payload"])


@F.arrow_udf(_STORED)
def store_text(texts: pa.Array) -> pa.Array:
    """Each text, padded, as baseline JPEG, and what read_media finds in that; in one pass."""
    media = [write(padded(t)) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(media, pa.binary()), *_read_all(media)], ["media", "feature", "payload"])


def add_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with media (baseline JPEG that holds the text), feature and payload (read back from it).

    A null text counts as empty and gives one image of padding.  Columns of the three names are
    replaced, others kept; equal texts give equal values; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in {"media", "feature", "payload"}]
    stored = df.withColumn("td_stored", store_text(F.col(text_col)))
    return stored.select(*named(keep), "td_stored.media", "td_stored.feature", "td_stored.payload")


def _size(column: str) -> Column:
    return F.octet_length(column).cast("long")


def op6(spark, sf_dir) -> DataFrame:
    """Every document as JPEG and read back, as digests."""
    rows = add_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.coalesce(_size("text"), F.lit(0)).alias("n_bytes"),
        _size("payload").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        _size("media").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
