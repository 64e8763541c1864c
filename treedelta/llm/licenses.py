"""License scans: winnowed fingerprints of templates pick candidates, a banded alignment reports coverage and spans.

Texts and templates are compared as words of lower-case letters and digits; everything else in ASCII
separates words.  Three-word fingerprints of each template are winnowed (the least of every three
neighbours), and an inverted index leads from a fingerprint to its templates and positions.  Any run of
five words that a text shares with a template holds one of them.  Hits of a template that lie on
neighbouring diagonals form a candidate, which is aligned word by word in a band around them; what is
reported is the share of the template's words that the alignment matches and the span in the text.
Templates are short notices, file headers and full texts; a match has to hold the words that tell
its license and version from others (REQUIRED).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grams, small_batches, table, word_hashes
from .license_texts import BSD_WARRANTY, ISC_WARRANTY, LONG, MIT_WARRANTY, UNLICENSE, ZLIB

#: Notices of public licenses.
_NOTICES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_START = _NOTICES["BSD-2-Clause/text"]
_GNU = {"GPL": ("General Public", ("1", "2", "3")), "LGPL": ("Lesser General Public", ("2.1", "3")), "AGPL": ("Affero General Public", ("3",)), "LGPL ": ("Library General Public", ("2",))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def _gnu() -> tuple[dict[str, str], dict[str, list[tuple[str, ...]]]]:
    """One-line notices and file headers of the GNU licenses, with what has to be in a match."""
    texts, needed = {}, {}
    for key, (kind, versions) in _GNU.items():
        for v in versions:
            name = f"{key.strip()}-{v if '.' in v else v + '.0'}"
            texts[f"{name}/notice"] = f"This work is licensed under the GNU {kind} License, version {v}."
            texts[f"{name}/header"] = _NOTICES["GPL-3.0/header"].replace("General Public", kind).replace("version 3", f"version {v}")
            texts[f"{name}/permission"] = _NOTICES["GPL-2.0/header"].replace("General Public", kind).replace("version 2", f"version {v}")
            texts[f"{name}/only"] = f"This program is free software; you can redistribute it and/or modify it under the terms of version {v} of the GNU {kind} License as published by the Free Software Foundation."
            for form in ("notice", "header", "permission", "only"):
                needed[f"{name}/{form}"] = [(f"gnu {kind} License",), (f"version {v}", f"v{v}")]
    return texts, needed


def _creative_commons() -> tuple[dict[str, str], dict[str, list[tuple[str, ...]]]]:
    """Notices of the Creative Commons licenses, by short and long name."""
    texts, needed = {}, {}
    for short, long in _CC.items():
        for v, port in _CC_PORTS.items():
            texts[f"CC-{short}-{v}/notice"] = f"Licensed under CC {short} {v}."
            texts[f"CC-{short}-{v}/text"] = f"This work is licensed under a Creative Commons {long} {v} {port} License."
            needed[f"CC-{short}-{v}/notice"], needed[f"CC-{short}-{v}/text"] = [(f"cc {short} {v}",)], [(f"{long} {v}",)]
    return texts, needed


#: Notices, headers and full texts.
TEMPLATES = {
    **_NOTICES,
    **_gnu()[0],
    **_creative_commons()[0],
    "GPL-2.0/header": _NOTICES["GPL-2.0/header"],
    "MIT/full": f"{_NOTICES['MIT/text']} {MIT_WARRANTY}",
    "BSD-2-Clause/full": f"{_BSD_START} {BSD_WARRANTY}",
    "BSD-3-Clause/text": f"{_BSD_START} {_BSD_THIRD}",
    "BSD-3-Clause/full": f"{_BSD_START} {_BSD_THIRD} {BSD_WARRANTY}",
    "BSD-4-Clause/text": f"{_BSD_START} {_BSD_ADVERTISING} {_BSD_THIRD}",
    "BSD-4-Clause/full": f"{_BSD_START} {_BSD_ADVERTISING} {_BSD_THIRD} {BSD_WARRANTY}",
    "BSD-2-Clause/notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License.",
    "ISC/full": f"{_NOTICES['ISC/text']} {ISC_WARRANTY}",
    "Unlicense/full": UNLICENSE,
    "Zlib/full": ZLIB,
    **LONG,
}
#: What tells a license from its neighbours: a match holds one phrase of each tuple, word by word.
REQUIRED: dict[str, list[tuple[str, ...]]] = {
    **_gnu()[1],
    **_creative_commons()[1],
    "MIT/notice": [("mit",)],
    "Apache-2.0/notice": [("apache",), ("2.0", "v2", "v2.0")],
    "Apache-2.0/header": [("apache",), ("2.0", "v2", "v2.0")],
    "MPL-2.0/header": [("mozilla",), ("2.0",)],
    "BSD-2-Clause/notice": [("bsd 2",)],
    "BSD-3-Clause/notice": [("bsd 3",)],
    **{f"BSD-3-Clause/{form}": [("endorse or promote products",)] for form in ("text", "full")},
    **{f"BSD-4-Clause/{form}": [("advertising materials",), ("endorse or promote products",)] for form in ("text", "full")},
    "GPL-1.0/full": [("version 1 february 1989", "version 1")],
    "GPL-2.0/full": [("version 2",)],
    "GPL-3.0/full": [("gnu general public license version 3 29 june 2007", "version 3 of the gnu general public license")],
    "LGPL-2.0/full": [("library general public license",)],
    "LGPL-2.1/full": [("lesser general public license",)],
    "LGPL-3.0/full": [("lesser general public license",)],
    "GFDL-1.2/full": [("version 1.2",)],
    "GFDL-1.3/full": [("version 1.3",)],
    "MPL-1.1/full": [("version 1.1",)],
}
#: Words past a span in which a required phrase may end: a version in another form isn't part of the alignment.
PAST = 2

GRAM, WINNOW = 3, 3
#: Words by which an alignment may leave the candidate's diagonals.
BAND = 12
#: Least share of a template's words that a match has to cover.
COVERAGE = 0.8

_FOLD = bytearray(range(256))
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 32
_FOLD = bytes(_FOLD)


def folded(text: str | None) -> bytes:
    """The text's bytes with ASCII letters in lower case and all other ASCII but digits as spaces; offsets stay."""
    return (text or "").encode().translate(_FOLD)


def winnow(words: np.ndarray) -> np.ndarray:
    """Positions of a template's fingerprints: the last least one of every WINNOW neighbouring grams."""
    found = grams(words, GRAM)
    if len(found) <= WINNOW:
        return np.array([len(found) - 1 - int(found[::-1].argmin())]) if len(found) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(found, WINNOW)
    return np.unique(np.arange(len(windows)) + WINNOW - 1 - windows[:, ::-1].argmin(axis=1))


class Index:
    """Templates as word hashes, and fingerprint -> (template, position)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.words = [word_hashes(folded(t)) for t in templates.values()]
        self.needed = [[[word_hashes(folded(x)) for x in either] for either in (REQUIRED.get(n, ()) if templates is TEMPLATES else ())] for n in self.names]
        posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(self.words):
            marks = grams(words, GRAM)
            for at in winnow(words).tolist():
                posts[int(marks[at])].append((i, at))
        self.posts = dict(posts)
        self.marks = np.sort(np.array(list(self.posts), dtype=np.uint64))

    def told(self, i: int, text: np.ndarray) -> bool:
        """The text holds what tells the template's license from others."""
        has = lambda x: len(x) <= len(text) and bool((np.lib.stride_tricks.sliding_window_view(text, len(x)) == x).all(axis=1).any())
        return all(any(has(x) for x in either) for either in self.needed[i])

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, diagonal, word) of each fingerprint of the text that is in the index."""
        found = grams(words, GRAM)
        if not len(found) or not len(self.marks):
            return []
        at = np.flatnonzero(self.marks[np.minimum(np.searchsorted(self.marks, found), len(self.marks) - 1)] == found)
        return [(i, p - q, p) for p in at.tolist() for i, q in self.posts[int(found[p])]]


@cache
def _public() -> Index:
    return Index(TEMPLATES)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment within diagonals low..high (text word - template word): matched words, first word, end.

    A match counts 2, a mismatch and a gap cost 1; of equal scores the earliest end counts.
    """
    width = high - low + 1
    lanes = np.arange(width)
    score, count, start = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        j = lanes + (i + low)
        inside = (j >= 0) & (j < len(text))
        if not inside.any():
            if i + low >= len(text):
                break
            continue
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == word)
        # The cell of (i - 1, j - 1) is on the same diagonal, (i - 1, j) on the next, (i, j - 1) on the one before.
        own = score[:-1] + np.where(same, 2, -1)
        above = score[1:] - 1
        up = above > own
        value = np.where(inside, np.maximum(np.where(up, above, own), 0), 0)
        # Steps along the text cost 1 each, so the best source of a cell is the last one that leads value + lane.
        led = np.maximum.accumulate(value + lanes)
        source = np.maximum.accumulate(np.where(value + lanes == led, lanes, 0))
        total = np.where(inside, led - lanes, 0)
        live = total > 0
        counts = np.where(up, count[1:], count[:-1] + same)[source]
        starts = np.where(up, start[1:], np.where(score[:-1] > 0, start[:-1], j))[source]
        score[:-1], count[:-1], start[:-1] = np.where(live, total, 0), np.where(live, counts, 0), np.where(live, starts, 0)
        top = int(total.argmax())
        if total[top] > best[0]:
            best = (int(total[top]), int(counts[top]), int(starts[top]), int(j[top]) + 1)
    return best[1], best[2], best[3]


def _reaches(template: np.ndarray, text: np.ndarray, low: int, high: int, least: float) -> bool:
    """So many of the template's words meet an equal one within the band at all; no alignment there matches more."""
    if len(text) < least:
        return False
    met = np.zeros(len(template), dtype=bool)
    for d in range(max(low, 1 - len(template)), min(high, len(text) - 1) + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        met[a:b] |= template[a:b] == text[a + d : b + d]
    return int(met.sum()) >= least


def _clusters(hits: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Hits (word, diagonal) by word in runs on neighbouring diagonals, none longer than a template of so many words."""
    out: list[list[tuple[int, int]]] = []
    for p, diagonal in hits:
        if out and p - out[-1][0][0] <= size + BAND and abs(diagonal - out[-1][-1][1]) <= BAND:
            out[-1].append((p, diagonal))
        else:
            out.append([(p, diagonal)])
    return out


def _alignments(index: Index, i: int, words: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int]]:
    """Matches (matched words, first word, end) of one template: the densest clusters first, then again what lies before and after each span."""
    own = index.words[i]
    starts: list[int] = []
    ends: list[int] = []
    found = []
    waiting = sorted(_clusters(hits, len(own)), key=len)
    while waiting:
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for hit in waiting.pop():
            room = bisect_right(starts, hit[0])
            if not room or hit[0] >= ends[room - 1]:
                rooms[room].append(hit)
        if len(rooms) > 1:
            waiting.extend(rooms.values())
            continue
        for room, cluster in rooms.items():
            low, high = min(d for _, d in cluster) - BAND, max(d for _, d in cluster) + BAND
            begin = max(0, cluster[0][0] - len(own) - BAND, ends[room - 1] if room else 0)
            part = words[begin : min(cluster[-1][0] + len(own) + BAND, starts[room] if room < len(starts) else len(words))]
            if not _reaches(own, part, low - begin, high - begin, coverage * len(own)):
                continue
            n, first, end = align(own, part, low - begin, high - begin)
            if n >= coverage * len(own):
                if index.told(i, part[first : end + PAST]):
                    found.append((n, begin + first, begin + end))
                starts.insert(room, begin + first)
                ends.insert(room, begin + end)
                waiting.append(cluster)
    return found


def matches(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of each match in a whole text, by start; code points, end exclusive.

    A match that lies within a match of more words is left out, so a notice that opens a longer
    header is reported once.
    """
    data = folded(text)
    words = word_hashes(data)
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, diagonal, p in index.hits(words):
        groups[i].append((p, diagonal))
    found = []
    for i, hits in groups.items():
        found += [(n, i, first, end) for n, first, end in _alignments(index, i, words, sorted(hits), coverage)]
    found.sort(key=lambda m: (-m[0], len(index.words[m[1]]), m[1], m[2]))
    # Kept matches by the stretch of text that they start in; no match is longer than a stretch.
    stretch = max((m[3] - m[2] for m in found), default=1)
    held: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    kept: list[tuple[int, int, int, int]] = []
    for m in found:
        at = m[2] // stretch
        if not any(k[2] <= m[2] and m[3] <= k[3] for near in (at - 1, at) for k in held.get(near, ())):
            kept.append(m)
            held[at].append(m)
    if not kept:
        return []
    black = np.frombuffer(data, dtype=np.uint8) != 32
    for c in (9, 10, 11, 12, 13):
        black &= np.frombuffer(data, dtype=np.uint8) != c
    edge = np.diff(black.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.cumsum((np.frombuffer((text or "").encode(), dtype=np.uint8) & 0xC0) != 0x80)
    place = lambda at: int(points[at - 1]) if at else 0
    out = [(index.names[i], n / len(index.words[i]), place(int(starts[a])), place(int(ends[b - 1]))) for n, i, a, b in kept]
    return sorted(out, key=lambda m: (m[2], m[3], m[0]))


_MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_licenses(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """The input rows with `licenses`, an array of (license, coverage, start, end) by start.

    Null and empty texts have none; equal rows have equal matches; a column named licenses is
    replaced, others are kept; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf(_MATCHES)
    def scan(texts: pa.Array) -> pa.Array:
        index = _public() if templates is None else Index(templates)
        rows = [[dict(zip(("license", "coverage", "start", "end"), m, strict=True)) for m in matches(t, index, coverage)] for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, kind)

    return df.withColumn("licenses", scan(F.col(text_col)))


def op10(spark, sf_dir) -> DataFrame:
    """License notices of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: F.split_part(m["license"], F.lit("/"), F.lit(1))))), ",").alias("names"),
        F.array_max(F.transform("licenses", lambda m: m["coverage"])).alias("best_coverage"),
        F.array_join(F.transform("licenses", label), ",").alias("spans"),
    )
