"""Suffix-array dedup: the construction against sorting, the operator against a dictionary of all windows."""

import hashlib
import random

import pytest

from treedelta.llm import suffixes

ROWS = "doc_id long, text string, source string"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text)."""
    key = lambda i, at: (suffixes.LAST if i is None else i, at)
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - 99):
            w = data[at : at + 100]
            first[w] = min(first.get(w, key(i, at)), key(i, at))
    out = []
    for i, text in rows:
        data, end = (text or "").encode(), 0
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if first[data[at : at + 100]] < key(i, at):
                for b in range(max(at, end), at + 100):
                    gone[b] = 1
                end = at + 100
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def left(df, **sizes):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffixes.dedup_bytes(df, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=str)


def test_order_of_suffixes():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += [b"ab" * 500, b"a" * 700, bytes(rnd.randrange(256) for _ in range(3000)), b"abaababaabaababaababa" * 20]
    for t in texts:
        assert suffixes.suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


def corpus(seed):
    """Copies, near copies, passages at other offsets, periodic texts, repeats within a document, one line in many contexts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(14)[:70] + " the same line, in its own context"
    texts = [None, "", "short", passage, passage, "a" * 400, "xy" * 300, "a" * 130, prose(40) * 3, passage[:99], passage[:100], passage[-100:]]
    for _ in range(40):
        base = prose(80)
        texts += [base, base[:150] + "#" + base[150:], prose(5) + " " + passage + " " + prose(5), prose(20) + line + prose(20)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("hot", "block"), [(4096, 8 << 20), (3, 2000), (0, 3000)])
def test_windows_that_start_earlier(spark, hot, block):
    """In one block and in many; with hot anchors, and with all repeated anchors hot."""
    texts = corpus(hot)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[20]), (None, texts[21] or "z"), (5, texts[30]), (5, texts[31])]
    df = spark.createDataFrame([(*r, "s") for r in rows], ROWS).repartition(3)
    assert left(df, hot=hot, block_bytes=block) == brute(rows)


def test_texts_longer_than_a_slice(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcd ") for _ in range(9000)) * 120  # more than a slice of 2**20 bytes
    rows = [(2, long[3000:7000] + "x" + long[:2500]), (3, long[:8000][::-1]), (4, long)]
    assert left(spark.createDataFrame([(*r, "s") for r in rows], ROWS)) == brute(rows)


def test_columns_and_empty_tables(spark):
    assert suffixes.dedup_bytes(spark.createDataFrame([], ROWS)).count() == 0
    df = spark.createDataFrame([(1, "t" * 50, 1, "x", None)], "`doc.id` long, text string, n_bytes long, td_seq string, kept string")
    r = suffixes.dedup_bytes(df, id_col="doc.id").collect()[0]
    assert r["n_bytes"] == 50 and r["td_seq"] == "x" and bytes(r["kept"]) == b"t" * 50 and r["doc.id"] == 1


def test_query_on_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = suffixes.op11(spark, data)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows)]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(expected, key=str)
