"""Cross-tokenizer alignment against both whole libraries and brute-force overlaps."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from treedelta.llm import alignment

TEXTS = "doc_id long, text string"


def spans(pieces):
    out, at = [], 0
    for x in pieces:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    token, values = {i: t for t, i in a_side.get_vocab().items()}, alignment._byte_values()
    own, linked, counts = [], [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            spelled_a = [bytes(values[c] for c in token[i]) for i in a]
            spelled_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                a, b, spelled_a, spelled_b = [], [], [], []
            at_a, at_b = spans(spelled_a), spans(spelled_b)
            ends_b = [q for _, q in at_b]
            for x, (p, q) in zip(a, at_a, strict=True):
                k = bisect.bisect_right(ends_b, p)
                while k < len(b) and at_b[k][0] < q:
                    links.append((x, b[k]))
                    k += 1
            i = j = 0
            for end in sorted({q for _, q in at_a} & {q for _, q in at_b}):
                k, m = i, j
                while i < len(a) and at_a[i][1] <= end:
                    i += 1
                while j < len(b) and at_b[j][1] <= end:
                    j += 1
                groups.append(",".join(map(str, a[k:i])) + "|" + ",".join(map(str, b[m:j])))
        own.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
        linked.append(links)
        counts.update(links)
    best, best_a = Counter(), Counter()
    for (x, y), n in counts.items():
        best[y], best_a[x] = max(best[y], n), max(best_a[x], n)
    sums = [(sum(counts[p] == best[p[1]] for p in x), sum(counts[p] == best[p[1]] == best_a[p[0]] for p in x), sum(counts[p] for p in x)) for x in linked]
    return [(*o[:4], *s, o[4]) for o, s in zip(own, sums, strict=True)]


def aligned(df, **sizes):
    found = alignment.align_documents(df, **sizes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_mutual", "count_sum", "groups")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("block", [60, 1 << 24])
def test_texts_of_all_kinds(spark, block):
    """Special tokens, bytes, marks that don't map back, other white space, repeated rows and nulls; in many blocks and in one."""
    rnd = random.Random(1)
    parts = ["a", "b", "the", "'s", " ", "  ", "\n", "\t", "\xa0", "é", "漢字", "😀", "<s>", "<|endoftext|>", "<unk>", "\x00", "\x1c", "　", "▁", "123", "!!", "...", "\r\n", "ing", " don't", "​", "é", "ﬁ", "\x85"]
    texts = [None, "", " ", "\n", "  \n "] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["long " * 50_000] * 2
    expected = sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
    assert aligned(spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(3), block_chars=block) == expected


def test_columns_that_clash_and_large_ids(spark):
    rows = [(2**62 + 1, "a b", 1.5, "x"), (None, "c", None, None)]
    df = spark.createDataFrame(rows, "`doc.id` long, text string, n_a double, td_seq string")
    found = {r["doc.id"]: r for r in alignment.align_documents(df).collect()}
    assert found[2**62 + 1]["td_seq"] == "x" and found[2**62 + 1]["n_a"] == 2 and found[None]["td_seq"] is None
    assert alignment.align_documents(spark.createDataFrame([], TEXTS)).count() == 0


def test_merge_of_ends():
    i, j, cut = alignment.merge(np.array([2, 5, 6]), np.array([1, 2, 3, 6]))
    assert list(zip(i, j, strict=True)) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3)] and cut.tolist() == [False, True, False, False, True]


def test_query_on_the_table(spark, data):
    texts = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op13(spark, data)
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    by_id = {r["doc_id"]: r for r in found.collect()}
    for (i, _), x in zip(texts, brute([t for _, t in texts]), strict=True):
        assert tuple(by_id[i])[1:5] == x[:4] and by_id[i]["groups_sha256"] == (hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")
