"""The conversation trie against brute force over explicit prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treedelta.llm import convtrie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + v[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += kids[k] == 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], tuple(sorted(ends[k]))) for k, m in members.items())


def nodes(df, **columns):
    found = convtrie.conversation_trie(df, **columns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    return sorted((*(-1 if x is None else x for x in r[:-1]), tuple(r[-1])) for r in found.collect())


@pytest.mark.parametrize(("seed", "n"), [(0, 120), (1, 1), (2, 40), (3, 3), (4, 90)])
def test_random_conversations(spark, seed, n):
    """Nulls in every column, repeated turns, exact copies, conversations that are prefixes of others, absent heads."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 3, 6])):
            rows.append((c if rnd.random() < 0.98 else None, t if rnd.random() < 0.95 else None, rnd.choice([None, "u", "a"]), rnd.choice([None, "", "x", "éy"])))
    assert nodes(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_many_copies_over_blocks_and_a_long_conversation(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 3000, 5) for t in range(3)] + [(1, t, "a", "same " * 50) for t in range(700)] + [(7, 0, "u", "x" * 200_000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert nodes(spark.createDataFrame(rows, TURNS).repartition(7)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table_and_clashing_names(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == []
    rows = [(1, 0, "u", "a", 9), (2, 0, "u", "b", 9)]
    named = spark.createDataFrame(rows, "`c.id` long, keys long, depth string, text string, td_block long")
    assert nodes(named, conv_col="c.id", turn_col="keys", role_col="depth") == brute([r[:4] for r in rows])


def test_query_on_the_table(spark, data):
    found = convtrie.op12(spark, data)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = [(*r[:-1], hashlib.sha256(",".join(map(str, r[-1])).encode()).hexdigest()) for r in brute(rows)]
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in found.fillna(-1, ["parent_conv_id"]).collect()) == sorted(expected)
    assert found.filter(F.col("depth") == 0).count() == 1
