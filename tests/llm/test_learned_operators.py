"""Quality, near-dedup, nearest neighbours and the pipeline."""

from collections import Counter

import numpy as np
import pytest

from treedelta.llm import forest, neardup, quality


# --- 2 ---


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown = labels.filter("pmod(hash(doc_id), 2) = 0")
    got = {r.doc_id: r for r in quality.classify(docs, shown).collect()}
    held = labels.join(shown.select("doc_id"), "doc_id", "left_anti").collect()
    right = [got[r.doc_id].is_good == (r.quality == 1) for r in held]
    clean = [got[r.doc_id].is_good for r in held if r.quality == 1]
    assert np.mean(right) > 0.97 and np.mean(clean) > 0.98 and len(got) == docs.count()


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", 1), (2, "", 1), (None, "x " * 9, 2)], "doc_id long, text string, quality long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.is_good for r in quality.classify(rows, none).collect()] == [True] * 4
    one = spark.createDataFrame([(1, 1), (2, None), (2, 1), (2, 0)], "doc_id long, quality int")
    assert [r.is_good for r in quality.classify(rows, one).collect()] == [True] * 4
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.classify(rows, both).collect()) == 4
    assert quality.classify(rows.limit(0), both).count() == 0


# --- 5 ---


def _near(spark, rows):
    return neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, root int"))


def test_near_duplicates_find_all_similar_pairs(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    texts = dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    rng = np.random.default_rng(4)
    base = " ".join(f"w{i}" for i in range(300))
    for k in range(40):  # near copies of one text, some beyond the threshold
        words = base.split()
        for at in rng.choice(300, size=k // 4, replace=False):
            words[at] = f"x{k}_{at}"
        texts[10_000 + k] = " ".join(words)
    for k in range(60):  # strays of a hub, some of them near each other
        words = base.split()[: 240 + k]
        words[(k // 6) * 20 : (k // 6) * 20 + 12] = [f"y{k // 6}_{j}" for j in range(12)]
        texts[20_000 + k] = " ".join(words)
    got = {r.doc_id: r for r in _near(spark, [(i, x, 1) for i, x in texts.items()]).collect()}
    bags = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, w in ((i, x.split()) for i, x in texts.items())}
    held = Counter(s for bag in bags.values() for s in bag)
    idf = {s: min(-np.log((1 + n) / (1 + len(texts))), -np.log(neardup.RAREST)) for s, n in held.items()}
    weigh = {i: {s: n * idf[s] for s, n in bag.items()} for i, bag in bags.items()}
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    met = together = 0
    for a in ids:
        for b in ids:
            if a < b and not bags[a].keys().isdisjoint(bags[b]):
                least = sum(min(w, weigh[b][s]) for s, w in weigh[a].items() if s in weigh[b])
                # The sketch's noise moves a similarity by less than 0.002 here.
                s = least / (sum(weigh[a].values()) + sum(weigh[b].values()) - least)
                if s >= 0.802:
                    met, together = met + 1, together + (got[a].class_id == got[b].class_id)
                if s >= 0.798:
                    parent[max(top(a), top(b))] = min(top(a), top(b))
    # No link joins what exact similarities keep apart, and hardly a pair is lost.
    assert not [(i, got[i].class_id) for i in ids if top(i) != top(got[i].class_id)]
    assert met > 200 and together >= 0.99 * met, (met, together)
    assert all(got[i].class_id <= i for i in ids) and sum(r.is_kept for r in got.values()) == len({r.class_id for r in got.values()})


def test_near_duplicates_compare_few_of_many_strays(spark, monkeypatch):
    # Texts that share a long passage and have one near copy each: none is near another's copies, yet all that they hold is common.
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(10_000 + i, f"f{i} g{i} h{i} k{i} l{i}", 1) for i in range(1500)]
    for k in range(150):
        own = [f"o{k}_{i}" for i in range(60 + k % 7)]
        rows.append((2 * k, f"{passage} {' '.join(own)}", 1))
        own[int(rng.integers(len(own)))] = "x"
        rows.append((2 * k + 1, f"{passage} {' '.join(own)}", 1))
    compared, near = [], neardup._near

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return near(pairs, *rest)

    monkeypatch.setattr(neardup, "_near", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in _near(spark, rows).collect()}
    assert all(got[2 * k][0] == got[2 * k + 1][0] == 2 * k for k in range(150))
    assert sum(compared[1:]) <= 300, compared
    # Hubs don't depend on the order in which rows come, nor do the links found.
    assert got == {r.doc_id: (r.class_id, r.n_links) for r in _near(spark, rows[::-1]).collect()}


def test_near_pairs_take_one_worker_of_a_task(spark):
    # Each Python step of a stage keeps a worker for each core of an executor, whose memory stays taken.
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    one = np.arange(10, dtype="<u4").tobytes()
    vectors = frame([(b"a", one), (b"b", one), (b"c", one[:8])], "node binary, vector binary")
    idf = spark.sparkContext.broadcast(np.ones((2, 1 << neardup.IDF_BITS), dtype=np.float32))
    near = neardup._near(frame([(b"a", b"b"), (b"a", b"c"), (b"b", b"c")], "a binary, b binary"), vectors, idf, 0.8)
    assert [(bytes(r.a), bytes(r.b), r.weighted) for r in near.collect()] == [(b"a", b"b", 1.0)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith(("ArrowEvalPython", "MapInArrow")) for line in plan.splitlines()) == 1, plan


def test_weighted_samples_agree_as_often_as_similarity(spark):
    rng = np.random.default_rng(2)
    keys = np.sort(rng.choice(2**32, 400, replace=False)).astype(np.uint32)
    agree = []
    for _ in range(30):
        a, b = np.sort(rng.choice(400, 300, replace=False)), np.sort(rng.choice(400, 300, replace=False))
        wa, wb = rng.random(300) + 0.5, rng.random(300) + 0.5
        s = neardup.weighted_jaccard((keys[a], wa), (keys[b], wb))
        agree.append((neardup.signature(keys[a], wa) == neardup.signature(keys[b], wb)).mean() - s)
    assert abs(np.mean(agree)) < 0.03


def test_near_duplicates_edges(spark):
    same = "one two three four five six"
    rows = [(3, same, 1), (2, same, 1), (2, same, 1), (None, same, 1), (7, None, 1), (8, "", 1), (9, " ", 1), (10, "a", 1), (11, "a b", 1), (12, "word " * 20000, 1), (13, "word " * 20001, 1)]
    got = {}
    for r in _near(spark, rows).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.class_id for r in got[3] + got[2] + got[None]] == [2] * 4 and [r.is_kept for r in got[2]] == [True, True] and not got[3][0].is_kept
    assert got[7][0].class_id == got[8][0].class_id == 7 and got[9][0].class_id == 9 and got[10][0].class_id == 10 and got[11][0].class_id == 11
    assert got[13][0].class_id == 12 and "root" in got[3][0].asDict()
    frame = spark.createDataFrame(rows, "doc_id long, text string, root int")
    assert sorted(str(r.doc_id) for r in neardup.keep_first(frame).collect()) == sorted(["2", "7", "9", "10", "11", "12"])
    assert _near(spark, []).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100


# --- 9 ---


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((3000, 32))
    vectors[500:700] = vectors[500]
    ids = np.arange(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    rows += [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, []), (None, vectors[0].tolist()), (0, vectors[0].tolist()), (5200, [1.0, 2.0]), (5250, [None] * 32)]
    got = {}
    for r in forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        best = np.lexsort((ids, -s))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(score - unit[i] @ unit[q]) < 1e-12 for _, i, score in own)
        hits += len({i for _, i, _ in own} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert [i for _, i, _ in sorted(got[550])] == [500, 501, 502, 503, 504]
    assert not {5000, 5050, 5100, 5150, 5200, 5250} & set(got)
    assert forest.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_forest_ranges_are_longest_prefixes():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 16))
    f = forest.Forest(v, trees=3)
    low, high = f.ranges(v[:20], 60)
    for q in range(20):
        assert q in f.candidates(low[q], high[q]) and (high[q] - low[q]).sum() >= 60


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert "ids" in out.columns and "text" not in out.columns and out.count() > 0
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


@pytest.mark.parametrize("name", ["op2_quality", "op5_near_duplicates", "op9_nearest_neighbours", "op10_license_scans"])
def test_queries_cover_their_tables(spark, data, name):
    from treedelta.llm.queries import QUERIES

    table = "embeddings" if "op9" in name else "documents"
    rows = spark.read.parquet(f"{data}/{table}.parquet")
    want = rows.filter("vec_id % 50 = 0").count() * 5 if "op9" in name else rows.count()
    assert QUERIES[name](spark, data).count() == want
