"""Plans without Python against the kernel, on random texts."""

import json
import random

import pytest

from treedelta.adapters.data import parse_data
from treedelta.adapters.markup import parse_markup
from treedelta.kernel.tree import Tree
from treedelta.plans import hierarchy, matching
from treedelta.plans.hierarchy import ancestor_ids, ancestry, subtree_hashes, with_heights
from treedelta.plans.json_trees import json_trees
from treedelta.plans.markup_trees import markup_trees

TEXTS = "id long, t string"


def kernel_rows(root, names):
    columns = Tree(root).columns()
    return sorted(zip(*[columns[k] for k in names], strict=True), key=str)


def by_text(rows, names):
    found = {}
    for r in rows:
        found.setdefault(r["pair_id"], []).append(tuple(r[k] for k in names))
    return {k: sorted(v, key=str) for k, v in found.items()}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_json_trees_equal_the_kernel(spark):
    """Orders of keys, whole-number keys, escapes, numbers at all magnitudes, strings that look like objects."""
    rnd = random.Random(4)
    keys = ["a", "b", "c.d", "10", "2", "é", "{x", "k k", "4294967295", "007", "😀", "ﬀ"]
    scalars = [None, True, False, 0, -0.0, 1.0, 2.5, 1e21, 1e20, 1.5e-7, 123456789012345678, 0.000001, -3.25e300, "", "null", '{"q":1}', "[1]", 'é\n"x']

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.3:
            return {rnd.choice(keys): value(depth - 1) for _ in range(rnd.randint(0, 5))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rnd.randint(0, 4))]
        return rnd.choice([*scalars, rnd.random(), rnd.randint(-(10**12), 10**12)])

    whole = [{rnd.choice("abcdef"): value(4) for _ in range(rnd.randint(0, 6))} if rnd.random() < 0.5 else [value(4) for _ in range(rnd.randint(0, 6))] for _ in range(1000)]
    texts = [json.dumps(d, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2])) for d in whole] + [" \n[1] ", "[" * 150 + "]" * 150]
    without = ["[1,", "{a:1}", "7", '"x"', "", None, '{"a": 1, "a": 2}']
    df = json_trees(spark.createDataFrame(list(enumerate(texts + without)), TEXTS), "id", "t")
    names = ("node_id", "parent_id", "pos", "subtree_size", "height", "kind", "label", "value")
    found = by_text(df.collect(), names)
    assert set(found) == set(range(len(texts)))
    assert all(found[i] == kernel_rows(parse_data(t), names) for i, t in enumerate(texts))
    assert "Python" not in plan_of(df)


def test_json_trees_meet_in_no_shuffle(spark):
    """nodes know their ids when they are made, so only texts are dealt; more siblings than one block of sums."""
    texts = [json.dumps({"w": [{"i": i, "2": [i] * (i % 3)} for i in range(600)], "z": {}}), json.dumps(list(range(513)))]
    df = json_trees(spark.createDataFrame(list(enumerate(texts)), TEXTS), "id", "t")
    names = ("node_id", "parent_id", "pos", "subtree_size", "height", "kind", "label", "value")
    found = by_text(df.collect(), names)
    assert all(found[i] == kernel_rows(parse_data(t), names) for i, t in enumerate(texts))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Aggregate", "UnionLoop"))


def test_markup_trees_equal_the_kernel(spark, data):
    """Open and stray tags, void and self-closed ones, attributes, comments, white space; and all pages."""
    rnd = random.Random(4)
    parts = ["<p>", "</p>", '<div id="a" class="b">', '<div class="c" id>', "</div>", "<br>", '<IMG src="x">', "<b/>", '<i class="q"/>', " ", "\n  ", "text", "3 < 4", "<", "> x", "<!-- c <p> -->"]
    parts += ["<!DOCTYPE html>", "</p >", '<a href="u" id="z" id="y">', "</a>", "é\xa0", '<script>var t="</p>";</script>']
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(600)] + ["<p>x</p><!-- open <b>", "", "<p>" * 300]
    texts += [r[0] for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect()]
    df = markup_trees(spark.createDataFrame([*enumerate(texts), (-1, None)], TEXTS), "id", "t")
    names = ("node_id", "parent_id", "pos", "subtree_size", "kind", "label", "value")
    found = by_text(df.collect(), names)
    assert set(found) == set(range(len(texts)))
    assert all(found[i] == kernel_rows(parse_markup(t), names) for i, t in enumerate(texts))
    assert "Python" not in plan_of(df)


@pytest.mark.parametrize("make", [json_trees, markup_trees])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], TEXTS), "id", "t").count() == 0


def test_ancestors_and_heights_by_doubling(spark):
    """A chain of 70 below a bush, in two pairs, against walking up."""
    rnd = random.Random(7)
    rows, parents = [], {}
    for pair, n in ((1, 150), (2, 40)):
        for i in range(n):
            up = i + 1 if i < 70 and i < n - 1 else rnd.randint(i + 1, n - 1) if i < n - 1 else -1
            parents[pair, i] = up
            rows.append((pair, i, up, "k", f"n{i}"))
    nodes = spark.createDataFrame(rows, "pair_id long, node_id int, parent_id int, kind string, label string")
    want = set()
    for pair, i in parents:
        up, depth = parents[pair, i], 1
        while up >= 0:
            want.add((pair, i, up, depth))
            up, depth = parents[pair, up], depth + 1
    assert {(r["pair_id"], r["node_id"], r["ancestor"], r["depth"]) for r in ancestor_ids(nodes).collect()} == want
    heights = {(r["pair_id"], r["node_id"]): r["height"] for r in with_heights(nodes).collect()}
    assert heights == {k: 1 + max((d for p, _, a, d in want if (p, a) == k), default=0) for k in parents}
    assert len(plan_of(ancestry(nodes)).splitlines()) < 200


def test_hashes_of_subtrees_tell_them_apart(spark, data):
    """Equal subtrees, by the kernel's own comparison, have equal hashes, others don't; structures likewise."""
    texts = ['{"a": [1, {"b": 2}], "c": [1, {"b": 2}]}', '{"x": {"a": [1, {"b": 2}]}, "a": [1, {"b": 3}]}', '{"a": {"b": null}, "b": null}', "[[], [[]], [[], []]]"]
    nodes = json_trees(spark.createDataFrame(list(enumerate(texts)), TEXTS), "id", "t")
    found = {(r["pair_id"], r["node_id"]): (r["hash"], r["structure"]) for r in subtree_hashes(nodes).collect()}
    trees = [Tree(parse_data(t)) for t in texts]
    ids = [(k, i) for k, t in enumerate(trees) for i in range(t.n)]
    assert set(found) == set(ids)
    for p, i in ids:
        for q, j in ids:
            assert (found[p, i][0] == found[q, j][0]) == trees[p].same(i, trees[q], j)
            assert (found[p, i][1] == found[q, j][1]) == (trees[p].structure[i] == trees[q].structure[j])


def test_common_length():
    from treedelta.kernel.sequence import common_length, lcs_table

    rnd = random.Random(9)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        assert common_length(a, b, rnd.choice([1, 3, 7, 64])) == int(lcs_table(a, b)[-1, -1])
    assert common_length(["x"] * 70_000, ["x"] * 70_000) == 70_000 and common_length(["x"] * 70_000, ["y", *["x"] * 69_999, "z"]) == 69_999


def test_functions_of_sql_are_inlined(spark, data):
    """The same as the column functions on names of all kinds, without Python in their plans."""
    from treedelta.functions import routing as R
    from treedelta.functions.sql_language import register_sql_functions

    register_sql_functions(spark)
    names = [f"x/{a}{b}" for a in ("f", "LICENSE", ".env", "readme", "A.B") for b in ("", ".py", ".JSON", ".local", ".txt", ".png", ".license")] + [None, ""]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    rows.createOrReplaceTempView("td_names")
    df = spark.sql("SELECT path, classify(path) AS tier FROM td_names")
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in rows.select("path", R.tier(rows.path)).collect()}
    assert "Python" not in plan_of(df) and "Python" not in plan_of(spark.sql("SELECT jaccard_tokens(path, 'a') FROM td_names"))


def chains(spark, pairs, length):
    return spark.createDataFrame([(p, i, i + 1 if i + 1 < length else -1, i + 1, "x", None, None) for p in range(pairs) for i in range(length)], "pair_id long, node_id int, parent_id int, subtree_size int, kind string, label string, value string")


def test_ancestors_keep_one_row_a_node_and_are_never_broadcast(spark, monkeypatch):
    """Files of ids are tiny however many rows they hold, so their size must not send them to the driver."""
    seen, real = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, what: (seen.append(df), real(df, what))[1])
    found = ancestor_ids(chains(spark, 20, 9)).collect()
    assert sorted((r.pair_id, r.node_id, r.ancestor, r.depth) for r in found) == sorted((p, i, i + k, k) for p in range(20) for i in range(9) for k in range(1, 9 - i))
    assert all("Broadcast" not in plan_of(df) and df.count() == 180 for df in seen)
    assert "Broadcast" not in plan_of(subtree_hashes(real(chains(spark, 20, 9), "nodes")))


def test_matching_never_broadcasts_nodes_or_links(spark):
    old, new = (hierarchy.written(chains(spark, 3, 5).selectExpr("*", "0 AS pos", "CAST(1 AS long) AS hash"), "nodes") for _ in "ab")
    links = hierarchy.written(old.selectExpr("pair_id", "node_id AS old_id", "node_id AS new_id"), "links")
    for df in (matching._free(old, links, "old"), matching._by_place(old, new, ["hash"]), matching.edit_rows(old, new, links)):
        assert "Broadcast" not in plan_of(df)
