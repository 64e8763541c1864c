"""Matching and edits by joins against the kernel, on edited pages, and on many equal records."""

import re

from pyspark.sql import functions as F

from treedelta.adapters.markup import parse_markup
from treedelta.kernel.script import diff_trees
from treedelta.plans.markup_trees import markup_trees
from treedelta.plans.matching import edit_rows, match_nodes, match_topdown
from treedelta.session import written


def edited(html):
    """The page with a heading changed, moved, and with paragraphs swapped, gone and added."""
    h = re.search("<h1>[^<]*</h1>", html)
    yield html, re.sub("<h1>[^<]*</h1>", "<h1>edited</h1>", html)
    yield html, html[: h.start()] + html[h.end() :].replace("</body>", h[0] + "</body>", 1)
    found = list(re.finditer(r"<p>[^<]*</p>", html))
    if len(found) > 3:
        a, b = found[1], found[2]
        yield html, html[: a.start()] + b[0] + html[a.end() : b.start()] + a[0] + html[b.end() :]
        yield html, html[: a.start()] + html[a.end() :]
        yield html[: a.start()] + html[a.end() :], html
    yield html, html
    yield html, "<ul><li>1</li></ul>"


def test_edits_equal_the_kernels(spark, data):
    pages = [r[0] for r in spark.read.parquet(f"{data}/pages.parquet").select("html").orderBy(F.length("html")).limit(12).collect()]
    pairs = [p for html in pages for p in edited(html)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "id long, a string, b string")
    old, new = written(markup_trees(df, "id", "a"), "old"), written(markup_trees(df, "id", "b"), "new")
    found = {}
    for r in edit_rows(*match_nodes(old, new)).collect():
        found.setdefault(r["pair_id"], []).append((r["action"], r["node_id"], r["kind"], r["label"], r["detail"], r["from_value"], r["to_value"], r["from_position"], r["to_position"]))
    for k, (a, b) in enumerate(pairs):
        want = []
        for x in diff_trees(parse_markup(a), parse_markup(b)).actions:
            detail = x.detail or (None, None, None)
            want.append((x.action, x.id, x.node.kind, x.node.label, *detail, x.from_position, x.to_position if x.action == "Move" else x.position))
        assert sorted(found.get(k, []), key=str) == sorted(want, key=str), k


def test_many_equal_records_are_linked_in_order(spark):
    """20,000 equal records below either root, one of them changed: as many links, not their square."""
    n = 20_000
    columns = "pair_id long, node_id int, parent_id int, pos int, subtree_size int, kind string, label string, value string"

    def tree(changed):
        i = F.col("id")
        leaf = spark.range(n).select(F.lit(1).alias("pair_id"), (2 * i).alias("node_id"), (2 * i + 1).alias("parent_id"), F.lit(0).alias("pos"), F.lit(1).alias("subtree_size"), F.lit("b").alias("kind"), F.lit(None).alias("label"), F.when(i == changed, "other").otherwise("same").alias("value"))
        row = spark.range(n).select(F.lit(1), 2 * i + 1, F.lit(2 * n), i, F.lit(2), F.lit("tr"), F.lit(None), F.lit(None))
        root = spark.range(1).select(F.lit(1), F.lit(2 * n), F.lit(-1), F.lit(0), F.lit(2 * n + 1), F.lit("table"), F.lit(None), F.lit(None))
        return leaf.union(row).union(root).to(spark.createDataFrame([], columns).schema)

    _, _, links = match_topdown(tree(-1), tree(700))
    assert links.agg(F.count("*"), F.count_distinct("old_id"), F.count_distinct("new_id")).collect()[0] == (2 * (n - 1),) * 3


def test_empty_sides(spark):
    none = markup_trees(spark.createDataFrame([], "id long, t string"), "id", "t")
    old, new, links = match_nodes(none, none)
    assert links.count() == 0 and edit_rows(old, new, links).count() == 0


def test_equal_structures_and_far_candidates_keep_their_partners(spark, tmp_path):
    """containers of one structure are linked however many there are, and a best container is found behind more than four others."""
    import duckdb

    from treedelta.kernel.matching import MatchOptions, match_trees
    from treedelta.kernel.tree import Tree
    from treedelta.queries import ORACLE_SQL, QUERIES

    boxes = lambda *names: "".join(f"<div><h1>{n}</h1></div>" for n in names)
    rows = [(k, f"<html><body><p>stays</p>{b}</body></html>") for k, b in enumerate([boxes("a", "b"), boxes("a", "b", "c", "d", "e"), boxes("a", "edited", "b"), f"<ul>{boxes('a')}</ul><ol>{boxes('b', 'c')}</ol>"])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["page_edits"]).fetchall())
    for name in ("page_edits", "markup_diff"):
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want and len(want) == 12, name

    x = [f'<i id="x{k}"></i>' for k in range(10)]
    inner = "<div>" + "".join(x[:6]) + "</div>"
    for k in range(6, 10):
        inner = "<div>" + inner + x[k] + "".join(f'<b id="n{k}_{j}"></b>' for j in range(60)) + "</div>"
    a, b = "<p><div>" + "".join(x) + "</div></p>", "<p>" + inner + "</p>"
    old, new = Tree(parse_markup(a)), Tree(parse_markup(b))
    box, first = (next(k for k in range(t.n) if t.nodes[k].kind == "div") for t in (old, new))
    assert match_trees(old, new, MatchOptions()).new_of[box] == first
    df = spark.createDataFrame([(1, a, b)], "id long, a string, b string")
    _, _, links = match_nodes(written(markup_trees(df, "id", "a"), "old"), written(markup_trees(df, "id", "b"), "new"))
    assert (box, first) in {(r.old_id, r.new_id) for r in links.collect()}
