"""DataFrame operators."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from treedelta.functions import routing as R
from treedelta.functions import text as X
from treedelta.operators.correlate import correlate
from treedelta.operators.diff import diff_pairs, diff_snapshots, edit_actions
from treedelta.operators.narrate import narrate
from treedelta.operators.render import report
from treedelta.operators.sequences import parse, reordered, trimmed
from treedelta.operators.summarize import summarize
from treedelta.plans.hierarchy import ancestry, subtree_hashes
from treedelta.sources.files import diff_directories, read_file_pair
from treedelta.sources.gitrange import diff_commit_range, diff_working_tree, is_git_repo, parse_range, resolve_ref, write_git_attributes

PAIR = "pair_id long, old_path string, new_path string, old_source string, new_source string"
FILES = "path string, content string"


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAIR)


@pytest.mark.parametrize(
    ("path", "tier"),
    [("a.json", 4), ("a.ts", 5), ("a.HTML", 3), ("a.png", 0), ("a.txt", 2), ("a.unknown", 1), (".env", 4), ("x/.env.local", 4), ("a.csv", 1), ("a.graphql", 1), ("Dockerfile", 1), ("LICENSE", 2), ("a.css", 5), ("a.md", 1)],
)
def test_tiers(spark, path, tier):
    assert spark.createDataFrame([(path,)], "p string").select(R.tier(F.col("p"))).first()[0] == tier


def test_routes(spark):
    rows = pairs(spark, ("a.json", "a.json", "", "x"), ("a.json", "a.json", "x", None), ("a.json", "a.json", "x", "x"), ("a.dat", "a.dat", "a\0b", "c"), ("a.png", "a.png", "a", "b"), ("a.py", "a.py", "a", "b"), ("a", "a", "", ""), ("a.x", "a.x", "a", "b"))
    found = [r[0] for r in rows.orderBy("pair_id").select(R.route(F.col("old_path"), F.col("old_source"), F.col("new_source"))).collect()]
    assert found == ["insert", "delete", "same", "binary", "binary", "code", "same", "raw"]


def test_whole_files_binary_and_same(spark):
    rows = {r.pair_id: r for r in diff_pairs(pairs(spark, ("a.txt", "b.txt", "", "new"), ("a.txt", "a.txt", "old", ""), ("a", "a", "", ""), ("d.dat", "d.dat", "abc\0def", "abc\0xyz!"), (None, "n.md", None, "x"))).collect()}
    assert (rows[0].file_path, rows[0].actions[0].action, rows[0].actions[0].node.value, rows[0].node_count, rows[0].tier) == ("b.txt", "Insert", "new", 1, 2)
    assert rows[1].actions[0].action == "Delete" and rows[2].actions == [] and rows[2].node_count == 0
    assert rows[3].tier == 0 and rows[3].actions[0].detail["from"] == "7 bytes" and rows[3].actions[0].detail["to"] == "8 bytes"
    assert rows[4].file_path == "n.md" and rows[4].actions[0].action == "Insert"


def test_empty_table(spark):
    empty = spark.createDataFrame([], PAIR)
    changes = narrate(edit_actions(diff_pairs(empty)))
    assert changes.count() == 0 and list(report(changes)) == ["no logical changes", "\nno logical changes"]
    assert correlate(edit_actions(diff_pairs(empty))).count() == 0


def test_narration_and_redundant_updates(spark):
    rows = pairs(spark, ("a.py", "a.py", "def foo():\n    return foo\n", "def bar():\n    return bar\n"), ("c.json", "c.json", '{"host": "a", "p": 1}', '{"host": "b", "p": 1, "q": 2}'))
    changes = narrate(edit_actions(diff_pairs(rows))).orderBy("pair_id", "seq").collect()
    assert [r.description for r in changes] == ["renamed function `foo` to `bar`", "changed value of leaf `host` from `a` to `b` in object `root`", "added leaf `q` in object `root`"]
    assert summarize(narrate(edit_actions(diff_pairs(rows)))).first().summary == "1 addition, 2 modifications"


def test_rendering(spark):
    rows = pairs(spark, ("a.json", "a.json", '{"x": 1}', '{"x": 2}'), ("b.md", "b.md", "one\ntwo", "one\nthree\nfour"))
    diffs = edit_actions(diff_pairs(rows))
    changes = narrate(diffs)
    text = "\n".join(report(changes, None, "llm"))
    assert text.splitlines() == ["treedelta/1 2 files 3 changes 1 named", "# a.json", "~ leaf x < object root 1 -> 2", "# b.md", "* 2 lines"]
    assert "\n".join(report(changes, None, "terminal")).startswith("a.json\n  ~ changed value of leaf `x` from `1` to `2`")
    assert "## b.md" in "\n".join(report(changes, None, "markdown"))
    parsed = json.loads("\n".join(report(changes, None, "json")))
    assert len(parsed["perFile"]) == 3 and parsed["crossFileMoves"] == []
    assert [json.loads(x)["file"] for x in report(changes, None, "ndjson")] == ["a.json", "b.md"]


def test_correlation(spark):
    text = "def check(value):\n    if value > 10:\n        return value\n    return None\n"
    other = text.replace("10", "12")
    rows = pairs(
        spark,
        ("old.txt", "old.txt", "same words here", ""), ("new.txt", "new.txt", "", "same words here"),
        ("a.py", "a.py", "x = 1\n" + text, "x = 1\n"), ("b.py", "b.py", "y = 1\n", "y = 1\n" + text),
        ("c.md", "c.md", "alpha beta gamma delta one two three", ""), ("d.md", "d.md", "", "alpha beta gamma delta one two four"),
    )
    moves = {(m.from_file, m.to_file): m for m in correlate(edit_actions(diff_pairs(rows))).collect()}
    assert set(moves) == {("old.txt", "new.txt"), ("a.py", "b.py"), ("c.md", "d.md")}
    assert not moves["old.txt", "new.txt"].modified and moves["a.py", "b.py"].name == "check" and not moves["a.py", "b.py"].modified
    assert moves["c.md", "d.md"].modified and 0.6 <= moves["c.md", "d.md"].similarity < 1
    assert correlate(edit_actions(diff_pairs(rows)), 0.95).count() == 2
    again = pairs(spark, ("p.md", "p.md", "same text", ""), ("q.md", "q.md", "", "same text"), ("r.md", "r.md", "", "same text"))
    assert correlate(edit_actions(diff_pairs(again))).count() == 1
    assert other != text


def test_correlation_agrees_with_brute_force(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.sample(words, rng.randint(3, 9))) for _ in range(60)]
    rows = pairs(spark, *[(f"d{i:02}.md", f"d{i:02}.md", t, "") for i, t in enumerate(texts[:30])], *[(f"i{i:02}.md", f"i{i:02}.md", "", t) for i, t in enumerate(texts[30:])])
    taken, want = set(), set()
    for i, t in enumerate(texts[:30]):
        a = set(t.split())
        scored = [(len(a & set(u.split())) / len(a | set(u.split())), -j) for j, u in enumerate(texts[30:]) if j not in taken]
        exact = [j for j, u in enumerate(texts[30:]) if u == t and j not in taken]
        best = (1.0, -exact[0]) if exact else max(scored)
        if best[0] >= 0.6:
            taken.add(-best[1])
            want.add((f"d{i:02}.md", f"i{-best[1]:02}.md"))
    assert {(m.from_file, m.to_file) for m in correlate(edit_actions(diff_pairs(rows))).collect()} == want and want


def test_many_equal_files_make_as_many_moves(spark):
    """Equal files meet by their place: never all of one side with all of the other, whatever the order of arrival."""
    n, text = 50_000, "same words here"
    rows = spark.range(2 * n).select(F.col("id").alias("pair_id"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".txt")).alias("old_path"), F.when(F.col("id") % 2 == 0, text).otherwise("").alias("old_source"), F.when(F.col("id") % 2 == 1, text).otherwise("").alias("new_source"))
    moves = correlate(edit_actions(diff_pairs(rows.withColumn("new_path", F.col("old_path")).repartition(5))))
    number = lambda c: F.substring(c, 2, 8).cast("long")
    assert moves.agg(F.count("*"), F.count_if(number("from_file") + 1 == number("to_file")), F.count_if("modified")).collect()[0] == (n, n, 0)


def test_ranks_are_those_of_one_sort(spark):
    import random

    from treedelta.plans.ranks import ranked

    rng = random.Random(6)
    rows = [(rng.choice("aaaab"), rng.random(), i) for i in range(3000)]
    found = {r["i"]: r["rank"] for r in ranked(spark.createDataFrame(rows, "k string, x double, i long"), ["k"], ["x", "i"]).collect()}
    for key in "ab":
        assert [found[i] for _, i in sorted((x, i) for k, x, i in rows if k == key)] == list(range(1, sum(k == key for k, _, _ in rows) + 1))


def test_settled_is_what_choosing_in_turn_gives(spark):
    """Rounds of asking against one pass in order, with offers of several places and equal scores."""
    import random

    from treedelta.operators.correlate import settled

    rng = random.Random(8)
    for room in (1, 3):
        rooms = {o: rng.randint(1, room) for o in range(25)}
        wishes = {(a, o): rng.choice([0.6, 0.7, 0.8, 0.9]) for a in range(60) for o in rng.sample(range(25), rng.randint(0, 6))}
        left, want = dict(rooms), set()
        for a in range(60):
            able = [(-s, o) for (x, o), s in wishes.items() if x == a and left[o]]
            if able:
                want.add((a, min(able)[1]))
                left[min(able)[1]] -= 1
        rows = spark.createDataFrame([(a, o, s, o, rooms[o]) for (a, o), s in wishes.items()], "asks long, offer long, score double, first long, room long")
        assert {(r["asks"], r["offer"]) for r in settled(rows).collect()} == want


def test_files_on_both_sides_do_not_meet_themselves(spark):
    part = "def check(value):\n    return value\n"
    rows = pairs(spark, ("a.py", "a.py", "x = 1\n" + part, "x = 1\ny = 2\nz = 3\n"), ("b.py", "b.py", "y = 1\n", "y = 1\n" + part), ("c.py", "c.py", "y = 1\n" + part, "y = 1\n"))
    moves = [(m.from_file, m.to_file) for m in correlate(edit_actions(diff_pairs(rows))).filter("name = 'check'").collect()]
    assert moves == [("a.py", "b.py")]


def test_two_snapshot_corpus(spark):
    old = {f"config/c{i}.json": json.dumps({"name": f"c{i}", "port": 1000 + i}) for i in range(30)}
    old |= {f"docs/d{i}.md": f"# title {i}\nline one {i}\nline two" for i in range(20)} | {f"notes/n{i}.txt": f"first words {i} and more" for i in range(10)}
    old |= {f"py/f{i}.py": f"def fn{i}(a):\n    return a * {i} + offset{i}\n" for i in range(80)}
    new = dict(old)
    for i in range(10):
        new[f"config/c{i}.json"] = json.dumps({"name": f"c{i}", "port": 2000 + i})
    for i in range(5):
        new[f"docs/d{i}.md"] = old[f"docs/d{i}.md"].replace("one", "uno")
        new[f"notes/n{i}.txt"] = old[f"notes/n{i}.txt"].replace("more", "less")
        new[f"py/f{i}.py"] = old[f"py/f{i}.py"].replace(f"fn{i}(", f"gn{i}(")
    new["py/f0.py"] += old["py/f79.py"]
    del new["py/f79.py"], new["docs/d19.md"]
    new["docs/new.md"] = "entirely different content"
    frame = lambda d: spark.createDataFrame(list(d.items()), FILES)
    actions = edit_actions(diff_snapshots(frame(old), frame(new)))
    assert actions.select("file_path").distinct().count() == 28
    kinds = {(r.file_path, r.action) for r in actions.collect()}
    assert ("config/c3.json", "Update") in kinds and ("docs/new.md", "Insert") in kinds and ("py/f79.py", "Delete") in kinds and ("py/f0.py", "Insert") in kinds


def test_trees_as_rows(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, 2], "b": null}'), (2, None), (3, "x")], "pair_id long, text string")
    nodes = parse(rows, "text", R.DATA)
    assert {(r.pair_id, r.n) for r in nodes.groupBy("pair_id").agg(F.count("*").alias("n")).collect()} == {(1, 5), (2, 1), (3, 1)}
    top = nodes.filter("parent_id = -1 and pair_id = 1").first()
    assert (top.node_id, top.subtree_size, top.height, top.kind) == (4, 5, 3, "object")
    chain = {(r.node_id, r.depth): r.kind for r in ancestry(nodes.filter("pair_id = 1")).collect()}
    assert chain[0, 1] == "array" and chain[0, 2] == "object" and (4, 1) not in chain
    twice = spark.createDataFrame([(1, '{"a": [1, 2]}'), (2, '{"a": [1, 2]}'), (3, '{"a": [2, 1]}')], "pair_id long, text string")
    hashes = {r.pair_id: r.hash for r in subtree_hashes(parse(twice, "text", R.DATA), 3).join(parse(twice, "text", R.DATA).filter("parent_id = -1").select("pair_id", "node_id"), ["pair_id", "node_id"]).collect()}
    assert hashes[1] == hashes[2] != hashes[3]


def test_trimmed_head_and_tail(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 4]), ([1, 1], [1]), ([], [1]), ([5], [5])], "a array<int>, b array<int>")
    head, tail = trimmed(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(head, tail).collect()] == [(1, 1), (1, 0), (0, 0), (1, 0)]


def test_reordered(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 0)], "pair_id long, parent_id int, old_pos int, new_pos int")
    assert [r.old_pos for r in reordered(rows).collect()] == [2]


def test_scalar_functions(spark):
    row = spark.createDataFrame([("CallExpression_kind", "  a \n b  ", "x" * 50)], "k string, v string, w string").select(X.humanize_kind(F.col("k")), X.preview(F.col("v"), 40), X.preview(F.col("w"), 40), X.llm_value(F.lit(" ")), X.llm_value(F.lit(None).cast("string")), X.jaccard(X.name_tokens(F.lit("A b c")), X.name_tokens(F.lit("a B d")))).first()
    assert tuple(row) == ("call expression kind", "a b", "x" * 39 + "…", '""', "none", 0.5)


def test_directories_and_git(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d, text in ((a, "one\n"), (b, "two\n")):
        (d / "sub").mkdir(parents=True)
        (d / "node_modules").mkdir()
        (d / "sub" / "f.txt").write_text(text)
        (d / "node_modules" / "x.txt").write_text(text)
    (b / "new.md").write_text("x")
    found = {(r.old_path, r.old_source, r.new_source) for r in diff_directories(spark, str(a), str(b)).collect()}
    assert found == {("sub/f.txt", "one\n", "two\n"), ("new.md", "", "x")}
    assert read_file_pair(spark, str(a / "sub/f.txt"), str(b / "sub/f.txt")).first().new_source == "two\n"
    with pytest.raises(FileNotFoundError, match="missing"):
        read_file_pair(spark, str(a / "missing"), str(b / "new.md"))

    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *args: subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=a", "-C", str(repo), *args], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.txt").write_text("first\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (repo / "a.txt").write_text("second\n")
    (repo / "b c.txt").write_text("added\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert {(r.old_path, r.old_source, r.new_source) for r in diff_commit_range(spark, str(repo), "HEAD~1..HEAD").collect()} == {("a.txt", "first\n", "second\n"), ("b c.txt", "", "added\n")}
    (repo / "a.txt").write_text("third\n")
    (repo / "c.txt").write_text("untracked\n")
    assert {(r.old_path, r.old_source, r.new_source) for r in diff_working_tree(spark, str(repo)).collect()} == {("a.txt", "second\n", "third\n"), ("c.txt", "", "untracked\n")}
    assert is_git_repo(str(repo)) and resolve_ref(str(repo), "HEAD") and resolve_ref(str(repo), "nothing") is None
    with pytest.raises(ValueError, match="not a range"):
        parse_range("a..b..c")
    (repo / ".gitattributes").write_text("*.txt text\n")
    assert write_git_attributes(["txt", "md"], str(repo)) == write_git_attributes(["txt", "md"], str(repo)) == "*.txt text diff=treedelta\n*.md diff=treedelta\n"


def test_stream_equals_batch(spark, data):
    from treedelta.queries import QUERIES

    batch = {(r.user_id, r.event_id, r.from_value, r.to_value) for r in QUERIES["json_value_changes"](spark, data).collect()}
    stream = {(r.user_id, r.event_id, r.from_value, r.to_value) for r in QUERIES["stream_changes"](spark, data).collect()}
    assert batch == stream and batch


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_functions(spark):
    from treedelta.sql import register

    register(spark)
    spark.createDataFrame([(1, "a\nb", "a\nc", '{"x": 1}', '{"x": 2}')], "id int, o string, n string, j string, k string").createOrReplaceTempView("td_pairs")
    assert [tuple(r) for r in spark.sql("SELECT d.* FROM td_pairs, LATERAL diff_lines(o, n) d").collect()] == [(0, "Update", "b", "c")]
    assert [r.label for r in spark.sql("SELECT d.label FROM td_pairs, LATERAL diff_json(j, k) d").collect()] == ["x"]
    assert spark.sql("SELECT count(*) AS n FROM td_pairs, LATERAL parse_tree(j, 'data') d").first().n == 2
    assert spark.sql("SELECT jaccard_tokens('a b', 'b c') AS s").first().s == pytest.approx(1 / 3)


def test_command_line(spark, tmp_path, capsys):
    from treedelta.cli import load_config, main

    (tmp_path / "treedelta.toml").write_text('format = "llm"')
    assert load_config(str(tmp_path)) == {"format": "llm"}
    for d, v in (("a", 1), ("b", 2)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "c.json").write_text(json.dumps({"port": v}))
    assert main([str(tmp_path / "a"), str(tmp_path / "b"), "--llm"]) == 0
    assert "~ leaf port < object root 1 -> 2" in capsys.readouterr().out
    assert main(["languages"]) == 0 and main([str(tmp_path / "a"), str(tmp_path / "a" / "c.json")]) == 1


def test_parse_deals_small_texts_over_tasks(spark):
    """A table of small texts in one file was one task's work."""
    from treedelta.functions import routing
    from treedelta.operators.sequences import parse

    one = spark.createDataFrame([(i, f'{{"k": {i}}}') for i in range(500)] + [(500, "[1,"), (501, None)], "pair_id long, t string").coalesce(1)
    found = parse(one, "t", routing.DATA)
    assert found.rdd.getNumPartitions() > 1
    assert sorted((r.pair_id, r.value) for r in found.filter("kind = 'leaf' AND label = 'k'").collect()) == [(i, str(i)) for i in range(500)]


def test_preceding_reaches_over_salts(spark):
    """One key with all rows is many groups; a null key and null values count as any other."""
    from treedelta.plans.ranks import preceding

    rows = [(s, i, None if i % 7 == 0 else f"{s}{i}") for s in ("a", None) for i in range(0, 90, 3)]
    df = preceding(spark.createDataFrame(rows, "s string, i long, t string").repartition(3), ["s"], ["i"], "t", "was")
    want = [(s, i, t, None if i == 0 else (None if (i - 3) % 7 == 0 else f"{s}{i - 3}")) for s, i, t in rows]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_whole_files_need_no_python(spark, data):
    from treedelta.queries import snapshot_added_removed

    df = snapshot_added_removed(spark, data)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert {r.action for r in df.select("action").distinct().collect()} == {"Insert", "Delete"}


def test_similar_pairs_are_ruled_out_before_they_are_rows(spark):
    """texts of one stock of words share many tokens, yet only similar ones become pairs; none of those is lost."""
    import random

    from treedelta.functions.text import jaccard, name_tokens
    from treedelta.operators import correlate as C

    rnd = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    base = [rnd.sample(words, rnd.randint(1, 60)) for _ in range(60)]
    rows = [(side, 1, 1000 * (side == "i") + k, " ".join(w if side == "d" or rnd.random() < 0.85 else rnd.choice(words) for w in b)) for side in "di" for k, b in enumerate(base)]
    texts = spark.createDataFrame(rows, "side string, structure long, text_id long, text string").withColumn("tokens", name_tokens(F.col("text")))
    marked = texts.withColumn("marks", C._marks(F.col("tokens"))).drop("text")
    found = {(r.d_text, r.i_text): r.score for r in C._similar(marked, 0.6).collect()}
    a, b = (texts.filter(F.col("side") == s).select(F.col("text_id").alias(s), F.col("tokens").alias(f"{s}_tokens")) for s in "di")
    want = {(r.d, r.i): r.score for r in a.crossJoin(b).withColumn("score", jaccard(F.col("d_tokens"), F.col("i_tokens"))).filter("score >= 0.6").collect()}
    assert found == want and len(want) > 20


def test_redundant_updates_go_without_a_shuffle(spark):
    """the same actions stay as by a window over all actions, a pair's row is not dealt, and Arrow batches are small."""
    from treedelta.operators.narrate import distinct_actions, drop_redundant_updates

    texts = [(k, f"f{k}.{e}", "\n".join(f"a{j % 3} = {j % 4}" for j in range(12)), "\n".join(f"a{j % 3} = {j % 4 + (j % 2)}" for j in range(13))) for k, e in enumerate(("txt", "md", "py", "yaml", "html"))]
    diffs = diff_pairs(spark.createDataFrame([(k, p, p, a, b) for k, p, a, b in [*texts, (9, "n.md", "", "x"), (10, "o.md", "x", ""), (11, "s.md", "x", "x")]], "pair_id long, old_path string, new_path string, old_source string, new_source string"))
    found = distinct_actions(diffs)
    want = drop_redundant_updates(edit_actions(diffs)).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() < edit_actions(diffs).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 16


def test_equal_pairs_of_texts_are_compared_once(spark, tmp_path):
    """many events with few texts; the kernel gets each two texts that meet once."""
    from treedelta.queries import QUERIES

    rows = [(i, i // 40, i % 7, f'{{"k": {i * i % 3}}}' if i % 11 else None) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["json_value_changes"](spark, str(tmp_path))
    last, want = {}, []
    for i, _, user, text in rows:
        if text and last.get(user) and last[user] != text:
            want.append((user, i, "k", last[user][6:-1], text[6:-1]))
        last[user] = text
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    kernel = plan[plan.index("ArrowEvalPython") :]
    assert "Aggregate" in kernel


def test_common_items_are_counted_where_they_are_made(spark, monkeypatch):
    """containers and items of any size against brute force; pairs come after the last shuffle, and nothing is broadcast."""
    import random
    from collections import Counter

    from treedelta.operators import rows

    monkeypatch.setattr(rows, "LIST", 5)
    monkeypatch.setattr(rows, "PART", 20)
    rnd = random.Random(10)
    sides = []
    for _ in range(2):
        found = {(c, rnd.randrange(60)) for c in range(30) for _ in range(rnd.randint(1, 8))}
        sides.append([*(found | {(3, i) for i in range(60)} | {(c, 7) for c in range(30)}), (4, None), (50, None), (51, 1000 + len(sides))])
    df = rows.shared_descendants(*[spark.createDataFrame(side, "container long, item long") for side in sides])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Exchange")].count("Generate explode") == 2 and "Broadcast" not in plan
    few = rows.shared_descendants(*[spark.createDataFrame([(c, i) for c in range(3) for i in range(k, 300)], "container long, item long") for k in range(2)])
    assert {tuple(r)[:3] for r in few.collect()} == {(c, d, 299) for c in range(3) for d in range(3)} and "passthrough" not in few._jdf.queryExecution().executedPlan().toString()
    n_old, n_new = (Counter(c for c, _ in side) for side in sides)
    holders = {}
    for c, i in sides[1]:
        holders.setdefault(i, []).append(c)
    common = Counter((c, d) for c, i in sides[0] if i is not None for d in holders.get(i, []))
    want = {(c, d, k, n_old[c], n_new[d], 2 * k / (n_old[c] + n_new[d])) for (c, d), k in common.items()}
    got = df.select("old_container", "new_container", "common", "n_old", "n_new", "dice").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300
    assert df.filter("old_container = 3").selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_updates_of_events_are_told_apart_as_by_sql(spark, data):
    """the query is there, and gives the rows of its SQL."""
    import duckdb

    from treedelta.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    want = con.execute(ORACLE_SQL["dedup_updates"]).fetchall()
    found = [tuple(r) for r in QUERIES["dedup_updates"](spark, data).collect()]
    assert sorted(found) == sorted(want) and len(want) > 100


def test_similarity_takes_each_text_apart_once(spark):
    """two splits in the plan, whatever uses their tokens, and the same tokens as by the class of characters spelled out."""
    from treedelta.functions.sql_language import register_sql_functions

    register_sql_functions(spark)
    rows = [("aé b_1 B_1", "A ß b_1 K"), (None, "x"), ("", None), ("x y", "X-y"), ("İk 1٣2", "i k 1 2"), ("--", "__ 0")]
    df = spark.createDataFrame(rows, "a string, b string")
    df.createOrReplaceTempView("td_similar")
    found = spark.sql("SELECT a, b, jaccard_tokens(a, b) AS s FROM td_similar")
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9_]+"), lambda t: t != ""))
    want = df.select("a", "b", X.jaccard(tokens(F.col("a")), tokens(F.col("b"))).alias("s"))
    assert found.collect() == want.collect() and found.schema["s"].dataType.simpleString() == "double"
    assert df.select(X.name_tokens(F.col("b"))).collect() == df.select(F.when(F.col("b").isNotNull(), tokens(F.col("b")))).collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
