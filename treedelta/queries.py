"""The engine's queries by name, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import routing as R
from .functions import text as X
from .operators import rows as row_ops
from .operators.correlate import correlate
from .operators.diff import diff_pairs, edit_actions, routed, whole_files
from .operators.narrate import description, distinct_actions, drop_redundant_updates, narrated
from .operators.render import llm_line
from .operators.sequences import increasing_length, lcs_length, line_hunks, line_ops, parse, trimmed, word_hunks
from .operators.summarize import action_counts, summarize, summary_by
from .plans.hierarchy import ancestry
from .streaming.json_changes import stream_json_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXTENSIONS = ("json", "ts", "html", "png", "txt", "md", "yaml", "csv", "py", "xyz")


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two snapshots of documents: a tenth is gone, a tenth is new, two tenths are edited, a tenth has moved ---

_LIST = ", ".join(f"'{e}'" for e in EXTENSIONS)
_PATH_SQL = f"concat(source, '/d', doc_id, '.', ([{_LIST}])[CAST((doc_id // 10) % 10 AS INTEGER) + 1])"
OLD_SQL = f"SELECT doc_id, source, {_PATH_SQL} AS path, text FROM documents WHERE doc_id % 10 <> 1"
NEW_SQL = f"""SELECT doc_id, source, CASE WHEN doc_id % 10 = 4 THEN concat('moved/', {_PATH_SQL}) ELSE {_PATH_SQL} END AS path,
  CASE doc_id % 10 WHEN 2 THEN replace(text, 'e', 'E') WHEN 3 THEN concat(text, chr(10), 'appended line') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0"""
_PAIRS_SQL = f"""o AS ({OLD_SQL}), n AS ({NEW_SQL}), pairs AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.source, n.source) AS source, coalesce(o.text, '') AS old_source, coalesce(n.text, '') AS new_source FROM o FULL OUTER JOIN n ON o.path = n.path)"""
_EXT_SQL = "lower(list_extract(string_split(path, '.'), -1))"
_TIER_SQL = f"CASE WHEN {_EXT_SQL} = 'png' THEN 0 WHEN {_EXT_SQL} IN ('json', 'yaml') THEN 4 WHEN {_EXT_SQL} = 'html' THEN 3 WHEN {_EXT_SQL} IN ('md', 'csv') THEN 1 WHEN {_EXT_SQL} = 'txt' THEN 2 WHEN {_EXT_SQL} IN ('ts', 'py') THEN 5 ELSE 1 END"
_ROUTE_SQL = f"CASE WHEN old_source = '' AND new_source <> '' THEN 'insert' WHEN new_source = '' AND old_source <> '' THEN 'delete' WHEN old_source = new_source THEN 'same' ELSE list_extract(['binary', 'raw', 'prose', 'markup', 'data', 'code'], {_TIER_SQL} + 1) END"


def path_of() -> F.Column:
    """The path of a document."""
    exts = F.array(*[F.lit(e) for e in EXTENSIONS])
    return F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(exts, (F.expr("doc_id div 10") % 10 + 1).cast("int")))


def _new_text(kind: F.Column) -> F.Column:
    return F.when(kind == 2, F.replace("text", F.lit("e"), F.lit("E"))).when(kind == 3, F.concat("text", F.lit("\nappended line"))).otherwise(F.col("text"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The old and the new snapshot: doc_id, source, path, text."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 10
    old = docs.filter(kind != 1).select("doc_id", "source", path_of().alias("path"), "text")
    path = F.when(kind == 4, F.concat(F.lit("moved/"), path_of())).otherwise(path_of())
    return old, docs.filter(kind != 0).select("doc_id", "source", path.alias("path"), _new_text(kind).alias("text"))


def snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the two snapshots."""
    from .sources.snapshots import pair_snapshots

    old, new = snapshots(spark, sf_dir)
    return pair_snapshots(old, new, "path", "text")


PATH_TIERS_SQL = f"WITH d AS (SELECT {_PATH_SQL} AS path FROM documents) SELECT {_EXT_SQL} AS extension, CAST({_TIER_SQL} AS INTEGER) AS tier, {_EXT_SQL} = 'png' AS is_binary, count(*) AS n FROM d GROUP BY ALL"


@query(PATH_TIERS_SQL)
def classify_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(path_of().alias("path"))
    ext = R.extension(F.col("path"))
    return paths.groupBy(ext.alias("extension"), R.tier(F.col("path")).cast("int").alias("tier"), R.is_binary_extension(ext).alias("is_binary")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS looks_binary FROM documents")
def binary_sniff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ab\x00"), "text")).when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit("�"))).otherwise(F.col("text"))
    return docs.select("doc_id", R.looks_binary(mark).alias("looks_binary"))


@query(f"WITH {_PAIRS_SQL} SELECT path, CASE WHEN old_source = '' THEN 'Insert' ELSE 'Delete' END AS action, length(concat(old_source, new_source)) AS n_chars FROM pairs WHERE (old_source = '') <> (new_source = '')")
def snapshot_added_removed(spark, sf_dir):
    actions = edit_actions(whole_files(snapshot_pairs(spark, sf_dir)))
    return actions.select(F.col("file_path").alias("path"), "action", F.length("node.value").cast("long").alias("n_chars"))


@query(f"WITH {_PAIRS_SQL} SELECT count(*) AS n_unchanged FROM pairs WHERE old_source = new_source")
def snapshot_unchanged(spark, sf_dir):
    return routed(snapshot_pairs(spark, sf_dir)).filter("route = 'same'").agg(F.count("*").alias("n_unchanged"))


@query(f"WITH {_PAIRS_SQL} SELECT {_ROUTE_SQL} AS route, count(*) AS n FROM pairs GROUP BY 1")
def route_counts(spark, sf_dir):
    return routed(snapshot_pairs(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS_SQL} SELECT path, concat(strlen(old_source), ' bytes') AS from_value, concat(strlen(new_source), ' bytes') AS to_value FROM pairs WHERE {_ROUTE_SQL} = 'binary'")
def binary_diff(spark, sf_dir):
    found = edit_actions(diff_pairs(snapshot_pairs(spark, sf_dir))).filter("tier = 0 and node.kind = 'binary_file'")
    return found.select(F.col("file_path").alias("path"), F.col("detail.from").alias("from_value"), F.col("detail.to").alias("to_value"))


@query()
def snapshot_diff_summary(spark, sf_dir):
    """The flagship: two snapshots, all tiers, counts of actions by tier and source directory."""
    changes = distinct_actions(diff_pairs(snapshot_pairs(spark, sf_dir)))
    return action_counts(changes.withColumn("directory", F.substring_index("file_path", "/", 1)), "directory", "tier").orderBy("directory", "tier")


@query()
def snapshot_narration(spark, sf_dir):
    """Every change of the two snapshots as a sentence and as a dense line."""
    return narrated(distinct_actions(diff_pairs(snapshot_pairs(spark, sf_dir)))).select("file_path", "seq", "action", "description", llm_line().alias("line"))


@query(f"""WITH RECURSIVE o AS ({OLD_SQL}), n AS ({NEW_SQL}),
d AS (SELECT path, text, row_number() OVER (PARTITION BY md5(text) ORDER BY path) AS k FROM o WHERE text <> '' AND path NOT IN (SELECT path FROM n WHERE text <> '')),
c AS (SELECT path, text, row_number() OVER (PARTITION BY md5(text) ORDER BY path) AS k FROM n WHERE text <> '' AND path NOT IN (SELECT path FROM o WHERE text <> '')),
x AS (SELECT d.path AS from_file, c.path AS to_file FROM d JOIN c ON d.text = c.text AND d.k = c.k),
u AS (SELECT path, row_number() OVER (ORDER BY path) AS r, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda y: y <> '')) AS t FROM d WHERE path NOT IN (SELECT from_file FROM x)),
v AS (SELECT path, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda y: y <> '')) AS t FROM c WHERE path NOT IN (SELECT to_file FROM x)),
e AS (SELECT u.path AS f, u.r, v.path AS t, len(list_intersect(u.t, v.t)) / (len(u.t) + len(v.t) - len(list_intersect(u.t, v.t))) AS s FROM u JOIN v ON least(len(u.t), len(v.t)) >= 0.6 * greatest(len(u.t), len(v.t)) AND len(v.t) > 0),
w AS (SELECT f, row_number() OVER (ORDER BY r) AS k, list({{'s': s, 't': t}} ORDER BY s DESC, t) AS l FROM e WHERE s >= 0.6 GROUP BY f, r),
g AS (SELECT 0 AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS f, CAST(NULL AS STRUCT(s DOUBLE, t VARCHAR)) AS b
 UNION ALL SELECT w.k, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.t) END, w.f, list_filter(w.l, lambda y: NOT list_contains(CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.t) END, y.t))[1] FROM g JOIN w ON w.k = g.k + 1)
SELECT 'file' AS kind, to_file AS name, from_file, to_file, false AS modified, 1.0::DOUBLE AS similarity FROM x UNION ALL SELECT 'file', b.t, f, b.t, b.s < 1, b.s FROM g WHERE b IS NOT NULL""")
def snapshot_moves(spark, sf_dir):
    """Files and named nodes that moved between files."""
    return correlate(edit_actions(diff_pairs(snapshot_pairs(spark, sf_dir))))


# --- rows ---

_ROWS = {
    "supplier": ("s_suppkey", "s_acctbal", "s_nationkey"),
    "customer": ("c_custkey", "c_acctbal", "c_nationkey"),
    "part": ("p_partkey", "p_retailprice", "p_size"),
    "orders": ("o_orderkey", "o_totalprice", "o_custkey"),
}


def _row_snapshots(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    key, a, b = _ROWS[name]
    old = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("key"), F.col(a).cast("double").alias("amount"), F.col(b).cast("double").alias("code"))
    kept = old.filter(F.col("key") % 11 != 0).withColumn("amount", F.when(F.col("key") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount"))).withColumn("code", F.when(F.col("key") % 14 == 0, F.col("code") + 2).otherwise(F.col("code")))
    copies = old.filter(F.col("key") % 13 == 0).withColumn("key", F.col("key") + 1_000_000_000)
    return old, kept.unionByName(copies)


def _each_table(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    out = None
    for name in _ROWS:
        part = f(*_row_snapshots(spark, sf_dir, name))
        out = part if out is None else out.unionByName(part)
    return out


_OLD_ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS BIGINT) AS key, CAST({a} AS DOUBLE) AS amount, CAST({b} AS DOUBLE) AS code FROM {t}" for t, (k, a, b) in _ROWS.items())


@query(f"""WITH old AS ({_OLD_ROWS_SQL}), changed AS (SELECT * FROM old WHERE key % 7 = 0 AND key % 11 <> 0)
SELECT table_name, key, 'amount' AS "column", round(amount, 4) AS from_value, round(amount + 1, 4) AS to_value FROM changed
UNION ALL SELECT table_name, key, 'code', round(code, 4), round(code + 2, 4) FROM changed WHERE key % 14 = 0""")
def row_value_changes(spark, sf_dir):
    found = _each_table(spark, sf_dir, lambda a, b: row_ops.row_value_changes(a, b, ["table_name", "key"]))
    return found.select("table_name", "key", "column", F.round(F.col("from_value").cast("double"), 4).alias("from_value"), F.round(F.col("to_value").cast("double"), 4).alias("to_value"))


@query(f"""WITH old AS ({_OLD_ROWS_SQL})
SELECT table_name, key + 1000000000 AS key, 'Insert' AS action FROM old WHERE key % 13 = 0 UNION ALL SELECT table_name, key, 'Delete' FROM old WHERE key % 11 = 0""")
def rows_inserted_deleted(spark, sf_dir):
    keys = ["table_name", "key"]
    f = lambda a, b: row_ops.rows_inserted(a, b, keys).select(*keys, F.lit("Insert").alias("action")).unionByName(row_ops.rows_deleted(a, b, keys).select(*keys, F.lit("Delete").alias("action")))
    return _each_table(spark, sf_dir, f)


# --- data, markup and text trees ---


@query("SELECT event_id, 'k' AS label, json_extract_string(props, '$.k') AS value FROM events WHERE props IS NOT NULL")
def json_leaves(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return parse(events, "props", R.DATA, "event_id").filter("kind = 'leaf'").select(F.col("pair_id").alias("event_id"), "label", "value")


_LAG_SQL = """WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS v, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)"""


@query(f"{_LAG_SQL} SELECT user_id, event_id, 'k' AS label, was AS from_value, v AS to_value FROM e WHERE place > 1 AND was <> v")
def json_value_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    # Equal texts before and after make equal edits, so each two that meet are compared once; equal ones make none.
    pairs = events.select("user_id", "event_id", before.alias("old_source"), F.col("props").alias("new_source")).filter("old_source <> new_source").withColumn("pair_id", F.xxhash64("old_source", "new_source"))
    path = F.lit("e.json")
    once = pairs.select("pair_id", path.alias("old_path"), path.alias("new_path"), "old_source", "new_source").groupBy("old_path", "new_path", "old_source", "new_source").agg(F.first("pair_id").alias("pair_id"))
    changes = edit_actions(diff_pairs(once, keep=("old_source", "new_source"))).filter("action = 'Update'")
    found = pairs.drop("pair_id").join(changes.select("old_source", "new_source", "node", "detail"), ["old_source", "new_source"])
    return found.select("user_id", "event_id", F.col("node.label").alias("label"), F.col("detail.from").alias("from_value"), F.col("detail.to").alias("to_value"))


@query(f"{_LAG_SQL} SELECT user_id, event_id, 'k' AS path, was AS from_value, v AS to_value FROM e WHERE place > 1 AND was <> v")
def stream_changes(spark, sf_dir):
    """The same changes by a stream over events that runs until what is there has been read."""
    from .session import fresh_path

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "state")
    stream = stream_json_changes(events).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("user_id long, event_id long, path string, from_value string, to_value string").parquet(out)


def _key_values(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    text = F.concat(F.lit(f"name{mark}"), "p_name", F.lit(f"\nsize{mark}"), F.col("p_size").cast("string"))
    return parse(table(spark, sf_dir, "part").withColumn("source", text), "source", R.DATA, "p_partkey").filter("kind = 'leaf'").select(F.col("pair_id").alias("p_partkey"), "label", "value")


_KV_SQL = "SELECT p_partkey, 'name' AS label, p_name AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part"


@query(_KV_SQL)
def toml_leaves(spark, sf_dir):
    return _key_values(spark, sf_dir, "=")


@query(_KV_SQL)
def yaml_leaves(spark, sf_dir):
    return _key_values(spark, sf_dir, ": ")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([a-zA-Z][a-zA-Z0-9-]*)[^>]*>', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def markup_tag_counts(spark, sf_dir):
    nodes = parse(table(spark, sf_dir, "pages"), "html", R.MARKUP, "page_id").filter("kind <> 'document'")
    return nodes.groupBy(F.col("pair_id").alias("page_id"), F.col("kind").alias("tag")).agg(F.count("*").alias("n"))


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and the same with another first heading."""
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pair_id"), path.alias("old_path"), path.alias("new_path"), F.col("html").alias("old_source"), F.regexp_replace("html", "<h1>[^<]*</h1>", "<h1>edited</h1>").alias("new_source"))


EDITED_PAGES_SQL = """SELECT page_id, 'Update' AS action, 'h1' AS kind, nullif(h, '') AS from_value, 'edited' AS to_value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages) WHERE h <> 'edited'"""


@query(EDITED_PAGES_SQL)
def markup_diff(spark, sf_dir):
    """Actions of pages whose first heading was edited."""
    return edit_actions(diff_pairs(page_pairs(spark, sf_dir))).select(F.col("pair_id").alias("page_id"), "action", F.col("node.kind").alias("kind"), F.col("detail.from").alias("from_value"), F.col("detail.to").alias("to_value"))


# --- lines, words and paragraphs ---


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of the documents that both snapshots have, from one scan."""
    kind = F.col("doc_id") % 10
    # One text is dealt, not two: a file of one row group would else be one task's work.
    dealt = table(spark, sf_dir, "documents").filter(~kind.isin(0, 1)).select("doc_id", "text").repartition("doc_id")
    return dealt.select("doc_id", F.col("text").alias("old_text"), _new_text(kind).alias("new_text"))


_EDITED_SQL = f"o AS ({OLD_SQL}), n AS ({NEW_SQL}), e AS (SELECT o.doc_id, string_split(o.text, chr(10)) AS a, string_split(n.text, chr(10)) AS b FROM o JOIN n ON o.doc_id = n.doc_id)"


@query(f"""WITH {_EDITED_SQL}, c AS (SELECT doc_id, len(a) AS old_n, len(b) AS new_n, least(len(a), len(b)) AS m, a, b FROM e),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])) - 1, m) AS head FROM c)
SELECT doc_id, old_n, new_n, CAST(head AS BIGINT) AS head, CAST(coalesce(list_min(list_filter(range(1, m - head + 1), lambda i: a[old_n - i + 1] <> b[new_n - i + 1])) - 1, m - head) AS BIGINT) AS tail FROM h""")
def line_diff_stats(spark, sf_dir):
    lines = _edited(spark, sf_dir).select("doc_id", F.split("old_text", "\n").alias("a"), F.split("new_text", "\n").alias("b"))
    head, tail = trimmed(F.col("a"), F.col("b"))
    return lines.select("doc_id", F.size("a").cast("long").alias("old_n"), F.size("b").cast("long").alias("new_n"), head.cast("long").alias("head"), tail.cast("long").alias("tail"))


@query(f"""WITH {_EDITED_SQL}, m AS (SELECT doc_id, len(b) AS n, (1::HUGEINT << len(b)) - 1 AS every,
  list_transform(a, lambda x: list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = x THEN 1::HUGEINT << CAST(j - 1 AS INTEGER) ELSE 0::HUGEINT END)), lambda u, v: u | v)) AS masks FROM e)
SELECT doc_id, CAST(n - bit_count(list_reduce(list_prepend(every, masks), lambda r, k: ((r + (r & k)) | (r - (r & k))) & every)) AS INTEGER) AS lcs FROM m""")
def line_lcs_length(spark, sf_dir):
    lines = _edited(spark, sf_dir).select("doc_id", F.split("old_text", "\n").alias("a"), F.split("new_text", "\n").alias("b"))
    return lines.select("doc_id", lcs_length("a", "b").alias("lcs"))


@query(f"WITH {_EDITED_SQL} SELECT doc_id, true AS old_is_rebuilt, true AS new_is_rebuilt FROM e")
def line_diff_invariant(spark, sf_dir):
    rows = _edited(spark, sf_dir).withColumn("ops", line_ops("old_text", "new_text"))
    a, b = F.split("old_text", "\n"), F.split("new_text", "\n")
    head, tail = trimmed(a, b)

    def rebuilt(side, gone: str):
        kept = F.transform(F.filter("ops", lambda o: o["op"] != gone), lambda o: o["text"])
        return F.concat(F.slice(side, F.lit(1), head), kept, F.slice(side, F.size(side) - tail + 1, tail)) == side

    return rows.select("doc_id", rebuilt(a, "Insert").alias("old_is_rebuilt"), rebuilt(b, "Delete").alias("new_is_rebuilt"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+|\s+')) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '\S+|\s+'), '|')) AS tokens_md5 FROM documents")
def word_tokens(spark, sf_dir):
    tokens = X.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, "|").cast("binary")).alias("tokens_md5"))


@query(f"WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}) SELECT o.doc_id, o.text <> n.text AS has_hunks FROM o JOIN n ON o.doc_id = n.doc_id")
def word_diff_hunks(spark, sf_dir):
    differ = lambda c: F.when(~F.col("old_text").eqNullSafe(F.col("new_text")), F.col(c))  # noqa: E731  equal texts don't go to Python
    return _edited(spark, sf_dir).select("doc_id", (F.size(word_hunks(differ("old_text"), differ("new_text"))) > 0).alias("has_hunks"))


@query()
def line_hunk_counts(spark, sf_dir):
    """Hunks of the edited documents by kind."""
    found = _edited(spark, sf_dir).select("doc_id", F.explode(line_hunks("old_text", "new_text")).alias("h"))
    return found.groupBy("doc_id", F.col("h.op").alias("op")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS paragraphs_md5 FROM (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, chr(10), concat(chr(10), chr(10))), '\n\n+'), lambda x: regexp_replace(x, '\s+$', '')) AS p FROM documents)")
def paragraphs(spark, sf_dir):
    parts = X.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|").cast("binary")).alias("paragraphs_md5"))


# --- correlation ---


@query(f"""WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}), gone AS (SELECT path, md5(text) AS k FROM o WHERE path NOT IN (SELECT path FROM n)), come AS (SELECT path, md5(text) AS k FROM n WHERE path NOT IN (SELECT path FROM o)),
g AS (SELECT k, min(path) AS from_file FROM gone GROUP BY k HAVING count(*) = 1), c AS (SELECT k, min(path) AS to_file FROM come GROUP BY k HAVING count(*) = 1) SELECT from_file, to_file FROM g JOIN c USING (k)""")
def exact_moves(spark, sf_dir):
    """Files whose text has one deletion and one insertion: moves that no order decides."""
    whole = routed(snapshot_pairs(spark, sf_dir)).filter("route IN ('insert', 'delete')").select("route", "file_path", F.md5(F.when(F.col("route") == "insert", F.col("new_source")).otherwise(F.col("old_source")).cast("binary")).alias("k"))
    side = lambda way, name: whole.filter(F.col("route") == way).groupBy("k").agg(F.count("*").alias("n"), F.min("file_path").alias(name)).filter("n = 1").drop("n")
    return side("delete", "from_file").join(side("insert", "to_file"), "k").select("from_file", "to_file")


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS t FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0""")
def jaccard_pairs(spark, sf_dir):
    """Token similarity of all items that share a token, by an inverted index."""
    items = table(spark, sf_dir, "benchmark").select("item_id", X.name_tokens(F.col("text")).alias("t"))
    each = items.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    a, b = each.alias("a"), each.alias("b")
    common = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.item_id") < F.col("b.item_id"))).groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("n"))
    return common.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT f.c AS old_container, o.c AS new_container, count(*) AS common FROM f JOIN o ON f.i = o.i GROUP BY ALL)
SELECT old_container, new_container, common, round(2 * common / ((SELECT count(*) FROM f WHERE f.c = old_container) + (SELECT count(*) FROM o WHERE o.c = new_container)), 6) AS dice FROM p""")
def dice_containers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    side = lambda s: items.filter(F.col("l_linestatus") == s).select(F.col("l_suppkey").alias("container"), F.col("l_partkey").alias("item")).distinct()
    return row_ops.shared_descendants(side("F"), side("O")).select("old_container", "new_container", "common", F.round("dice", 6).alias("dice"))


@query(f"""WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}), a AS (SELECT md5(text) AS k, min(doc_id) AS old_id FROM o GROUP BY 1 HAVING count(*) = 1), b AS (SELECT md5(text) AS k, min(doc_id) AS new_id FROM n GROUP BY 1 HAVING count(*) = 1) SELECT old_id, new_id FROM a JOIN b USING (k)""")
def unique_anchor_match(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    node = lambda rows: rows.select(F.col("doc_id").alias("node_id"), F.md5(F.col("text").cast("binary")).alias("key"))
    return row_ops.unique_anchors(node(old), node(new), "key").select("old_id", "new_id")


@query("""SELECT c_custkey, 'customer' AS kind, concat('nation ', n_name, ' < region ', r_name) AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def ancestry_chain(spark, sf_dir):
    """Each customer's ancestors in the tree of regions, nations and customers, in postorder rows."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), "n_name")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk")).join(nations, "nk")
    top = F.lit(1 << 62)
    rows = (
        people.select("rk", F.col("nk"), F.col("c_custkey").alias("ck"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("label"))
        .unionByName(nations.select("rk", "nk", top.alias("ck"), F.lit("nation").alias("kind"), F.col("n_name").alias("label")))
        .unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), top.alias("nk"), top.alias("ck"), F.lit("region").alias("kind"), F.col("r_name").alias("label")))
    )
    postorder = Window.partitionBy("rk").orderBy("nk", "ck")
    sizes = F.when(F.col("kind") == "customer", 1).when(F.col("kind") == "nation", F.count("*").over(Window.partitionBy("rk", "nk"))).otherwise(F.count("*").over(Window.partitionBy("rk")))
    nodes = rows.select(F.col("rk").cast("long").alias("pair_id"), F.row_number().over(postorder).alias("node_id"), sizes.alias("subtree_size"), "kind", "label", "ck", "nk", "rk")
    # In postorder the last of a nation is the nation, the last of a region the region.
    last = lambda *keys: F.max("node_id").over(Window.partitionBy(*keys))
    up = F.when(F.col("kind") == "customer", last("rk", "nk")).when(F.col("kind") == "nation", last("rk")).otherwise(F.lit(-1))
    nodes = nodes.withColumn("parent_id", up).drop("nk", "rk")
    chain = ancestry(nodes).groupBy("pair_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.concat_ws(" ", "kind", "label").alias("name")))), lambda s: s["name"]), " < ").alias("chain"))
    return nodes.filter("kind = 'customer'").join(chain, ["pair_id", "node_id"]).select(F.col("ck").alias("c_custkey"), "kind", "chain")


@query("""SELECT c_custkey AS node_id FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 2 = 0 UNION ALL SELECT -1 - n_nationkey FROM nation WHERE n_nationkey % 2 = 1""")
def uncovered_nodes(spark, sf_dir):
    """One node per subtree that is gone: customers of nations that stay, and nations that go with all of theirs."""
    people = table(spark, sf_dir, "customer").select(F.lit(0).alias("pair_id"), F.col("c_custkey").cast("long").alias("node_id"), (-1 - F.col("c_nationkey")).cast("long").alias("parent_id"), ((F.col("c_custkey") % 3 != 0) & (F.col("c_nationkey") % 2 == 0)).alias("stays"))
    nations = table(spark, sf_dir, "nation").select(F.lit(0).alias("pair_id"), (-1 - F.col("n_nationkey")).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), (F.col("n_nationkey") % 2 == 0).alias("stays"))
    nodes = people.unionByName(nations)
    return row_ops.uncovered(nodes.drop("stays"), nodes.filter("stays").select("pair_id", "node_id")).select("node_id")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS i FROM orders),
ends AS (
  SELECT o_custkey, i, o_totalprice, 1 AS length FROM o
  UNION ALL
  SELECT DISTINCT o.o_custkey, o.i, o.o_totalprice, ends.length + 1 FROM ends JOIN o ON o.o_custkey = ends.o_custkey AND o.i > ends.i AND o.o_totalprice > ends.o_totalprice
),
longest AS (SELECT o_custkey, max(length) AS longest FROM ends GROUP BY o_custkey),
counts AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey)
SELECT o_custkey, CAST(n AS INTEGER) AS n, CAST(longest AS INTEGER) AS longest FROM counts JOIN longest USING (o_custkey)""")
def increasing_runs(spark, sf_dir):
    """Longest increasing run of each customer's order prices in time."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("prices"))
    return orders.select("o_custkey", F.size("prices").alias("n"), increasing_length("prices").alias("longest"))


# --- narration and aggregation over a table of actions made from rows ---

_ACTIONS = "Insert Delete Update Move".split()
_KINDS = "function_definition CallExpression line leaf Comment file".split()
_ACTIONS_SQL = f"""a AS (SELECT event_id AS seq, concat('f', user_id % 20) AS file, ([{", ".join(repr(a) for a in _ACTIONS)}])[CAST(event_id % 4 AS INTEGER) + 1] AS action, ([{", ".join(repr(k) for k in _KINDS)}])[CAST(event_id % 6 AS INTEGER) + 1] AS kind,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('n', user_id) END AS label, event_type AS value, props AS was, event_type AS now FROM events)"""
_HUMAN_SQL = "lower(replace(regexp_replace(kind, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '))"


def event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of actions in the engine's schema, one per event."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n + 1).cast("int"))
    none = F.lit(None).cast("string")
    action = pick(_ACTIONS, 4)
    pair = lambda kind, label: F.struct(kind.alias("kind"), label.alias("label"))
    return table(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("pair_id"),
        F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("file_path"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        F.struct(pick(_KINDS, 6).alias("kind"), F.when(F.col("event_id") % 5 == 0, none).otherwise(F.concat(F.lit("n"), F.col("user_id").cast("string"))).alias("label"), F.col("event_type").alias("value"), (F.col("event_id") % 90).cast("int").alias("line")).alias("node"),
        F.when(action == "Update", F.struct(F.when(F.col("event_id") % 3 == 0, "Renamed").otherwise("ValueChanged").alias("kind"), F.col("props").alias("from"), F.col("event_type").alias("to"))).alias("detail"),
        F.when(action == "Move", pair(F.lit("object"), none)).alias("from_parent"),
        F.when(action == "Move", pair(F.lit("object"), none)).alias("to_parent"),
        (F.col("event_id") % 7).cast("int").alias("to_position"),
        F.array(pair(F.lit("Block"), none), pair(F.lit("class_body"), F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")))).alias("context"),
    )


@query(f"WITH {_ACTIONS_SQL} SELECT DISTINCT kind, {_HUMAN_SQL} AS humanized FROM a")
def humanize_kinds(spark, sf_dir):
    return event_actions(spark, sf_dir).select("node.kind").distinct().select("kind", X.humanize_kind(F.col("kind")).alias("humanized"))


@query(r"SELECT doc_id, CASE WHEN length(f) > 40 THEN concat(left(f, 39), '…') ELSE f END AS glimpse FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def preview_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 40).alias("glimpse"))


_SUBJECT_SQL = f"concat({_HUMAN_SQL}, ' `', coalesce(label, value), '`')"
_IN_SQL = "concat(' in class body `C', u % 3, '`')"


NARRATED_SQL = f"""WITH {_ACTIONS_SQL.replace("event_type AS now", "event_type AS now, user_id AS u")}
SELECT seq, CASE action WHEN 'Insert' THEN concat('added ', {_SUBJECT_SQL}, {_IN_SQL}) WHEN 'Delete' THEN concat('removed ', {_SUBJECT_SQL}, replace({_IN_SQL}, ' in ', ' from '))
 WHEN 'Move' THEN concat('moved ', {_SUBJECT_SQL}, ' to position ', seq % 7 + 1, {_IN_SQL})
 ELSE CASE WHEN seq % 3 = 0 THEN concat('renamed ', {_HUMAN_SQL}, ' `', was, '` to `', now, '`', {_IN_SQL}) ELSE concat('changed ', CASE WHEN label IS NULL THEN {_HUMAN_SQL} ELSE concat('value of ', {_HUMAN_SQL}, ' `', label, '`') END, ' from `', was, '` to `', now, '`', {_IN_SQL}) END END AS description FROM a"""


@query(NARRATED_SQL)
def narrate_rows(spark, sf_dir):
    return event_actions(spark, sf_dir).select("seq", description().alias("description"))


@query(f"""WITH {_ACTIONS_SQL}, u AS (SELECT seq, row_number() OVER (PARTITION BY file, was, now ORDER BY label IS NULL, seq) AS place FROM a WHERE action = 'Update') SELECT seq FROM u WHERE place = 1 UNION ALL SELECT seq FROM a WHERE action <> 'Update'""")
def dedup_updates(spark, sf_dir):
    return drop_redundant_updates(event_actions(spark, sf_dir)).select("seq")


@query(f"""WITH {_ACTIONS_SQL}, c AS (SELECT file, count(*) FILTER (action = 'Insert') AS i, count(*) FILTER (action = 'Delete') AS d, count(*) FILTER (action = 'Update') AS u, count(*) FILTER (action = 'Move') AS m FROM a GROUP BY file)
SELECT file AS file_path, i AS n_insert, d AS n_delete, u AS n_update, m AS n_move, concat(file, ': ', concat_ws(', ', CASE WHEN i > 0 THEN concat(i, ' addition', CASE WHEN i > 1 THEN 's' ELSE '' END) END, CASE WHEN d > 0 THEN concat(d, ' deletion', CASE WHEN d > 1 THEN 's' ELSE '' END) END,
 CASE WHEN u > 0 THEN concat(u, ' modification', CASE WHEN u > 1 THEN 's' ELSE '' END) END, CASE WHEN m > 0 THEN concat(m, ' move', CASE WHEN m > 1 THEN 's' ELSE '' END) END)) AS summary FROM c""")
def summarize_changes(spark, sf_dir):
    return summarize(event_actions(spark, sf_dir), "file_path")


@query(f"WITH {_ACTIONS_SQL} SELECT file AS file_path, action, count(*) AS n_changes FROM a GROUP BY ROLLUP (file, action)")
def summary_rollup(spark, sf_dir):
    return summary_by(event_actions(spark, sf_dir), "file_path")


@query(f"""WITH {_ACTIONS_SQL} SELECT file AS file_path, {_HUMAN_SQL} AS kind, count(*) AS n, min(seq) AS first_seq FROM a WHERE kind IN ('line', 'word', 'Comment', 'comment') OR (action <> 'Update' AND label IS NULL) GROUP BY ALL""")
def llm_tally(spark, sf_dir):
    from .operators.render import llm_tally as tally

    return tally(event_actions(spark, sf_dir))


@query(f"""WITH {_ACTIONS_SQL} SELECT count(DISTINCT file) AS files, count(*) AS changes, count(*) FILTER (NOT (kind IN ('line', 'word', 'Comment', 'comment') OR (action <> 'Update' AND label IS NULL))) AS named FROM a""")
def llm_header(spark, sf_dir):
    minor = X.is_minor(F.col("action"), F.col("node.kind"), F.col("node.label"))
    return event_actions(spark, sf_dir).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("changes"), F.count_if(~minor).alias("named"))


@query()
def languages(spark, sf_dir):
    """Known languages with the level of their parser."""
    from .adapters.code import languages as known

    del sf_dir
    return spark.createDataFrame([(n, level, list(e)) for n, level, e in known()], "language string, level string, extensions array<string>")

from . import plan_queries as _plans  # noqa: E402,F401  registers its queries
