"""Changes as text: terminal, json, markdown, a dense format for language models, and ndjson."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import humanize_kind, icon, is_minor, llm_op, llm_value, nearest_named
from .summarize import summarize

#: First word of the dense format, with its version.
TAG = "treedelta/1"
FORMATS = ("terminal", "json", "markdown", "llm", "ndjson")


def llm_line() -> Column:
    """Sign, kind, name, line and scope of one action, then what changed."""
    kind = humanize_kind(F.col("node.kind"))
    name = F.when(F.col("node.kind") == "file", F.lit("")).otherwise(F.coalesce("node.label", F.lit("")))
    near = nearest_named(F.col("context"))
    within = F.when(near.isNotNull() & (near["label"] != name), F.concat(F.lit(" < "), humanize_kind(near["kind"]), F.lit(" "), near["label"])).otherwise(F.lit(""))
    line = F.when(F.coalesce("node.line", F.lit(0)) != 0, F.concat(F.lit(" :"), F.col("node.line").cast("string"))).otherwise(F.lit(""))
    head = F.concat(llm_op(F.col("action")), F.lit(" "), kind, F.when(name != "", F.concat(F.lit(" "), name)).otherwise(F.lit("")), line, within)
    was, now = F.col("detail.from"), F.col("detail.to")
    renamed = F.col("detail.kind") == "Renamed"
    return (
        F.when((F.col("action") == "Update") & renamed, F.concat(head, F.lit(" "), was, F.lit(" -> "), now))
        .when(F.col("action") == "Update", F.concat(head, F.lit(" "), llm_value(was), F.lit(" -> "), llm_value(now)))
        .when(F.col("action") == "Move", F.concat(head, F.lit(" from "), F.coalesce("from_parent.label", "from_parent.kind")))
        .otherwise(head)
    )


def llm_tally(changes: DataFrame, file_col: str = "file_path") -> DataFrame:
    """How many minor changes of each kind a file has, in order of their first."""
    minor = changes.filter(is_minor(F.col("action"), F.col("node.kind"), F.col("node.label")))
    return minor.groupBy(file_col, humanize_kind(F.col("node.kind")).alias("kind")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def render_files(changes: DataFrame, fmt: str, file_col: str = "file_path") -> DataFrame:
    """file and body: each file's changes as one text, in the order of seq.  changes comes from narrate."""
    ordered = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("text")))), lambda s: s["text"]), "\n")
    if fmt == "llm":
        minor = is_minor(F.col("action"), F.col("node.kind"), F.col("node.label"))
        lines = changes.filter(~minor).groupBy(F.col(file_col).alias("file")).agg(ordered(llm_line()).alias("lines"))
        word = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind"), F.when(F.col("n") > 1, "s").otherwise(""))
        tally = llm_tally(changes, file_col).groupBy(F.col(file_col).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", word.alias("text")))), lambda s: s["text"]), ", ").alias("tally"))
        both = lines.join(tally, "file", "full_outer")
        return both.select("file", F.concat_ws("\n", F.concat(F.lit("# "), "file"), "lines", F.concat(F.lit("* "), F.col("tally"))).alias("body"))
    if fmt == "markdown":
        return changes.groupBy(F.col(file_col).alias("file")).agg(ordered(F.concat(F.lit("- "), "description")).alias("body")).withColumn("body", F.concat(F.lit("## "), "file", F.lit("\n\n"), "body"))
    if fmt in ("json", "ndjson"):
        one = F.struct("seq", F.struct(F.struct("action", "node", "parent", "from_parent", "to_parent", "position", "from_position", "to_position", "detail", "context").alias("action"), F.col(file_col).alias("filePath"), "description").alias("change"))
        return changes.groupBy(F.col(file_col).alias("file")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["change"])).alias("body"))
    # Anything else is the terminal's form.
    return changes.groupBy(F.col(file_col).alias("file")).agg(ordered(F.concat(F.lit("  "), icon(F.col("action")), F.lit(" "), "description")).alias("body"))


def _moves_text(moves: list, dense: bool) -> list[str]:
    out = []
    for m in moves:
        if dense:
            out.append(f"> {m['name'] or m['kind']} {m['from_file']} -> {m['to_file']}{' edited' if m['modified'] else ''}")
        elif m["kind"] == "file":
            out.append(f"  → {'renamed and edited' if m['modified'] else 'renamed'} file {m['from_file']} to {m['to_file']}")
        else:
            name = f" `{m['name']}`" if m["name"] else ""
            out.append(f"  → {m['shown']}{name} from {m['from_file']} to {m['to_file']}")
    return out


def report(changes: DataFrame, moves: DataFrame | None = None, fmt: str = "terminal", file_col: str = "file_path") -> Iterator[str]:
    """The text of a whole changeset, file by file in order of the path; rows come to the driver one partition at a time."""
    found = [] if moves is None else moves.withColumn("shown", humanize_kind(F.col("kind"))).orderBy("from_file", "to_file").collect()
    files = render_files(changes, fmt, file_col).orderBy("file")
    cross = [{"kind": m["kind"], "name": m["name"] or "unnamed", "fromFile": m["from_file"], "toFile": m["to_file"], "modified": m["modified"]} for m in found]
    if fmt == "ndjson":
        for row in files.toLocalIterator():
            yield json.dumps({"file": row["file"], "changes": json.loads(row["body"])}, ensure_ascii=False)
        if cross:
            yield json.dumps({"crossFileMoves": cross}, ensure_ascii=False)
        return
    if fmt == "json":
        per_file = [c for row in files.toLocalIterator() for c in json.loads(row["body"])]
        yield json.dumps({"perFile": per_file, "crossFileMoves": cross}, ensure_ascii=False, indent=2)
        return
    if fmt == "llm":
        minor = is_minor(F.col("action"), F.col("node.kind"), F.col("node.label"))
        head = changes.agg(F.countDistinct(file_col).alias("files"), F.count("*").alias("n"), F.count_if(~minor).alias("named")).first()
        yield f"{TAG} {head['files']} files {head['n']} changes {head['named']} named"
        for row in files.toLocalIterator():
            yield row["body"]
        if found:
            yield "# cross-file"
            yield from _moves_text(found, dense=True)
        return
    count = changes.select(file_col).distinct().count()
    if count == 0:
        yield "_no logical changes_" if fmt == "markdown" else "no logical changes"
    for i, row in enumerate(files.toLocalIterator()):
        heading = f"{row['file']}\n" if count > 1 and fmt != "markdown" else ""
        yield ("\n" if i else "") + heading + row["body"]
    if found:
        yield "\n  cross-file moves:"
        yield from _moves_text(found, dense=False)
    yield "\n" + (summarize(changes).first()["summary"] if count else "no logical changes")
