"""The engine in SQL: table functions for lateral calls, and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .adapters.prose import diff_words as words
from .functions.sql_language import register_sql_functions
from .kernel.pair import CODE, DATA, MARKUP, diff_text, parse_tree
from .kernel.script import Diff
from .kernel.sequence import diff_lines as lines
from .kernel.tree import Tree

_HUNK = "seq int, op string, old_text string, new_text string"
_ACTION = "seq int, action string, kind string, label string, from_value string, to_value string"


def _hunks(found: list) -> Iterator[tuple]:
    for i, (op, old, new) in enumerate(found):
        yield i, op, old, new


def _actions(found: Diff) -> Iterator[tuple]:
    for i, a in enumerate(found.actions):
        detail = a.detail or (None, None, None)
        yield i, a.action, a.node.kind, a.node.label, detail[1], detail[2]


class DiffLines:
    """diff_lines(old, new)."""

    def eval(self, old: str, new: str) -> Iterator[tuple]:
        yield from _hunks(lines(old or "", new or ""))


class DiffWords:
    """diff_words(old, new)."""

    def eval(self, old: str, new: str) -> Iterator[tuple]:
        yield from _hunks(words(old or "", new or ""))


class DiffJson:
    """diff_json(old, new)."""

    def eval(self, old: str, new: str) -> Iterator[tuple]:
        yield from () if old == new else _actions(diff_text(old or "", new or "", DATA))


class DiffMarkup:
    """diff_markup(old, new)."""

    def eval(self, old: str, new: str) -> Iterator[tuple]:
        yield from () if old == new else _actions(diff_text(old or "", new or "", MARKUP))


class ParseTree:
    """parse_tree(text, tier), tier being data, markup or the extension of a language."""

    def eval(self, text: str, tier: str) -> Iterator[tuple]:
        kind = {"data": DATA, "markup": MARKUP}.get(tier, CODE)
        c = Tree(parse_tree(text or "", kind, tier)).columns()
        yield from zip(c["node_id"], c["parent_id"], c["kind"], c["label"], c["value"], strict=True)


def register(spark: SparkSession) -> None:
    """Make the table functions, and the scalar functions written in SQL, known to SQL."""
    for name, cls, kind in (("diff_lines", DiffLines, _HUNK), ("diff_words", DiffWords, _HUNK), ("diff_json", DiffJson, _ACTION), ("diff_markup", DiffMarkup, _ACTION), ("parse_tree", ParseTree, "node_id int, parent_id int, kind string, label string, value string")):
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    register_sql_functions(spark)
