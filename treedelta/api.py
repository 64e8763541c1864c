"""The engine in one place."""

from __future__ import annotations

from .adapters.code import languages
from .kernel.matching import MatchOptions
from .kernel.pair import register_binary_plugin, unregister_binary_plugin
from .operators.correlate import correlate
from .operators.diff import diff_pairs, diff_snapshots, edit_actions
from .operators.narrate import narrate
from .operators.render import report
from .operators.sequences import line_hunks, parse, word_hunks
from .operators.summarize import summarize
from .sources.files import diff_directories, read_file_pair
from .sources.gitrange import diff_commit_range, diff_working_tree
from .sql import register

__all__ = ["MatchOptions", "correlate", "diff_commit_range", "diff_directories", "diff_pairs", "diff_snapshots", "diff_working_tree", "edit_actions", "languages", "line_hunks", "narrate", "parse", "read_file_pair", "register", "register_binary_plugin", "report", "summarize", "unregister_binary_plugin", "word_hunks"]
