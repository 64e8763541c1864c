"""Command line: python -m treedelta.cli [OLD NEW | A..B] [--format F], or `languages`.

Settings are taken from treedelta.toml or .treedeltarc.json in the nearest directory upwards that has one.
"""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.render import FORMATS


def load_config(start: str = ".") -> dict:
    """The nearest settings; a file that can't be read is passed over."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name, read in (("treedelta.toml", tomllib.loads), (".treedeltarc.json", json.loads)):
            try:
                found = read((folder / name).read_text())
            except (OSError, ValueError):
                continue
            if isinstance(found, dict):
                return found
    return {}


def main(args: list[str] | None = None) -> int:
    """Exit 0 unless the arguments don't fit together."""
    config = load_config()
    parser = argparse.ArgumentParser(prog="treedelta", description=__doc__)
    parser.add_argument("what", nargs="*", help="two files or directories, a commit range, two commits, or `languages`; nothing: the working tree")
    parser.add_argument("--format", choices=FORMATS, default=config.get("format", "terminal"))
    for short in ("json", "markdown", "llm"):
        parser.add_argument(f"--{short}", dest="format", action="store_const", const=short)
    parser.add_argument("--repo", default=".")
    given = parser.parse_args(args)
    what = given.what[1:] if given.what[:1] == ["diff"] else given.what

    from . import api

    if what == ["languages"]:
        for name, level, extensions in api.languages():
            print(f"{name}\t{level}\t{' '.join(extensions)}")
        return 0
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if not what:
        pairs = api.diff_working_tree(spark, given.repo)
    elif len(what) == 1 and ".." in what[0]:
        pairs = api.diff_commit_range(spark, given.repo, what[0])
    elif len(what) == 2:
        kinds = [Path(p).is_dir() for p in what]
        if all(kinds):
            pairs = api.diff_directories(spark, *what)
        elif any(kinds):
            print("a file and a directory can't be compared", file=sys.stderr)
            return 1
        elif any(Path(p).exists() for p in what):
            pairs = api.read_file_pair(spark, *what)
        else:
            pairs = api.diff_commit_range(spark, given.repo, "..".join(what))
    else:
        parser.print_usage(sys.stderr)
        return 1
    actions = api.edit_actions(api.diff_pairs(pairs))
    for text in api.report(api.narrate(actions), api.correlate(actions), given.format):
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
