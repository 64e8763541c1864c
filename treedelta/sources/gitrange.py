"""Pairs of files from a git repository: a commit range, or the working tree against HEAD."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "pair_id long, old_path string, new_path string, old_source string, new_source string"
#: Paths that one partition reads through one git process a side.
PATHS_PER_PARTITION = 200


def git(root: str, *args: str, data: bytes | None = None) -> bytes:
    """Output of one git command; RuntimeError with its message if it fails."""
    done = subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args[:2])}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def is_git_repo(root: str) -> bool:
    """The directory belongs to a working tree."""
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (RuntimeError, OSError):
        return False


def resolve_ref(root: str, ref: str) -> str | None:
    """The commit of a name, or None."""
    try:
        return git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()
    except RuntimeError:
        return None


def read_blobs(root: str, specs: list[str]) -> list[str]:
    """Texts of `commit:path` names through one process; missing ones are empty."""
    if not specs:
        return []
    out, texts, at = git(root, "cat-file", "--batch", data="\n".join(specs).encode() + b"\n"), [], 0
    for _ in specs:
        end = out.index(b"\n", at)
        head = out[at:end].split(b" ")
        at = end + 1
        if len(head) == 3 and head[1] == b"blob" and head[2].isdigit():
            size = int(head[2])
            texts.append(out[at : at + size].decode("utf-8", "replace"))
            at += size + 1
        elif len(head) == 3 and head[2].isdigit():
            at += int(head[2]) + 1
            texts.append("")
        else:
            texts.append("")
    return texts


def changed_files(root: str) -> list[str]:
    """Paths that differ from HEAD, and untracked ones; none if git fails."""
    try:
        found = git(root, "diff", "HEAD", "--name-only", "-z", "--no-renames") + git(root, "ls-files", "--others", "--exclude-standard", "-z")
    except (RuntimeError, OSError):
        return []
    return sorted({p.decode("utf-8", "surrogateescape") for p in found.split(b"\0") if p})


def parse_range(text: str) -> tuple[str, str]:
    """The two ends of a..b."""
    ends = text.split("..")
    if len(ends) != 2 or not all(ends):
        raise ValueError(f"not a range of two commits: {text}")
    return ends[0], ends[1]


def _working_text(root: str, path: str) -> str:
    try:
        return Path(root, path).read_text(encoding="utf-8", errors="replace")
    except OSError:
        return ""


class _Chunk(InputPartition):
    def __init__(self, first: int, paths: list[str]) -> None:
        super().__init__(first)
        self.first, self.paths = first, paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.range = options.get("path") or options.get("root") or ".", options.get("range", "")

    def partitions(self) -> list[InputPartition]:
        if self.range:
            a, b = parse_range(self.range)
            paths = [p.decode("utf-8", "surrogateescape") for p in git(self.root, "diff", "--name-only", "-z", "--no-renames", a, b).split(b"\0") if p]
        else:
            paths = changed_files(self.root)
        return [_Chunk(i, paths[i : i + PATHS_PER_PARTITION]) for i in range(0, len(paths), PATHS_PER_PARTITION)] or [_Chunk(0, [])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        paths = partition.paths
        a, b = parse_range(self.range) if self.range else ("HEAD", None)
        old = read_blobs(self.root, [f"{a}:{p}" for p in paths])
        new = read_blobs(self.root, [f"{b}:{p}" for p in paths]) if b else [_working_text(self.root, p) for p in paths]
        for i, (p, x, y) in enumerate(zip(paths, old, new, strict=True)):
            yield (partition.first + i, p, p, x, y)


class GitRange(DataSource):
    """format("gitrange") with options root and range (a..b); without a range the working tree against HEAD."""

    @classmethod
    def name(cls) -> str:
        return "gitrange"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def diff_commit_range(spark: SparkSession, root: str, commits: str) -> DataFrame:
    """Pairs of the files that differ between two commits."""
    parse_range(commits)
    spark.dataSource.register(GitRange)
    return spark.read.format("gitrange").option("root", root).option("range", commits).load()


def diff_working_tree(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of the files that differ from HEAD."""
    spark.dataSource.register(GitRange)
    return spark.read.format("gitrange").option("root", root).load()


def write_git_attributes(extensions: list[str], root: str = ".", driver: str = "treedelta") -> str:
    """Set diff=<driver> for extensions in .gitattributes; other lines and attributes stay.  Returns the text."""
    path = Path(root, ".gitattributes")
    lines = path.read_text().splitlines() if path.exists() else []
    for ext in extensions:
        pattern, mark = f"*.{ext}", f"diff={driver}"
        at = next((i for i, x in enumerate(lines) if x.split()[:1] == [pattern]), None)
        if at is None:
            lines.append(f"{pattern} {mark}")
        else:
            kept = [w for w in lines[at].split() if not w.startswith("diff=")]
            lines[at] = " ".join([*kept, mark])
    text = "\n".join(lines) + "\n"
    path.write_text(text)
    return text


def diff_driver_command(program: str) -> str:
    """The command for git's diff driver setting."""
    return f"{shlex.quote(program)} --git-diff-driver"
