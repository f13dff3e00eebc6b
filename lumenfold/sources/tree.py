"""Source trees: discovery under ignore rules, and loading as a table.

Discovery runs on the driver, as a tree is a local thing; what it finds becomes a
table (snapshot, path, content), which is also the form for large corpora.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "snapshot string, path string, content binary"


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    keeps: bool
    folders_only: bool


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += "[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def parse_ignore(text: str) -> list[Pattern]:
    """The lines of an ignore file, in order; the last that fits a path decides."""
    out = []
    for line in text.splitlines():
        line = line if line.endswith("\\ ") else line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _glob(line.removeprefix("/"))
        try:
            regex = re.compile(f"{'' if anchored else '(?:.*/)?'}{body}")
        except re.error:  # a line that can't be read, as a range from b to a, fits nothing
            continue
        out.append(Pattern(regex, keeps, folders))
    return out


def global_ignore(environ: dict[str, str] = os.environ) -> list[Pattern]:
    """The user's own ignore file: what Git's configuration names, else its usual place."""
    home = environ.get("HOME", "")
    config = environ.get("XDG_CONFIG_HOME") or (os.path.join(home, ".config") if home else "")
    named = ""
    for path in filter(None, (config and os.path.join(config, "git", "config"), home and os.path.join(home, ".gitconfig"))):
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                section = ""
                for line in map(str.strip, f):
                    if line.startswith("["):
                        section = line.strip("[]").strip().lower()
                    elif section == "core" and line.lower().partition("=")[0].strip() == "excludesfile":
                        named = line.partition("=")[2].strip().strip('"')
        except OSError:
            continue
    if named.startswith("~/"):
        named = os.path.join(home, named[2:])
    return _read(named or (os.path.join(config, "git", "ignore") if config else ""))


def fitting(paths: DataFrame, ignore: dict[str, str], suffix: str = ".rs", hidden: bool = False) -> DataFrame:
    """``paths`` (path) of files that discovery would find under ``ignore``: the text of each
    folder's ignore file, by the folder's path ('' is the root)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = {base: parse_ignore(text) for base, text in ignore.items()}
        for b in batches:
            yield b.filter(pa.array([_found(p, parsed, suffix, hidden) for p in b.column(0).to_pylist()], pa.bool_()))

    return paths.select("path").mapInArrow(keep, "path string")


def _found(path: str, parsed: dict[str, list[Pattern]], suffix: str, hidden: bool) -> bool:
    parts = path.split("/")
    if not path.endswith(suffix) or ".git" in parts or (not hidden and any(p.startswith(".") for p in parts)):
        return False
    stack: list[tuple[str, list[Pattern]]] = []
    for depth in range(len(parts)):
        base, rel = "/".join(parts[:depth]), "/".join(parts[: depth + 1])
        stack += [(base, parsed[base])] if base in parsed else []
        if _ignored(rel, depth + 1 < len(parts), stack):
            return False
    return True


def selection(paths: list[str], root: str, *, hidden: bool, no_ignore: bool) -> dict:
    """What was asked for: each path from the root once, with its kind, in order, and how."""
    shown = {(os.path.relpath(os.path.abspath(p), root).replace(os.sep, "/"), "directory" if os.path.isdir(p) else "file") for p in paths}
    return {"paths": [{"path": p, "kind": k} for p, k in sorted(shown)], "hidden": hidden, "ignore": not no_ignore}


def baseline_paths(paths: list[str], top: str, tree: dict[str, str]) -> list[str]:
    """Each path as it lies in another commit's tree, from the repository's ``top``.

    ``tree``: the commit's paths with their kind, file or directory ('' is its root).  A
    path outside of the repository, one that isn't there and one of another kind are errors."""
    out = []
    for p in paths:
        rel = os.path.relpath(os.path.realpath(p), os.path.realpath(top)).replace(os.sep, "/")
        if rel == ".." or rel.startswith("../"):
            raise ValueError(f"{p} is outside of the repository")
        rel = "" if rel == "." else rel
        kind = "directory" if os.path.isdir(p) else "file"
        if rel not in tree:
            raise ValueError(f"{p} does not exist in the baseline")
        if tree[rel] != kind:
            raise ValueError(f"{p} is a {tree[rel]} in the baseline")
        out.append(rel)
    return sorted(set(out))


def _read(path: str) -> list[Pattern]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return parse_ignore(f.read())
    except OSError:
        return []


def _ignored(rel: str, folder: bool, stack: list[tuple[str, list[Pattern]]]) -> bool:
    """The deepest file with a fitting line decides, by its last such line."""
    for base, patterns in reversed(stack):
        inside = rel[len(base) :].lstrip("/") if base else rel
        for p in reversed(patterns):
            if (folder or not p.folders_only) and p.regex.fullmatch(inside):
                return not p.keeps
    return False


def discover(paths: list[str], *, hidden: bool = False, no_ignore: bool = False, suffix: str = ".rs") -> list[str]:
    """Files under ``paths``.  A file named itself is always in.  A folder is a boundary:
    ignore files above it don't count; links aren't followed; .git and repositories
    inside are passed over; names that begin with a dot are in by ``hidden`` alone."""
    found = {p for p in paths if os.path.isfile(p) and p.endswith(suffix)}
    for root in (p for p in paths if os.path.isdir(p)):
        first = [] if no_ignore else [("", global_ignore()), ("", _read(os.path.join(root, ".git", "info", "exclude")))]
        todo = [("", first)]
        while todo:
            rel, stack = todo.pop()
            here = os.path.join(root, rel)
            own = stack if no_ignore else [*stack, *((rel, pats) for name in (".gitignore", ".ignore") if (pats := _read(os.path.join(here, name))))]
            with os.scandir(here) as entries:
                for e in entries:
                    path = f"{rel}/{e.name}" if rel else e.name
                    folder = e.is_dir(follow_symlinks=False)
                    if e.name == ".git" or (not hidden and e.name.startswith(".")) or (not no_ignore and _ignored(path, folder, own)):
                        continue
                    if folder:
                        if not os.path.exists(os.path.join(e.path, ".git")):
                            todo.append((path, own))
                    elif e.name.endswith(suffix) and e.is_file(follow_symlinks=False):
                        found.add(os.path.join(root, path))
    return sorted(found, key=lambda p: p.split("/"))


def common_root(paths: list[str]) -> str:
    """The deepest folder that holds all paths."""
    folders = [p if os.path.isdir(p) else os.path.dirname(p) for p in map(os.path.abspath, paths)]
    return os.path.commonpath(folders) if folders else os.getcwd()


def load(spark: SparkSession, paths: list[str], root: str, snapshot: str = "after") -> tuple[DataFrame, list[tuple[str, str]]]:
    """(snapshot, path, content) of the files, and (path, message) of those that can't be read.

    The driver lists; tasks read.  A tree is local, so tasks have to see the same disk."""
    real = os.path.realpath(root)
    shown = lambda p: os.path.relpath(os.path.realpath(p), real).replace(os.sep, "/")
    ok = [p for p in paths if os.access(p, os.R_OK)]
    bad = [(os.path.relpath(p, root), "cannot read source") for p in paths if not os.access(p, os.R_OK)]
    rows = spark.createDataFrame([(snapshot, shown(p), p) for p in ok], "snapshot string, path string, place string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, place in enumerate(b.column(2).to_pylist()):
                with open(place, "rb") as f:
                    content = f.read()
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([content], pa.binary())], names=["snapshot", "path", "content"])

    return rows.repartition(max(1, min(len(ok), 8 * spark.sparkContext.defaultParallelism)), F.col("path")).mapInArrow(read, SCHEMA), bad


def loader(spark: SparkSession, root: str, commit_files: DataFrame | None = None, suffix: str = ".rs"):
    """For ``plans.snapshot.expanded``: the files of the working tree (snapshot after) that
    exist among candidates, and those of ``commit_files`` for any other snapshot.

    Candidates on disk come from unresolved edges alone; their paths go to the driver."""

    def get(wanted: DataFrame) -> DataFrame:
        names = [r["path"] for r in wanted.where("snapshot = 'after'").select("path").collect()]
        there = [p for p in (os.path.normpath(os.path.join(root, n)) for n in names) if p.endswith(suffix) and os.path.isfile(p)]
        files, _ = load(spark, there, root)
        if commit_files is None:
            return files
        return files.unionByName(commit_files.join(wanted, ["snapshot", "path"], "left_semi").select("snapshot", "path", "content"))

    return get
