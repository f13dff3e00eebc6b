"""Commits of a repository as source tables: the files of a tree, without a checkout."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tree import SCHEMA


class RevisionError(ValueError):
    pass


def _git(root: str, *args: str) -> bytes:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, env=env)
    if done.returncode:
        raise RevisionError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout


def check_ref(ref: str) -> None:
    """One commit: no range, and nothing that reads as an option."""
    if not ref or ".." in ref or ref.startswith(("-", "^")) or any(c.isspace() for c in ref):
        raise RevisionError(f"{ref!r} does not name one commit")


def resolve(root: str, ref: str) -> str:
    check_ref(ref)
    return _git(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


def load(spark: SparkSession, root: str, ref: str, prefixes: list[str] = (), suffix: str = ".rs", snapshot: str = "before") -> DataFrame:
    """(snapshot, path, content) of a commit's files under ``prefixes``, by paths from the repository's root."""
    commit = resolve(root, ref)
    listed = _git(root, "ls-tree", "-r", "-z", "--full-tree", commit, *(["--", *prefixes] if prefixes else [])).decode(errors="surrogateescape").split("\0")
    wanted = []
    for entry in filter(None, listed):
        meta, path = entry.split("\t", 1)
        mode, kind, blob = meta.split(" ")
        if kind == "blob" and mode != "120000" and path.endswith(suffix):
            wanted.append((snapshot, path, blob))
    names = spark.createDataFrame(wanted, "snapshot string, path string, blob string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(2).to_pylist()
            for i, content in enumerate(_contents(root, blobs)):
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([content], pa.binary())], names=["snapshot", "path", "content"])

    # The driver lists; a process for each task reads its part of the objects.
    return names.repartition(max(1, min(len(wanted), 4 * spark.sparkContext.defaultParallelism)), F.col("path")).mapInArrow(read, SCHEMA)


def _contents(root: str, blobs: list[str]) -> Iterator[bytes]:
    """The contents of objects, by one process."""
    if not blobs:
        return
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env) as p:
        for blob in blobs:
            p.stdin.write(blob.encode() + b"\n")
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3:
                raise RevisionError(f"object {blob} can't be read")
            yield p.stdout.read(int(head[2]))
            p.stdout.read(1)
        p.stdin.close()


def tree(root: str, ref: str) -> dict[str, str]:
    """A commit's paths with their kind, file or directory; '' is its root."""
    listed = _git(root, "ls-tree", "-r", "-t", "-z", "--full-tree", resolve(root, ref)).decode(errors="surrogateescape").split("\0")
    kinds = (entry.split("\t", 1) for entry in filter(None, listed))
    return {"": "directory", **{path: "directory" if " tree " in f" {meta} " else "file" for meta, path in kinds}}


def endpoint(root: str, ref: str | None, profile: dict) -> dict:
    """Where one side of a comparison comes from: its commit, whether the working tree
    differs from it (never for a commit that was named), and the profile."""
    return {"commit": resolve(root, ref or "HEAD"), "dirty": dirty(root) if ref is None else False, "profile": profile}


def dirty(root: str) -> bool:
    return bool(_git(root, "status", "--porcelain", "-z", "--untracked-files=normal"))


def fingerprint(root: str) -> str:
    """A digest of the working state: the commit, the status and the changed files' contents."""
    status = _git(root, "status", "--porcelain", "-z", "--untracked-files=all")
    h = hashlib.sha256()
    for frame in (_git(root, "rev-parse", "HEAD"), status, _git(root, "diff", "HEAD", "--binary")):
        h.update(len(frame).to_bytes(8, "big") + frame)
    for entry in status.decode(errors="surrogateescape").split("\0"):
        if entry.startswith("?? ") and os.path.isfile(p := os.path.join(root, entry[3:])):
            with open(p, "rb") as f:
                data = f.read()
            h.update(len(data).to_bytes(8, "big") + data)
    return h.hexdigest()
