"""A bounded walk of a directory tree as a data source of Spark, and the walk's own account of what it left out."""

from __future__ import annotations

import os
import re
import stat
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories and files that are never read, and the bounds of a walk.
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", ".cache")
IGNORED_FILES = re.compile(r"(?:~|\.sw[a-z]|\.tmp|\.bak|^\.DS_Store|^#.*#)$")
MAX_BYTES, MAX_DEPTH, MAX_ENTRIES = 1 << 20, 64, 500_000
#: Directories that a walk is dealt out in, at least, if the tree has them.
SPLIT = 64

SCHEMA = "kind string, path string, size long, mtime_ms long, n long, content binary"


@dataclass
class Part(InputPartition):
    """A directory (below the root) and the entries that may be visited in it; or rows found on the way."""

    folder: str
    depth: int
    budget: int
    rows: tuple = ()


class _Visit:
    """Entries of one directory: files and notes as rows, directories to go into."""

    def __init__(self, root: str, bounds: dict):
        self.root, self.bounds, self.entries = root, bounds, 0
        self.links = self.deep = self.skipped = 0
        self.stopped: str | None = None

    def one(self, folder: str, depth: int, budget: int):
        """(rows, directories below) of a directory; ``stopped`` says what ended the walk."""
        rows, below = [], []
        try:
            names = sorted(os.listdir(os.path.join(self.root, folder)))
        except OSError as e:
            return [("unreadable", f"{folder or '.'}: {e.strerror}", None, None, 1, None)], below
        for name in names:
            if self.entries >= budget:
                self.stopped = "entries"
                break
            if time.time() >= self.bounds["until"]:
                self.stopped = "deadline"
                break
            self.entries += 1
            if name in IGNORED:
                continue
            path = f"{folder}/{name}" if folder else name
            try:
                found = os.lstat(os.path.join(self.root, path))
            except OSError as e:
                rows.append(("unreadable", f"{path}: {e.strerror}", None, None, 1, None))
                continue
            if stat.S_ISLNK(found.st_mode):
                self.links += 1
            elif stat.S_ISDIR(found.st_mode):
                if depth + 1 > self.bounds["depth"]:
                    self.deep += 1
                else:
                    below.append(path)
            elif stat.S_ISREG(found.st_mode) and not IGNORED_FILES.search(name) and found.st_size <= self.bounds["bytes"]:
                rows.append(("file", path, found.st_size, int(found.st_mtime * 1000), None, None))
        return rows, below

    def notes(self):
        for kind, n in (("links", self.links), ("depth", self.deep)):
            if n:
                yield kind, None, None, None, n, None
        if self.stopped:
            yield self.stopped, None, None, None, 1, None


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.bounds = {
            "bytes": int(options.get("maxbytes", MAX_BYTES)), "depth": int(options.get("maxdepth", MAX_DEPTH)), "entries": int(options.get("maxentries", MAX_ENTRIES)),
            "until": time.time() + float(options.get("seconds", 1e9)),
        }
        self.split, self.content = int(options.get("split", SPLIT)), options.get("content", "false").lower() == "true"

    def partitions(self):
        """The upper directories are visited level by level until there are enough to deal out; what is
        left of the bound on entries is dealt out among them, so that all together keep it."""
        visit, rows, level, depth = _Visit(self.root, self.bounds), [], [""], 0
        while level and (not depth or len(level) < self.split) and not visit.stopped:
            below = []
            for i, folder in enumerate(level):
                found, more = visit.one(folder, depth, self.bounds["entries"])
                rows += found
                below += more
                if visit.stopped:
                    break
            level, depth = [] if visit.stopped else below, depth + 1
        head = Part("", 0, 0, (*rows, *visit.notes()))
        left = max(0, self.bounds["entries"] - visit.entries)
        each, more = divmod(left, len(level)) if level else (0, 0)
        return [head, *(Part(folder, depth, each + (i < more)) for i, folder in enumerate(level))]

    def _filled(self, rows):
        """Rows with the files' content, if that is asked for."""
        for row in rows:
            if self.content and row[0] == "file":
                try:
                    with open(os.path.join(self.root, row[1]), "rb") as f:
                        row = (*row[:5], f.read(self.bounds["bytes"]))
                except OSError as e:
                    row = ("unreadable", f"{row[1]}: {e.strerror}", None, None, 1, None)
            yield row

    def read(self, partition: Part):
        yield from self._filled(partition.rows)
        if not partition.folder:
            return
        visit, todo = _Visit(self.root, self.bounds), [(partition.folder, partition.depth)]
        while todo and not visit.stopped:
            folder, depth = todo.pop()
            rows, below = visit.one(folder, depth, partition.budget)
            yield from self._filled(rows)
            todo += [(x, depth + 1) for x in reversed(below)]
        yield from visit.notes()


class WalkSource(DataSource):
    """``spark.read.format("bounded_walk").load(root)``; options maxBytes, maxDepth, maxEntries,
    seconds, content (whether the files are read).

    Rows of kind ``file`` have path (below the root), size and mtime_ms. All others say what is missing:
    ``links`` (n that were not followed), ``depth`` (n directories too deep), ``unreadable`` (with its path), ``entries`` and
    ``deadline`` (a bound that ended the walk, or a part of it). Links are never followed, so cycles
    are none. The root must be readable where the tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "bounded_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options)


def bounded_walk(spark: SparkSession, root: str, **options) -> DataFrame:
    """The rows of ``WalkSource``; options as there."""
    spark.dataSource.register(WalkSource)
    return spark.read.format("bounded_walk").options(**{k: str(v) for k, v in options.items()}).load(root)


def walk_notes(found: DataFrame) -> list[str]:
    """What a walk left out, in words; without any it is complete."""
    said = {
        "links": "{n} links not followed", "depth": "{n} directories beyond the depth", "unreadable": "unreadable: {path}", "entries": "the bound on entries was reached", "deadline": "the time was over"
    }
    rows = found.where("kind <> 'file'").groupBy("kind").agg({"n": "sum", "path": "min"}).collect()
    return sorted(said[r["kind"]].format(n=r["sum(n)"], path=r["min(path)"]) for r in rows)
