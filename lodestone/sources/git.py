"""Git facts as tables, read by the driver's own git."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.envelope import Envelope, Truncation


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True)
    return done.stdout


def parse_status(text: str) -> list[tuple[str, str, str | None]]:
    """(state, path, earlier path) of ``status --porcelain -z``; a rename has its source beside it."""
    parts, out, i = text.split("\0"), [], 0
    while i < len(parts):
        if parts[i]:
            state, path = parts[i][:2], parts[i][3:]
            earlier = None
            if "R" in state or "C" in state:
                i += 1
                earlier = parts[i]
            out.append((state.strip(), path, earlier))
        i += 1
    return out


def tracked(spark: SparkSession, root: str) -> DataFrame:
    rows = [(p,) for p in _git(root, "ls-files", "-z").split("\0") if p]
    return spark.createDataFrame(rows, "path string")


def status(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(parse_status(_git(root, "status", "--porcelain", "-z", "--untracked-files=all")), "state string, path string, earlier string")


def fingerprint(root: str) -> str:
    """HEAD and the work tree's state in one text: equal texts, equal trees."""
    return _git(root, "rev-parse", "HEAD").strip() + "\n" + _git(root, "status", "--porcelain", "-z", "--untracked-files=all")


def changed_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """Paths that differ from a commit, with untracked ones."""
    rows = {p for p in _git(root, "diff", "--name-only", "-z", ref).split("\0") if p}
    rows |= {path for state, path, _ in parse_status(_git(root, "status", "--porcelain", "-z", "--untracked-files=all")) if state == "??"}
    return spark.createDataFrame([(p,) for p in sorted(rows)], "file string")


def history(spark: SparkSession, root: str, limit: int = 1000) -> Envelope:
    """``log``, with the number of all commits where it is cut."""
    total = int(_git(root, "rev-list", "--count", "HEAD"))
    return Envelope(log(spark, root, limit), Truncation(limit, total, "raise limit") if total > limit else None)


def log(spark: SparkSession, root: str, limit: int = 1000) -> DataFrame:
    """The last ``limit`` commits; ``history`` says if there are more."""
    rows = [tuple(x.split("\x1f")) for x in _git(root, "log", f"-{limit}", "--format=%H%x1f%an%x1f%aI%x1f%s").splitlines()]
    return spark.createDataFrame(rows, "hash string, author string, date string, subject string")


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(line, hash, author, summary) of a file."""
    rows, seen, key, line = [], {}, "", 0
    for x in _git(root, "blame", "--porcelain", path).splitlines():
        if x.startswith("\t"):
            rows.append((line, key, *seen[key]))
        elif x.startswith("author "):
            seen[key] = (x[7:], "")
        elif x.startswith("summary "):
            seen[key] = (seen[key][0], x[8:])
        elif len(x.split(" ")[0]) == 40:
            key, line = x.split(" ")[0], int(x.split(" ")[2])
    return spark.createDataFrame(rows, "line int, hash string, author string, summary string")
