"""Path globs as regular expressions, so a path filter runs inside the scan's own stage."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILD = set("*?[]{}")


def expand_dirs(globs: Sequence[str]) -> list[str]:
    """A pattern without wildcards names a file or a directory: ``x`` also means ``x/**``."""
    out = []
    for g in globs:
        bare = g.rstrip("/")
        out += [g] if _WILD & set(g) else [bare, f"{bare}/**"]
    return out


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob: ``*`` and ``?`` stay within a path segment,
    ``**`` crosses segments, ``{a,b}`` alternates, ``[..]`` is a class; dot files match."""
    out, i = "", 0
    depth = 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    patterns = [glob_regex(g) for g in expand_dirs(globs)]
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)


def kept(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a path passes: include narrows only where given, exclude always drops."""
    inside = matches_any(path, include) if include else F.lit(True)
    return inside & ~matches_any(path, exclude) if exclude else inside
