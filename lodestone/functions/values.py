"""Small value functions: confidence order, elision, name match ranks, spans, key prefixes, hashes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of confidence, from best to worst.
CONFIDENCE = ("certain", "partial", "dynamic", "unresolved")


def severity(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(CONFIDENCE):
        out = F.when(confidence == name, i).otherwise(out)
    return out


def worst_of(confidence: Column) -> Column:
    """Aggregate: the worst confidence of a group."""
    return F.max_by(confidence, severity(confidence))


def elided(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, an ellipsis marking what was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def camel_regex(query: str) -> str:
    """Humps of a name in order, from any hump on: ``uAF`` finds ``useAppForm`` and ``getUserAppForm``."""
    first, *rest = re.findall(r"[A-Z]?[^A-Z]+|[A-Z]", query) or [""]
    inner = re.escape(first[:1].upper() + first[1:])
    return f"(?:^{re.escape(first)}|(?<=[a-z0-9_$]){inner})" + "".join("[a-z0-9_$]*" + re.escape(h) for h in rest)


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring (these without case), 3 camel humps; null if none."""
    low, q = F.lower(name), query.lower()
    return (
        F.when(low == q, 0).when(low.startswith(q), 1).when(F.instr(low, q) > 0, 2)
        .when(name.rlike(camel_regex(query)), 3)
    )


def word_regex(word: str) -> str:
    """The word between ASCII word boundaries."""
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def in_segment(key: Column, prefix: Column) -> Column:
    """Whether a dotted key is the prefix or lies under it; ``a.bc`` is not under ``a.b``."""
    return (key == prefix) | key.startswith(F.concat(prefix, F.lit(".")))


def _at(span: str, line: str, col: str) -> Column:
    return F.struct(F.col(f"{span}.{line}").alias("line"), F.col(f"{span}.{col}").alias("col"))


def span_contains(outer: str, inner: str) -> Column:
    """Spans are structs file, line, col, end_line, end_col; ends are exclusive."""
    return (
        (F.col(f"{outer}.file") == F.col(f"{inner}.file"))
        & (_at(outer, "line", "col") <= _at(inner, "line", "col"))
        & (_at(inner, "end_line", "end_col") <= _at(outer, "end_line", "end_col"))
    )


def span_intersects(a: str, b: str) -> Column:
    """Touching ends do not intersect."""
    return (
        (F.col(f"{a}.file") == F.col(f"{b}.file"))
        & (_at(a, "line", "col") < _at(b, "end_line", "end_col"))
        & (_at(b, "line", "col") < _at(a, "end_line", "end_col"))
    )


def offset_location(text: Column, offset: Column) -> Column:
    """Struct line, col (from 1) of a character offset (from 0); null outside the text."""
    before = F.substring(text, F.lit(1), offset)
    lines = F.split(before, "\n", -1)
    return F.when((offset >= 0) & (offset <= F.length(text)), F.struct(F.size(lines).alias("line"), (F.length(F.element_at(lines, -1)) + 1).alias("col")))


SEGMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def key_match(edge: Column, query: Column, exact: Column, broad: Column, narrowed: Column) -> Column:
    """Three-valued prefix match of segment arrays: the confidence, or null without a match.

    A broad, absent or empty invalidation key meets every query dynamically; an absent query key
    meets no other. Else the edge must be a prefix (of equal length if exact): two different static
    segments rule it out, a dynamic one on either side makes it partial. A narrowed edge is never
    certain.
    """
    pairs = F.zip_with(edge, F.slice(query, F.lit(1), F.size(edge)), lambda a, b: F.when((a["kind"] == "static") & (b["kind"] == "static"), F.when(a["value"] == b["value"], 0).otherwise(2)).otherwise(1))
    worst = F.array_max(pairs)
    open_ = F.coalesce(broad, F.lit(False)) | edge.isNull() | (F.size(edge) == 0)
    return (
        F.when(open_, "dynamic").when(query.isNull(), None)
        .when(F.size(query) < F.size(edge), None).when(exact & (F.size(query) != F.size(edge)), None)
        .when(worst == 2, None).when((worst == 1) | narrowed, "partial").otherwise("certain")
    )


@F.pandas_udf(T.StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of UTF-8 text as sixteen hex digits."""

    def one(x):
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in x.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(one)


def symbol_id(name: Column, path: Column, line: Column, col: Column, root_tag: Column) -> Column:
    return F.concat(F.lit("ts:"), name, F.lit("@"), path, F.lit(":"), line.cast("string"), F.lit(":"), col.cast("string"), F.lit("~"), root_tag)


def package_name(spec: Column) -> Column:
    """The package that a bare specifier addresses: two segments under a scope, else one."""
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def template_head(text: Column) -> Column:
    """The text before the first ``${`` of a bare template literal, which all its values begin with;
    null where there is none to rely on: other expressions, a wrapped template, an empty head, or
    one with escapes, backticks or line ends."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    head = F.substring_index(inner, "${", 1)
    bare = (F.length(text) >= 2) & text.startswith("`") & text.endswith("`")
    return F.when(bare & (head != "") & ~head.rlike(r"[\\\\`\r\n]"), head)
