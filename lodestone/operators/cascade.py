"""Which declaration wins for a style property, and how specific a selector is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = r"-?[A-Za-z_\u0080-￿\\][\w\u0080-￿\\-]*"


def _arguments(text: str, at: int) -> tuple[str, int]:
    """What stands between the bracket at ``at`` and its partner, and where it ends."""
    depth, i = 0, at
    while i < len(text):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        i += 1
        if depth == 0:
            break
    return text[at + 1 : i - 1], i


def _split(text: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def specificity(selector: str) -> tuple[int, int, int]:
    """(ids, classes, types) of one selector. ``:where`` counts nothing; ``:is``, ``:not``, ``:has``
    and ``:matches`` count their most specific argument, ``:global`` and ``:local`` all of theirs."""
    a = b = c = i = 0
    while i < len(selector):
        rest = selector[i:]
        if m := re.match(rf"#{_NAME}", rest):
            a += 1
        elif m := re.match(rf"\.{_NAME}", rest):
            b += 1
        elif rest[0] == "[":
            b += 1
            i = selector.find("]", i) + 1 or len(selector)
            continue
        elif m := re.match(rf"::({_NAME})", rest):
            c += 1
        elif m := re.match(rf":({_NAME})", rest):
            name = m[1].lower()
            i += m.end()
            inner = []
            if selector[i : i + 1] == "(":
                text, i = _arguments(selector, i)
                inner = [specificity(x.strip()) for x in _split(text)]
            if name in ("is", "not", "has", "matches"):
                x = max(inner, default=(0, 0, 0))
                a, b, c = a + x[0], b + x[1], c + x[2]
            elif name in ("global", "local"):
                a, b, c = (v + sum(x[k] for x in inner) for k, v in enumerate((a, b, c)))
            elif name in ("before", "after", "first-line", "first-letter"):
                c += 1
            elif name != "where":
                b += 1
            continue
        elif m := re.match(_NAME, rest):
            c += 1
        else:
            i += 1
            continue
        i += m.end()
    return a, b, c


@F.pandas_udf(T.StructType([T.StructField(x, T.IntegerType()) for x in "abc"]))
def specificity_of(selector: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([specificity(x or "") for x in selector], columns=list("abc"))


def winners(decls: DataFrame, by: list[str], file: str = "file") -> DataFrame:
    """The winning declaration of each property: important first, then (a, b, c), then, within one
    file only, the last. decls: the columns ``by``, value, important, a, b, c, pos and the file.

    Where several files tie at the top no order holds between them: the first file by name is
    reported, with their number in ``tied_files`` and confidence partial.
    """
    rank = F.struct(F.col("important").cast("int").alias("i"), "a", "b", "c")
    last = decls.withColumn("_rank", rank).groupBy(*by, file).agg(F.max(F.struct("_rank", "pos", "value")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    top = last.groupBy(*by).agg(F.max("_best._rank").alias("_top"), F.sum("_n").alias("considered"))
    at_top = last.join(top, by).where(F.col("_best._rank") == F.col("_top"))
    first = at_top.groupBy(*by, "_top", "considered").agg(F.min(F.struct(F.col(file), F.col("_best.value").alias("value"), F.col("_best.pos").alias("pos"))).alias("_w"), F.count(F.lit(1)).alias("tied_files"))
    return first.select(
        *by, F.col("_w.value").alias("value"), F.concat_ws(",", "_top.a", "_top.b", "_top.c").alias("specificity"), F.col(f"_w.{file}").alias("winner_file"),
        F.col("_top.i").cast("long").alias("important"), F.when(F.col("tied_files") > 1, "partial").otherwise("certain").alias("confidence"), "tied_files", "considered",
    )


# What kinds of conditions a selector may put, and how a reason names them.
CONDITIONS = (
    ("descendant", "needs another element around or before it"),
    ("pseudo-class", "holds in a state or place only (a pseudo-class)"),
    ("attribute", "holds with an attribute only"),
    ("negation", "excludes elements by :not()"),
    ("pseudo-element", "styles a pseudo-element and not the element"),
    ("element-type", "holds for one element type only"),
    ("id", "holds for one id only"),
)


def condition_kinds(selector: Column, conditions: Column) -> Column:
    """The kinds of conditions, in the order of CONDITIONS, that a rule puts beside its subject's classes.
    ``conditions``: the compounds before the subject, its pseudo-classes and attributes."""
    old = ("before", "after", "first-line", "first-letter")
    own = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.trim(F.regexp_replace(selector, r"\s*([>+~])\s*", " ")), r"\s+(?![^(\[]*[)\]])"), -1), r"\([^()]*\)", ""), r"\[[^\]]*\]", "")

    def some(test) -> Column:
        return F.exists(F.coalesce(conditions, F.array().cast("array<string>")), test)

    name = lambda x: F.lower(F.regexp_extract(x, r"^:+([\w-]+)", 1))
    is_element = lambda x: x.startswith("::") | (x.startswith(":") & name(x).isin(*old))
    holds = {
        "descendant": some(lambda x: ~x.rlike(r"^[:\[]")),
        "pseudo-class": some(lambda x: x.startswith(":") & ~is_element(x) & ~name(x).isin("not", "global", "local", "is", "where")),
        "attribute": some(lambda x: x.startswith("[")),
        "negation": some(lambda x: name(x) == "not"),
        "pseudo-element": some(is_element),
        "element-type": own.rlike(r"^[A-Za-z][\w-]*"),
        "id": own.rlike(r"#-?[A-Za-z_]"),
    }
    return F.filter(F.array(*[F.when(holds[k], F.lit(k)) for k, _ in CONDITIONS]), lambda x: x.isNotNull())


def explained(decls: DataFrame, rules: DataFrame, css_class: str, owner: str | None = None) -> DataFrame:
    """The winners of a class with all that makes them less than certain, as reasons in ``note``.

    decls: file, rule_ix, prop, value, important, pos, and maybe computed; rules: file, rule_ix,
    selector, a, b, c, subject_classes, and maybe conditions, at_context, global, interpolated. Only a winner that
    applies to every element with the class, in its own sheet and by a plain value, is certain.
    """
    has = lambda frame, name, kind: F.col(name) if name in frame.columns else F.lit(None).cast(kind)
    known = rules.select(
        "file", "rule_ix", "selector", "a", "b", "c", F.array_except("subject_classes", F.array(F.lit(css_class))).alias("extra"), condition_kinds(F.col("selector"), has(rules, "conditions", "array<string>")).alias("kinds"),
        F.coalesce(has(rules, "at_context", "array<string>"), F.array().cast("array<string>")).alias("at"), *[F.coalesce(has(rules, x, "boolean"), F.lit(False)).alias(x) for x in ("global", "interpolated")],
    )
    own = decls.withColumn("computed", F.coalesce(has(decls, "computed", "boolean"), F.lit(False))).select("file", "rule_ix", "prop", "value", "important", "pos", "computed")
    state = F.struct("value", "selector", "extra", "kinds", "at", "global", "interpolated", "computed")
    won = winners(own.join(known, ["file", "rule_ix"]).withColumn("value", state), ["prop"])
    v = F.col("value")
    elsewhere = F.lit(True) if owner is None else F.col("winner_file") != owner
    text = F.create_map(*[F.lit(x) for pair in CONDITIONS for x in pair])
    reasons = F.concat(
        F.array(
            F.when(F.col("tied_files") > 1, F.concat(F.lit("ties with "), (F.col("tied_files") - 1).cast("string"), F.lit(" other modules, whose order is not known"))),
            F.when(v["global"], "reached by :global, so it is no module's own").when(elsewhere, "of another module"),
        ),
        F.transform(v["kinds"], lambda k: F.element_at(text, k)),
        F.array(
            F.when(F.size(v["at"]) > 0, F.concat(F.lit("holds under "), F.array_join(v["at"], " / "), F.lit(" only"))),
            F.when(v["interpolated"], "its selector is computed in part, so its specificity is at least this"),
            F.when(F.size(v["extra"]) > 0, F.concat(F.lit("the element must also have ."), F.array_join(v["extra"], ", ."))),
            F.when(v["computed"], "its value is computed and given as written"),
        ),
    )
    note = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ")
    return won.select(
        "prop", v["value"].alias("value"), "specificity", "winner_file", v["selector"].alias("winner_selector"), "important",
        F.when(note == "", "certain").otherwise("partial").alias("confidence"), F.when(note != "", note).alias("note"),
    )
