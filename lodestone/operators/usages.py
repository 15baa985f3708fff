"""Reference sites: filters with their counts, roll-ups by encloser, de-duplication, text overlay.

``refs`` has symbol_id, symbol, file, start, line, col, end_line, end_col, role, program,
program_rank, encloser_id, encloser, encloser_kind, encloser_exported (see FIXTURES.md).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.values import word_regex


def filtered(refs: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the path filter, and one row that says how many it excluded."""
    passes = kept(F.col("file"), include, exclude)
    return refs.where(passes), refs.agg(F.coalesce(F.sum((~passes).cast("long")), F.lit(0)).alias("excluded"))


def role_breakdown(refs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each role, whatever role filter applies elsewhere."""
    return refs.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"))


def collapse(refs: DataFrame, weak: str = "import", by: Sequence[str] = ("symbol_id", "file")) -> DataFrame:
    """Adds ``hidden``: a weak row is hidden where the same symbol has another role in the file."""
    other = F.max((F.col("role") != weak).cast("int")).over(Window.partitionBy(*by))
    return refs.withColumn("hidden", (F.col("role") == weak) & (other == 1))


def first_program(refs: DataFrame, site: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a site, the one of the first program: a min-aggregation, combined before the shuffle."""
    rest = [c for c in refs.columns if c not in site]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return refs.groupBy(*site).agg(first.alias("_first")).select(*site, *[F.col(f"_first.{c}").alias(c) for c in rest])


def merged(refs: DataFrame, site: Sequence[str], what: str, name: str) -> DataFrame:
    """One row a site with the sorted, comma-joined distinct values of a column."""
    return refs.groupBy(*site).agg(F.array_join(F.sort_array(F.collect_set(F.col(what).cast("string"))), ",").alias(name))


def by_encloser(refs: DataFrame, encloser: Sequence[str], kinds: Sequence[str] = (), exported_only: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Sites rolled up to their enclosers: count, roles and programs (sorted, joined), first site.

    kinds and exported_only filter enclosers; rows come without an order, cap() gives one.
    """
    if kinds:
        refs = refs.where(F.col("encloser_kind").isin(list(kinds)))
    if exported_only:
        refs = refs.where("encloser_exported")
    more = [F.array_join(F.sort_array(F.collect_set("program")), ",").alias("programs")] if "program" in refs.columns else []
    more += [F.max(F.col("encloser_exported").cast("int")).cast("long").alias("is_exported")] if "encloser_exported" in refs.columns else []
    more += [F.min(F.struct(*order)).alias("site")] if order else []
    return refs.groupBy(*encloser).agg(F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), *more)


def text_hits(lines: DataFrame, word: str, text: str = "text") -> DataFrame:
    """Lines that have the word, with its number of places; always of confidence ``unresolved``."""
    n = F.regexp_count(F.col(text), F.lit(word_regex(word)))
    return lines.where(F.instr(text, word) > 0).withColumn("hits", n.cast("long")).where("hits > 0").withColumn("confidence", F.lit("unresolved"))


def text_spans(lines: DataFrame, word: str, text: str = "text") -> DataFrame:
    """Each place of the word in a line, as col (from 1) and end_col (exclusive); always of confidence
    ``unresolved``. A line is scanned once, however often it has the word."""
    found = re.compile(word_regex(word))

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [m.start() + 1 for m in found.finditer(x)])

    out = lines.where(F.instr(text, word) > 0).withColumn("col", F.explode(places(text)))
    return out.withColumn("end_col", F.col("col") + len(word)).withColumn("confidence", F.lit("unresolved"))


def text_overlay(hits: DataFrame, refs: DataFrame, same: Sequence[str], overlap: Column | None = None) -> DataFrame:
    """Textual hits that no semantic reference covers. ``overlap`` (over columns of h and r) may
    ask for intersecting spans beside the equal columns, which keep it a hash join."""
    h, r = hits.alias("h"), refs.alias("r")
    on = F.lit(True)
    for c in same:
        on = on & (F.col(f"h.{c}") == F.col(f"r.{c}"))
    return h.join(r, on & overlap if overlap is not None else on, "left_anti")


def _swept(batches):
    """Events sorted by file and place, beginnings of spans (kind 0) before references (1): for each
    reference the least (length, id) among the spans that are open there. What is open is carried from
    batch to batch; a span that has ended leaves once it comes to the top."""
    file, open_ = None, []
    for b in batches:
        out: list[tuple] = []
        for own, pos, kind, end, decl, ref in zip(*(c.to_pylist() for c in b.columns)):
            if own != file:
                file, open_ = own, []
            if kind == 0:
                heapq.heappush(open_, (end - pos, decl, end))
                continue
            while open_ and open_[0][2] <= pos:
                heapq.heappop(open_)
            out.append((ref, own, pos, open_[0][1] if open_ else None))
        if out:
            types = [b.schema.field(i).type for i in (5, 0, 1, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["ref_id", "file", "start", "encloser_id"])


def enclosed(refs: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each reference with the id of the innermost declaration around it (null: the module).

    refs: ref_id, file, start; declarations: decl_id, file, begin, end (exclusive). One sorted pass over each
    file: rows out are the references that went in, whatever the number of declarations around
    them, and a task holds the open declarations of one place only. The shortest one counts, of
    equally long ones that with the least id. Without a file or a start there is no declaration.
    """
    kind = {c: refs.schema[c].dataType for c in ("ref_id", "file", "start")}
    place, decl = kind["start"], declarations.schema["decl_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    spans = declarations.where("file is not null and begin is not null and end is not null and begin < end").select(
        F.col("file").cast(kind["file"]).alias("file"), F.col("begin").cast(place).alias("pos"), F.lit(0).alias("kind"), F.col("end").cast(place).alias("end"), F.col("decl_id"), none(kind["ref_id"]).alias("ref_id")
    )
    asks = refs.select("file", F.col("start").alias("pos"), F.lit(1).alias("kind"), none(place).alias("end"), none(decl).alias("decl_id"), "ref_id")
    events = spans.unionByName(asks).repartition("file").sortWithinPartitions("file", "pos", "kind")
    shape = ", ".join(f"{n} {t.simpleString()}" for n, t in (("ref_id", kind["ref_id"]), ("file", kind["file"]), ("start", place), ("encloser_id", decl)))
    return events.mapInArrow(_swept, shape)
