"""Offsets and (line, column) of texts, in UTF-16 units as editors and language servers count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.usages import enclosed


def line_index(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, line, begin, end, wide, char) of texts (file, and the text): for each line its first unit and
    the one behind it (its line break included), the surrogate pairs before it, and its first character.
    Lines end at line feeds; a carriage return is a character. An empty text has one empty line."""

    def run(batches):
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["text"]):
                begin = wide = char = 0
                lines = (content or "").split("\n")
                for n, line in enumerate(lines, 1):
                    pairs, last = sum(c > "\uffff" for c in line) if not line.isascii() else 0, n == len(lines)
                    end = begin + len(line) + pairs + (not last)
                    rows.append((file, n, begin, end, wide, char, last))
                    begin, wide, char = end, wide + pairs, char + len(line) + 1
            yield pd.DataFrame(rows, columns=["file", "line", "begin", "end", "wide", "char", "last"])

    return files.select("file", F.col(text).alias("text")).mapInPandas(run, "file string, line long, begin long, end long, wide long, char long, last boolean")


def located(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """(ref_id, file, start, line, col), both from 1, of offsets (ref_id, file, start) from 0. The end of the
    text is a place, anything beyond or before it has none: nulls, never the nearest place."""
    # The last line reaches one unit further, as the end of the text belongs to it.
    spans = lines.select(F.col("line").alias("decl_id"), "file", "begin", (F.col("end") + F.col("last").cast("long")).alias("end"))
    found = enclosed(offsets.select("ref_id", "file", F.col("start").cast("long").alias("start")), spans).withColumnRenamed("encloser_id", "line")
    first = lines.select("file", "line", "begin")
    return found.join(first, ["file", "line"], "left").select("ref_id", "file", "start", "line", (F.col("start") - F.col("begin") + 1).alias("col"))


def offsets_of(places: DataFrame, lines: DataFrame) -> DataFrame:
    """``places`` (file, line, col and any others) with the offset of each; null where there is none. A
    column may be one beyond the last character of its line."""
    inside = (F.col("col") >= 1) & (F.col("begin") + F.col("col") - 1 <= F.col("end"))
    found = places.join(lines.select("file", "line", "begin", "end"), ["file", "line"], "left")
    return found.withColumn("offset", F.when(inside, F.col("begin") + F.col("col") - 1)).select(*places.columns, "offset")
