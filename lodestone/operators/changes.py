"""Change between snapshots, introduced diagnostics, edit conflicts, and plans of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, *state: str) -> DataFrame:
    """(key, change): added, removed or changed; equal rows are left out."""
    b = before.select(key, F.struct(*state).alias("_b"))
    a = after.select(key, F.struct(*state).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")


def racy(files: DataFrame, window_ms: int = 2000) -> DataFrame:
    """Adds ``verdict`` to pairs of fingerprints (old_/new_ size, mtime_ms, old_recorded_ms): what was
    recorded within the clock's grain of its change is a tie that only content can settle."""
    same = (F.col("old_size") == F.col("new_size")) & (F.col("old_mtime_ms") == F.col("new_mtime_ms"))
    close = F.col("old_recorded_ms") - F.col("new_mtime_ms") < window_ms
    return files.withColumn("verdict", F.when(~same, "changed").when(close, "tie").otherwise("same"))


def rollup_fingerprint(files: DataFrame) -> DataFrame:
    """Count and digest of all (path, size, mtime_ms, hash), whatever their order: sums of row hashes,
    so that no task holds the list."""
    row = F.xxhash64("path", "size", "mtime_ms", "hash")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.concat_ws("|", F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)), 256).alias("fingerprint"))


def introduced(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """Diagnostics of ``after`` beyond those of ``before``, as a multiset over the key."""
    return after.select(*key).exceptAll(before.select(*key))


def edit_conflicts(edits: DataFrame, by: str = "file") -> DataFrame:
    """Edits (by, begin, end) that overlap an earlier one of their file: the greatest end of those
    before, in the order of begin and end, reaches over the begin. A bare insertion may share a
    begin with another edit."""
    w = Window.partitionBy(by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("reach", F.max("end").over(w)).where("begin < reach")


def _grown(edits: DataFrame) -> DataFrame:
    """Edits (file, begin, end, text) with where their text stands once all of them are applied."""
    before = Window.partitionBy("file").orderBy("begin", "end", "text").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.length("text") - (F.col("end") - F.col("begin"))
    return edits.withColumn("gain", gain.cast("long")).withColumn("_moved", F.coalesce(F.sum("gain").over(before), F.lit(0))).select(
        "file", "begin", "end", "text", "gain", (F.col("begin") + F.col("_moved")).alias("now"), (F.col("begin") + F.col("_moved") + F.length("text")).alias("now_end")
    )


def composed(first: DataFrame, then: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two plans of edits (file, begin, end, text) as one over the original texts, and what forbids it.

    The places of ``then`` are those of the texts after ``first``; each is moved back by the growth of
    the edits before it, so applying the one plan gives what applying both in turn gives. Where an edit of ``then``
    reaches into text that ``first`` wrote, or a plan overlaps itself, there is no such plan: the
    second frame (file, begin, end, reason) has the conflicts, and the first is empty for all
    files, not for those alone.
    """
    own = [edit_conflicts(p).select("file", "begin", "end", F.lit(r).alias("reason")) for p, r in ((first, "the first plan overlaps itself"), (then, "the second plan overlaps itself"))]
    grown = _grown(first)
    marks = grown.select("file", F.col("now").alias("pos"), F.lit(0).alias("kind"), F.col("now_end").alias("to"), "gain", F.lit(None).cast("string").alias("text"))
    asks = then.select("file", F.col("begin").cast("long").alias("pos"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("to"), F.lit(0).cast("long").alias("gain"), "text")
    # Edits of the first plan in the order of the texts they made; those that end at or before a place count there.
    order = Window.partitionBy("file").orderBy("pos", "kind", "to")
    events = marks.unionByName(asks)
    so_far, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    is_mark = F.col("kind") == 0
    seen = events.withColumns({
        "shift": F.coalesce(F.sum(F.when(is_mark, F.col("gain"))).over(so_far), F.lit(0)),
        "reach": F.max(F.when(is_mark, F.col("to"))).over(so_far), "last": F.max(F.when(is_mark, F.struct("pos", "to", "gain"))).over(so_far),
        "next": F.min(F.when(is_mark, F.struct("pos", "to"))).over(behind),
    }).where(~is_mark)
    # Text that begins where an edit of the first plan began stands before it, unless that wrote nothing.
    beside = (F.col("last.pos") == F.col("pos")) & (F.col("last.to") > F.col("pos"))
    shift = F.col("shift") - F.when(beside, F.col("last.gain")).otherwise(0)
    bare = F.col("to") == F.col("pos")
    into = (F.coalesce(F.col("reach"), F.col("pos")) > F.col("pos")) & ~(beside & bare)
    over = F.coalesce(F.col("next.pos"), F.col("to")) < F.col("to")
    conflicts = seen.where(into | over).select("file", F.col("pos").alias("begin"), F.col("to").alias("end"), F.lit("reaches into text of the first plan").alias("reason"))
    conflicts = conflicts.unionByName(own[0]).unionByName(own[1])
    moved = seen.select("file", (F.col("pos") - shift).alias("begin"), (F.col("to") - shift).alias("end"), "text", F.lit(1).alias("plan"))
    whole = first.select("file", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "text", F.lit(0).alias("plan")).unionByName(moved)
    free = conflicts.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(True).alias("_free"))
    return whole.join(F.broadcast(free)).drop("_free"), conflicts


def rename_plan(refs: DataFrame, symbol_id: str, new_name: str) -> DataFrame:
    """The edits that a rename needs; nothing is written. A reference that is spelled otherwise (column
    ``spelled``, where there is one: an alias) stays, a re-export keeps the name that others know, and
    files of packages are not edited."""
    mine = refs.where((F.col("symbol_id") == symbol_id) & ~F.contains(F.col("file"), F.lit("node_modules/")))
    if "spelled" in refs.columns:
        mine = mine.where(F.coalesce(F.col("spelled") == F.col("symbol"), F.lit(True)))
    text = F.when(F.col("role") == "reexport", F.concat(F.lit(f"{new_name} as "), F.col("symbol"))).otherwise(new_name) if "role" in refs.columns else F.lit(new_name)
    return mine.select("file", F.col("start").alias("begin"), (F.col("start") + F.length("symbol")).alias("end"), text.alias("text"))


def rename_survivors(refs: DataFrame, plan: DataFrame) -> DataFrame:
    """References in files that a plan does not touch and that have the old name (where ``spelled`` tells)."""
    left = refs.join(plan.select("file").distinct(), "file", "left_anti")
    return left.where(F.coalesce(F.col("spelled") == F.col("symbol"), F.lit(True))) if "spelled" in refs.columns else left


def move_plan(imports: DataFrame, source: str, dest: str) -> DataFrame:
    """Imports that a moved file's importers need changed."""
    return imports.where(F.col("resolved") == source).select("file", "line", F.col("spec").alias("before"), F.lit(dest).alias("after"))
