"""Exports of modules, resolved through the modules that pass them on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.storage import materialised

#: Statements whose names a module can use or pass on.
_TAKES = ("import", "require", "dynamic")


def taken_names(imports: DataFrame) -> DataFrame:
    """(file, resolved, kind, name, local): a row for each name that a statement of ``imports``
    (file, resolved, kind, bindings) takes; ``*`` is the module as a whole."""
    known = imports.where("resolved is not null")
    return known.select("file", "resolved", "kind", F.explode("bindings").alias("b")).select("file", "resolved", "kind", "b.name", "b.local")


def resolved_exports(exports: DataFrame, taken: DataFrame) -> DataFrame:
    """(module, name, origin, origin_name): where every name that a module exports is declared.

    ``exports`` (file, name, local) has the names that files export themselves, ``taken`` (of
    ``taken_names``) what they take from others. Names are rewritten along ``export {a as b} from``
    and along an import that is exported on; ``export *`` passes on all names but ``default`` and
    those that the module exports by name. Cycles end, as a round keeps new rows only; one round
    is as deep as one module that passes on. A name that two stars bring from different places
    keeps both, as either may be meant. A module passed on as a whole has the name ``*``.
    """
    through = exports.join(taken.where(F.col("kind").isin(*_TAKES)).select("file", "local", F.col("resolved").alias("source"), F.col("name").alias("source_name")), ["file", "local"])
    listed = taken.where("kind = 're-export' and not (name = '*' and local = '*')")
    explicit = through.select("file", "name", "source", "source_name").unionByName(listed.select("file", F.col("local").alias("name"), F.col("resolved").alias("source"), F.col("name").alias("source_name")))
    explicit = materialised(explicit.distinct())
    own = exports.select("file", "name").join(explicit.select("file", "name"), ["file", "name"], "left_anti")
    named = materialised(own.unionByName(explicit.select("file", "name")).distinct())
    stars = materialised(taken.where("kind = 're-export' and name = '*' and local = '*'").select("file", F.col("resolved").alias("source")).distinct())
    ends = own.select(F.col("file").alias("module"), "name", F.col("file").alias("origin"), F.col("name").alias("origin_name"))
    wholes = explicit.where("source_name = '*'").select(F.col("file").alias("module"), "name", F.col("source").alias("origin"), F.col("source_name").alias("origin_name"))
    fresh = known = materialised(ends.unionByName(wholes).distinct())
    while fresh.limit(1).count():
        from_ = fresh.select(F.col("module").alias("source"), F.col("name").alias("source_name"), "origin", "origin_name")
        renamed = from_.join(explicit, ["source", "source_name"]).select(F.col("file").alias("module"), "name", "origin", "origin_name")
        starred = from_.where("source_name <> 'default'").join(stars, "source").select(F.col("file").alias("module"), F.col("source_name").alias("name"), "origin", "origin_name")
        starred = starred.join(named.select(F.col("file").alias("module"), "name"), ["module", "name"], "left_anti")
        fresh = materialised(renamed.unionByName(starred).distinct().join(known, ["module", "name", "origin", "origin_name"], "left_anti"))
        known = materialised(known.unionByName(fresh))
    return known


def export_uses(resolved: DataFrame, taken: DataFrame) -> DataFrame:
    """(origin, origin_name, file, whole): the files that take an export, however many modules passed it
    on; ``whole``: they take a module that has it as a whole, so it may be used or not."""
    takes = taken.where(F.col("kind").isin(*_TAKES))
    by_name = takes.where("name <> '*'").select("file", F.col("resolved").alias("module"), "name").join(resolved, ["module", "name"])
    whole = takes.where("name = '*'").select("file", F.col("resolved").alias("module")).distinct().join(resolved, "module")
    # A module that is passed on under one name is taken as a whole with that name.
    inside = by_name.where("origin_name = '*'").select("file", F.col("origin").alias("module")).distinct().join(resolved, "module")
    parts = [by_name.where("origin_name <> '*'").withColumn("whole", F.lit(False)), whole.withColumn("whole", F.lit(True)), inside.withColumn("whole", F.lit(True))]
    every = [p.where("file <> origin").select("origin", "origin_name", "file", "whole") for p in parts]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("origin", "origin_name", "file").agg(F.bool_and("whole").alias("whole"))


# Why an export that nothing is seen to use may still be used, the most telling first.
REASONS = (
    ("barrel", "re-exported by another module, which others may import it from"),
    ("dynamic", "its module is imported dynamically, and what is taken from it is not known"),
    ("whole", "its module is imported as a whole, and what is taken from it is not known"),
    ("star", "its module is re-exported as a whole by export *"),
    ("computed", "an import() of a computed path may load any module"),
)


def unused_exports(symbols: DataFrame, refs: DataFrame, imports: DataFrame | None = None, exports: DataFrame | None = None, undiscovered: Sequence[str] = ()) -> DataFrame:
    """Rows of ``symbols`` (exported ones: id, name, file) that nothing uses, with confidence and note.

    Used is what ``refs`` (symbol_id, role, file) refer to by more than a declaration or a re-export,
    and what files import by name, through whatever modules pass it on (if ``imports`` and ``exports``
    are there). A re-export in the file of the declaration is its own export and no sign of anything;
    one elsewhere, a dynamic or computed import, an ``export *`` and programs that are not loaded
    each leave it open whether it is used: such rows are ``partial`` and say why.
    """
    declared = symbols.where("exported")
    left = declared.join(refs.where("role not in ('decl', 'reexport')").select(F.col("symbol_id").alias("id")), "id", "left_anti")
    flags: dict[str, list[DataFrame]] = {name: [] for name, _ in REASONS}
    passed = refs.where("role = 'reexport'").select(F.col("symbol_id").alias("id"), F.col("file").alias("_at"))
    flags["barrel"].append(left.join(passed, "id").where("_at <> file").select("file", "name"))
    computed = False
    if imports is not None:
        at = lambda rows: left.join(rows.select(F.col("resolved").alias("file")).distinct(), "file", "left_semi").select("file", "name")
        here = imports.where("resolved is not null and resolved <> file")
        for name, column in (("dynamic", "dynamic"), ("star", "star_reexport")):
            if column in imports.columns:
                flags[name].append(at(here.where(column)))
        computed = bool(imports.where("kind = 'computed'").limit(1).count()) if "kind" in imports.columns else False
        if exports is not None and "bindings" in imports.columns:
            taken = materialised(taken_names(imports))
            resolved = resolved_exports(exports, taken)
            uses = materialised(export_uses(resolved, taken)).select(F.col("origin").alias("file"), F.col("origin_name").alias("name"), "whole")
            left = left.join(uses.where("not whole").select("file", "name"), ["file", "name"], "left_anti")
            flags["whole"].append(uses.where("whole").select("file", "name"))
            flags["barrel"].append(resolved.where("module <> origin").select(F.col("origin").alias("file"), F.col("origin_name").alias("name")))
    marks = [rows.select("file", "name", F.lit(rank).alias("rank")) for rank, (name, _) in enumerate(REASONS) for rows in flags[name]]
    every = marks[0]
    for rows in marks[1:]:
        every = every.unionByName(rows)
    least = every.groupBy("file", "name").agg(F.min("rank").alias("_rank"))
    notes = F.coalesce(*[F.when(F.col("_rank") == rank, text) for rank, (_, text) in enumerate(REASONS)], F.lit(dict(REASONS)["computed"] if computed else None))
    unseen = F.lit(f"programs that are not loaded may use it: {', '.join(undiscovered[:3])}" if undiscovered else None)
    out = left.join(least, ["file", "name"], "left").withColumn("note", F.coalesce(notes, unseen))
    return out.withColumn("confidence", F.when(F.col("note").isNull(), "certain").otherwise("partial")).select(*symbols.columns, "confidence", "note")
