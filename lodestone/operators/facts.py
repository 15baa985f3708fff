"""Questions about types over ingested facts: constructions, discriminations, member uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def constructions(literals: DataFrame, type_id: str) -> DataFrame:
    """Object literals that may be of a type. literals: type_id, assignable, any, generic, any_member
    and the site: any makes it dynamic, what is not assignable is no site, a generic or a member
    of type any makes it partial."""
    confidence = F.when(F.col("any"), "dynamic").when(~F.col("assignable"), None).when(F.col("generic") | F.col("any_member"), "partial").otherwise("certain")
    return literals.where(F.col("type_id") == type_id).withColumn("confidence", confidence).where("confidence is not null")


def discriminations(sites: DataFrame) -> DataFrame:
    """What a switch or if chain covers of its domain. sites: domain and covered (arrays), has_default,
    uniform (every branch compares the same text with a literal)."""
    missing = F.array_except("domain", "covered")
    return (
        sites.withColumn("covers", F.array_join(F.array_sort(F.array_intersect("domain", "covered")), " ")).withColumn("missing", F.array_join(F.array_sort(missing), " "))
        .withColumn("confidence", F.when(F.col("uniform"), "certain").otherwise("partial")).withColumn("has_default", F.col("has_default").cast("long"))
    )


def member_uses(refs: DataFrame, members: list[str]) -> DataFrame:
    """Uses of a member, whose declarations in several arms of a union count as one; a site that
    several programs see counts once."""
    mine = refs.where(F.col("symbol_id").isin(members))
    kind = F.when(F.col("destructures").isNotNull(), "destructure").when(F.col("role") == "write", "write").otherwise("read")
    return mine.withColumn("kind", kind).groupBy("file", "start", "line", "col", "kind").agg(F.min_by("program", "program_rank").alias("program"))


def dispositions(uses: DataFrame) -> DataFrame:
    return uses.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def call_shape(refs: DataFrame) -> DataFrame:
    """What a call's result is taken as: names taken apart (joined), ``*`` for a rest, empty if thrown
    away, null if not a call. refs: role, taken (array or null), has_rest, discarded."""
    names = F.array_join(F.concat("taken", F.when(F.col("has_rest"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))), ",")
    return refs.withColumn("destructures", F.when(F.col("role") != "call", None).when(F.col("discarded"), "").when(F.col("taken").isNull(), "whole").otherwise(names))


def callable_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``callable_natured``: by kind, by flag, or because some reference calls or renders it."""
    used = refs.groupBy(F.col("symbol_id").alias("id")).agg(F.max(F.col("role").isin("call", "jsx")).alias("_called"))
    kinds = ("function", "local function", "method", "class", "constructor")
    return symbols.join(used, "id", "left").withColumn("callable_natured", F.col("kind").isin(*kinds) | F.coalesce("callable", F.lit(False)) | F.coalesce("_called", F.lit(False))).drop("_called")
