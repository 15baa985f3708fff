"""Things declared and never used: anti-joins with a confidence for each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.values import package_name


def ladder(*steps: tuple[Column, str], otherwise: str = "certain") -> Column:
    """The confidence of the first step whose condition holds."""
    out = F.lit(otherwise)
    for condition, confidence in reversed(steps):
        out = F.when(condition, confidence).otherwise(out)
    return out


def unused(declared: DataFrame, used: DataFrame, on: Sequence[str], *steps: tuple[Column, str]) -> DataFrame:
    """Declared rows without a used row of the same key, each with its confidence."""
    return declared.join(used.select(*on), list(on), "left_anti").withColumn("confidence", ladder(*steps))


def unused_keys(declared: DataFrame, used: DataFrame, dynamic_prefixes: DataFrame, any_dynamic: bool = False) -> DataFrame:
    """Keys (column key) without a usage. A template's head (rows of ``dynamic_prefixes``) demotes
    the keys that begin with it to ``dynamic``; a call without a head to rely on (``any_dynamic``)
    demotes all. Keys meet heads by an equality join on their beginnings, of the lengths that heads
    have, which are a few dozen at most."""
    left = declared.join(used.select("key"), "key", "left_anti")
    heads = dynamic_prefixes.select(F.col("key").alias("_head")).distinct()
    lengths = heads.agg(F.array_sort(F.collect_set(F.length("_head"))).alias("lengths"))
    begun = left.select("key").distinct().join(F.broadcast(lengths)).select("key", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("_n"))
    hit = begun.withColumn("_head", F.substring(F.col("key"), F.lit(1), F.col("_n"))).join(heads, "_head", "left_semi").select("key").distinct().withColumn("_dynamic", F.lit(True))
    return left.join(hit, "key", "left").withColumn("confidence", F.when(F.coalesce("_dynamic", F.lit(False)) | F.lit(any_dynamic), "dynamic").otherwise("certain")).drop("_dynamic")


def missing_keys(usages: DataFrame, locales: DataFrame, defined: DataFrame) -> DataFrame:
    """Used keys (key, and site columns) that a locale does not define, for each locale.

    Locales, a handful of configured files, are put beside each distinct key as an array; the
    definitions are removed by an anti-join on (key, locale).
    """
    names = [r[0] for r in locales.select("locale").distinct().orderBy("locale").collect()]
    wanted = usages.select("key").distinct().withColumn("locale", F.explode(F.array(*[F.lit(n) for n in names]))) if names else usages.select("key").limit(0).withColumn("locale", F.lit(""))
    return usages.join(wanted.join(defined.select("key", "locale"), ["key", "locale"], "left_anti"), "key")


def unused_props(declared: DataFrame, passed: DataFrame, opaque: DataFrame) -> DataFrame:
    """Declared props (component, name) that no site passes; a component with a spread or an
    opaque use (rows of ``opaque``) has all of its findings demoted to partial."""
    found = declared.join(passed.select("component", "name"), ["component", "name"], "left_anti")
    marked = opaque.select("component").distinct().withColumn("_opaque", F.lit(True))
    return found.join(marked, "component", "left").withColumn("confidence", F.when(F.col("_opaque"), "partial").otherwise("certain")).drop("_opaque")


def unused_classes(classes: DataFrame, accesses: DataFrame, composes: DataFrame) -> DataFrame:
    """Style classes (file, name, global, linked, entangled, interpolated) without an access.

    accesses: file, name (null: a computed access, which demotes its sheet); composes: file, name
    of classes that others compose, with file null where the sheet is not resolved (any sheet).
    """
    direct = accesses.where("name is not null").select("file", "name")
    linked = composes.where("file is not null").select("file", "name")
    left = classes.join(direct.unionByName(linked).distinct(), ["file", "name"], "left_anti")
    computed = accesses.where("name is null").select("file").distinct().withColumn("_computed", F.lit(True))
    loose = composes.where("file is null").select("name").distinct().withColumn("_loose", F.lit(True))
    left = left.join(computed, "file", "left").join(loose, "name", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = ((yes("global"), "dynamic"), (yes("_computed"), "dynamic"), (yes("linked") | yes("_loose"), "partial"), (yes("entangled"), "partial"), (yes("interpolated"), "partial"))
    return left.withColumn("confidence", ladder(*steps)).drop("_computed", "_loose")


# Modules that the runtime brings along.
BUILTIN_MODULES = frozenset(
    """assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs fs/promises
    http http2 https inspector inspector/promises module net os path path/posix path/win32 perf_hooks process punycode querystring readline readline/promises repl stream
    stream/consumers stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib""".split()
)


def phantom_deps(imports: DataFrame, manifests: DataFrame, builtins: Sequence[str] = (), aliases: Sequence[str] = ()) -> DataFrame:
    """Packages that a package imports without declaring them, with the number of sites.

    imports: package_dir, package, spec, type_only, file, line, and maybe resolved and dynamic;
    manifests: package_dir, dep. What counts is the package that a specifier addresses, so a
    subpath is declared by its package. Relative, absolute and ``#`` specifiers, own names, built-in
    modules, path aliases, dynamic imports and what resolves outside of node_modules do not count,
    nor does a type-only import whose ``@types`` package is declared.
    """
    spec = F.col("spec")
    bare = imports.where(~spec.rlike(r"^[./#]") & (spec != "") & ~spec.startswith("node:") & ~spec.isin(sorted(BUILTIN_MODULES | set(builtins))))
    if "resolved" in imports.columns:
        bare = bare.where(F.col("resolved").isNull() | F.contains("resolved", F.lit("node_modules/")))
    if "dynamic" in imports.columns:
        bare = bare.where(~F.coalesce("dynamic", F.lit(False)))
    for a in aliases:
        bare = bare.where(~spec.startswith(a))
    bare = bare.withColumn("spec", package_name(spec)).where(~F.col("spec").eqNullSafe(F.col("package")))
    types = F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace("spec", "^@", ""), "/", "__"))
    open_ = bare.withColumn("_types", F.when(F.col("type_only"), types)).join(manifests.select("package_dir", F.col("dep").alias("spec")), ["package_dir", "spec"], "left_anti")
    open_ = open_.join(manifests.select("package_dir", F.col("dep").alias("_types")), ["package_dir", "_types"], "left_anti")
    return open_.groupBy("package_dir", "spec").agg(F.count(F.lit(1)).alias("sites"), F.min(F.struct("file", "line")).alias("first_site"))
