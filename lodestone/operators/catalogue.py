"""Lookups, searches and catalogues over symbols, registries, translations and endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.values import in_segment, match_rank


def capped(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first ``limit`` rows with the true ``total`` beside them."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    cut = df.orderBy(*order).limit(limit) if limit is not None else df
    return cut.join(F.broadcast(total))


def capped_groups(df: DataFrame, by: Sequence[str], limit: int, *order) -> DataFrame:
    """At most ``limit`` rows a group, each with its rank ``n``, and the group's true ``total``."""
    ranked = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= limit)
    return ranked.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), list(by))


def search_symbol(symbols: DataFrame, query: str, kind: str | None = None, exported_only: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Symbols whose name matches, with ``rank`` (see match_rank); real declarations come first."""
    out = symbols.withColumn("rank", match_rank(F.col("name"), query)).where("rank is not null")
    if kind:
        out = out.where(F.col("kind") == kind)
    if exported_only:
        out = out.where("exported")
    return out.where(kept(F.col("file"), include, exclude)) if include or exclude else out


def kind_histogram(symbols: DataFrame) -> DataFrame:
    """How many names have each kind; a name counts in every kind it has."""
    return symbols.groupBy("kind").agg(F.count_distinct("name").alias("names"))


def collisions(symbols: DataFrame) -> DataFrame:
    """Names really declared in two or more files, with their sorted configs."""
    real = symbols.where("real_decl") if "real_decl" in symbols.columns else symbols
    return real.groupBy("name").agg(F.count_distinct("file").alias("files"), F.array_join(F.sort_array(F.collect_set("config")), ",").alias("configs")).where("files >= 2")


def primary_config(files: DataFrame, membership: DataFrame) -> DataFrame:
    """The config of each file: the deepest directory, then ``tsconfig.json`` before others, then by
    name; ``(no tsconfig)`` without any. membership: file, config (a path)."""
    depth = F.size(F.split("config", "/"))
    base = F.element_at(F.split("config", "/"), -1)
    best = membership.groupBy("file").agg(F.min_by("config", F.struct(-depth, (base != "tsconfig.json"), F.col("config"))).alias("config"))
    return files.select("file").distinct().join(best, "file", "left").withColumn("config", F.coalesce("config", F.lit("(no tsconfig)")))


# What a config leaves out unless it says so, and how many configs are taken.
DEFAULT_EXCLUDE = ("node_modules", "bower_components", "jspm_packages")
MAX_CONFIGS = 512


def _head(pattern: Column) -> Column:
    """The directories of a pattern before the first part with a wildcard."""
    parts = F.split(pattern, "/")
    wild = F.array_position(F.transform(parts, lambda x: x.rlike("[*?]")), True)
    return F.array_join(F.slice(parts, F.lit(1), (F.when(wild > 0, wild).otherwise(F.size(parts)) - 1).cast("int")), "/")


def _pattern_regex(pattern: Column) -> Column:
    """``**/`` is any directories, ``*`` and ``?`` stay within a part; a last part without a wildcard or an
    extension is a directory with all below it."""
    last = F.element_at(F.split(pattern, "/"), -1)
    whole = F.when(last.rlike(r"[*?.]"), pattern).otherwise(F.concat(pattern, F.lit("/**/*")))
    out = F.regexp_replace(whole, r"([.+^$(){}|\[\]\\])", r"\\$1")
    for sign, text in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:[^/]+/)*"), ("\x02", ".*")):
        out = F.replace(out, F.lit(sign), F.lit(text))
    return F.concat(F.lit("^(?:"), out, F.lit(")$"))


def config_members(configs: DataFrame, files: DataFrame, max_configs: int = MAX_CONFIGS, max_members: int | None = None) -> tuple[DataFrame, str | None]:
    """(file, config): the TypeScript files that each config includes, and why that is not known, if so.

    configs: config (a path), include, exclude, files (arrays of patterns below its directory, or
    null); files: path. Without include and files a config includes all below its directory. A pattern meets
    files by an equality join on its directories before the first wildcard, and the rest is tested on
    those rows only. Excluded files are left out, but not those that ``files`` names. Over
    ``max_configs`` configs, or ``max_members`` members if a bound is given, nothing is grouped: the frame is
    empty and the reason says so.
    """
    none = configs.select("config").limit(0).select(F.col("config").alias("file"), "config")
    n = configs.limit(max_configs + 1).count()
    if n == 0 or n > max_configs:
        return none, "no config found" if n == 0 else f"too many configs (over {max_configs})"
    folder = F.regexp_replace("config", r"/?[^/]+$", "")
    below = lambda x: F.when(folder == "", x).otherwise(F.concat(folder, F.lit("/"), x))
    plain = lambda x: F.regexp_replace(x, r"^(?:\./)+|/+$", "")
    text = F.array().cast("array<string>")
    given = F.when(F.col("include").isNull() & F.col("files").isNull(), F.array(F.lit("**/*"))).otherwise(F.coalesce("include", text))
    wanted = configs.select("config", F.explode(F.array_union(F.transform(given, lambda x: F.struct(below(plain(x)).alias("p"), F.lit(False).alias("named"))), F.transform(F.coalesce("files", text), lambda x: F.struct(below(plain(x)).alias("p"), F.lit(True).alias("named"))))).alias("x"))
    wanted = wanted.select("config", F.col("x.p").alias("p"), F.col("x.named").alias("named"))
    program = files.select(F.col("path").alias("file")).distinct().where(F.col("file").rlike(r"\.(?:ts|tsx|cts|mts)$") & ~F.col("file").rlike("(?:^|/)node_modules/"))
    as_folder = F.when(F.element_at(F.split("p", "/"), -1).rlike("[*?.]"), _head(F.col("p"))).otherwise(F.col("p"))
    globs = wanted.where("not named").select("config", as_folder.alias("head"), _pattern_regex(F.col("p")).alias("regex"))
    parts = F.split("file", "/")
    above = program.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("head"))
    met = above.join(F.broadcast(globs), "head").where(F.expr("file rlike regex")).select("file", "config").distinct()
    out = F.coalesce("exclude", F.array(*[F.lit(x) for x in DEFAULT_EXCLUDE]))
    barred = configs.select("config", F.explode(F.transform(out, lambda x: _pattern_regex(below(plain(x))))).alias("regex")).groupBy("config").agg(F.array_join(F.collect_list("regex"), "|").alias("barred"))
    met = met.join(F.broadcast(barred), "config", "left").where(F.col("barred").isNull() | ~F.expr("file rlike barred")).select("file", "config")
    named = wanted.where("named").select(F.col("p").alias("file"), "config").join(program, "file", "left_semi")
    members = met.unionByName(named).distinct()
    if max_members is not None and members.limit(max_members + 1).count() > max_members:
        return none, f"too many members (over {max_members})"
    return members, None


def lookup(defs: DataFrame, key: str | None = None, prefix: str | None = None, value: str | None = None, exact: bool = False, locale: str | None = None) -> DataFrame:
    """Translations by key, by key prefix (whole segments) or by value (substring without case)."""
    if sum(x is not None for x in (key, prefix, value)) > 1:
        raise ValueError("give one of key, prefix and value at most")
    test: Column = F.lit(True)
    if key is not None:
        test = F.col("key") == key
    if prefix is not None:
        test = in_segment(F.col("key"), F.lit(prefix))
    if value is not None:
        test = F.col("value") == value if exact else F.contains(F.lower("value"), F.lit(value.lower()))
    return defs.where(test & (F.col("locale") == locale) if locale else test)


def endpoints(cards: DataFrame, path: str | None = None, method: str | None = None) -> DataFrame:
    if path:
        cards = cards.where(F.contains(F.lower("path"), F.lit(path.lower())))
    return cards.where(F.upper("method") == method.upper()) if method else cards


def registry_list(owners: dict[str, DataFrame], name: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[DataFrame | None, list[str]]:
    """The registry's rows, or None and the names there are."""
    found = owners.get(name)
    return (None, sorted(owners)) if found is None else (found.where(kept(F.col("file"), include, exclude)), sorted(owners))


# Conventions of declarations: function_decls has name, returns_jsx, jsx_conf.
def is_component() -> Column:
    return F.col("name").rlike("^[A-Z]") & F.col("returns_jsx")


def is_hook() -> Column:
    return F.col("name").rlike("^use[A-Z]")


def classified(decls: DataFrame) -> DataFrame:
    """component before hook before other, with the confidence of the finding."""
    kind = F.when(is_component(), "component").when(is_hook(), "hook").otherwise("other")
    return decls.withColumn("class", kind).withColumn("confidence", F.when(is_component(), F.col("jsx_conf")).otherwise("certain"))


def dialogs(decls: DataFrame, sites: DataFrame, primitives: Sequence[str]) -> DataFrame:
    """Components that render a dialog primitive; sites: component, element."""
    drawn = sites.where(F.col("element").isin(list(primitives))).groupBy(F.col("component").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("element")), ",").alias("detail"))
    return decls.where(is_component()).join(drawn, "name")


def definitions(symbols: DataFrame, name: str | None = None, symbol_id: str | None = None, file: str | None = None, line: int | None = None) -> DataFrame:
    """Symbols of a target; several rows are the candidates of an ambiguous one."""
    for column, value in (("id", symbol_id), ("name", name), ("file", file), ("line", line)):
        if value is not None:
            symbols = symbols.where(F.col(column) == value)
    return symbols


def sources(targets: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies of targets (name), and the targets that are no symbol."""
    return targets.join(symbols.select("name", "id", "file", "line", "text"), "name"), targets.join(symbols.select("name"), "name", "left_anti")


def expanded(members: DataFrame, type_id: str, limit: int = 40) -> DataFrame:
    """Members of a type: enum members, then arms of a union, then calls, then the rest."""
    order = F.when(F.col("form") == "enum", 0).when(F.col("form").isin("union", "intersection"), 1).when(F.col("form") == "call", 2).otherwise(3)
    return capped(members.where(F.col("type_id") == type_id).withColumn("_o", order), limit, "_o", "position").drop("_o")
