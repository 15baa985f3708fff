"""Named operations over fact tables: each takes checked arguments and gives an Envelope whose rows
have the operation's fixed columns, ready to be aliased in a SQL batch.

Facts are DataFrames by name, with the columns of FIXTURES.md; an operation whose facts are not
there fails as data. ``sql`` runs a batch of operations, of this engine or of several roots.
"""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.values import key_match, template_head
from lodestone.operators import cascade, catalogue, changes, dead, facts as types, graph, modules, usages
from lodestone.plans.envelope import Envelope, Failure, cap_list
from lodestone.plans.intake import normalised, target
from lodestone.plans.sqlbatch import BatchResult, Request, first_line, run_batch

# Kinds of symbols that are called or constructed.
CALLABLE_KINDS = ("function", "local function", "method", "class", "constructor")

# The columns of every operation's table (i: int, others text).
TABLES = {
    "search_symbol": "id name kind container file line:i col:i confidence",
    "find_usages": "symbol file line:i col:i role encloser encloser_id encloser_kind encloser_file is_exported:i count:i confidence provenance ref_file ref_line:i ref_col:i program decls destructures",
    "construction_sites": "file line:i col:i confidence encloser encloser_id encloser_kind encloser_file exported:i note",
    "discrimination_sites": "file line:i col:i kind scrutinee discriminant confidence covers missing has_default:i encloser encloser_id note",
    "member_usages": "file line:i col:i kind encloser encloser_kind program",
    "importers_of": "module file line:i imports scope target confidence",
    "find_unused_exports": "name kind file line:i col:i confidence symbol note",
    "find_unused_props": "name optional:i inherited:i type confidence file line:i col:i",
    "scss_classes": "name file line:i col:i confidence",
    "find_unused_scss_classes": "name file line:i col:i confidence note",
    "css_cascade": "prop value specificity winner_file winner_selector important:i confidence note",
    "i18n_lookup": "key locale file line:i value",
    "find_unused_i18n_keys": "key file line:i confidence",
    "find_missing_i18n_keys": "key locale usage_file usage_line:i",
    "list_endpoints": "method path path_params query body response status:i confidence",
    "list": "key kind name file line:i col:i confidence provenance detail",
    "invalidations_for": "mutation method key broad:i affects confidence",
    "trace": "from relation to to_loc confidence provenance note",
}


def projected(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns in their order; what the rows do not know is null."""
    out = []
    for spec in TABLES[table].split():
        name, _, kind = spec.partition(":")
        as_type = "bigint" if kind else "string"
        out.append((F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(as_type).alias(name))
    return df.select(*out)


# Rows of an answer unless the call says otherwise; producers under SQL have no such limit.
DEFAULT_LIMITS = {"search_symbol": 25, "find_usages": 200, "importers_of": 200, "find_unused_i18n_keys": 200}
#: Operations whose own order a limit keeps; others are cut in the order of their columns.
RANKED = frozenset(["search_symbol"])
_DEFAULT = -1


@dataclass
class Op:
    run: Callable[..., Envelope]
    table: str | None
    needs: tuple[str, ...]


OPS: dict[str, Op] = {}
#: Operations whose answers further programs could add to.
LOWER_BOUNDS = frozenset(["find_usages", "importers_of", "find_unused_exports", "member_usages", "impact", "affected", "construction_sites", "discrimination_sites"])


def op(name: str, *needs: str, table: str | None = None):
    def add(fn):
        OPS[name] = Op(fn, table or (name if name in TABLES else None), needs)
        return fn

    return add


class Engine:
    """Operations over one root's facts. ``undiscovered`` names programs that the facts leave out:
    answers that they could add to are then lower bounds, and say so."""

    def __init__(self, spark: SparkSession, facts: Mapping[str, DataFrame], root: str = ".", undiscovered: Sequence[str] = ()):
        self.spark, self.facts, self.root, self.undiscovered = spark, dict(facts), root, list(undiscovered)

    def __getitem__(self, name: str) -> DataFrame:
        return self.facts[name]

    def _addressed(self, text: str, known: set[str]) -> dict:
        """Arguments of an operation for a target as callers write it: an id, a place or a name."""
        at = target(text)
        if set(at) - {"col"} <= known:
            return {k: v for k, v in at.items() if k in known}
        if "symbols" in known and "name" in at:
            return {"symbols": [at["name"]]}
        if "symbol_id" in at:
            where = F.col("id") == at["symbol_id"]
        elif "name" in at:
            where = F.col("name") == at["name"]
        else:
            where = (F.col("file") == at["file"]) & (F.col("line") == at["line"]) & ((F.col("col") == at["col"]) if "col" in at else F.lit(True))
        found = self.facts["symbols"].where(where).select("id", "name").distinct().orderBy("id").limit(21).collect() if "symbols" in self.facts else []
        if not found and "symbol_id" in at:
            found = [{"id": text, "name": None}]
        if not found:
            raise ValueError(f"no symbol {'named' if 'name' in at else 'at'} {text}")
        for argument, column, several in (("symbols", "name", True), ("symbol_ids", "id", True), ("symbol_id", "id", False), ("type_id", "id", False)):
            if argument in known:
                values = sorted({r[column] for r in found if r[column] is not None})
                if len(values) != 1 and not several:
                    raise ValueError(f"{text} is ambiguous: " + ", ".join(values[:20]))
                return {argument: values if several else values[0]}
        raise ValueError("this operation takes no target")

    def run(self, name: str, /, limit: int | None = _DEFAULT, **args) -> Envelope:
        """One operation. Unknown names, unknown arguments, missing facts and errors are failures as data.

        ``target`` may stand for the arguments that name a symbol: an id, ``file:line[:col]`` or a name.
        Without a ``limit`` that of DEFAULT_LIMITS holds; None: none."""
        if name not in OPS:
            return Envelope(failure=Failure("unknown_op", f"{name}; there are {', '.join(sorted(OPS))}"))
        o = OPS[name]
        known = set(inspect.signature(o.run).parameters) - {"e"}
        taken = normalised(args, own=known)
        args = taken.args
        limit = DEFAULT_LIMITS.get(name) if limit == _DEFAULT else limit
        if gone := [f for f in o.needs if f not in self.facts]:
            return Envelope(failure=Failure("unavailable", f"{name} needs {', '.join(gone)}"))
        if isinstance(args.get("target"), str) and "target" not in known:
            try:
                args = {k: v for k, v in args.items() if k != "target"} | self._addressed(args["target"], known)
            except ValueError as x:
                return Envelope(failure=Failure("bad_args", first_line(x)))
        if extra := set(args) - known:
            return Envelope(failure=Failure("bad_args", f"{name} does not take {', '.join(sorted(extra))}; it takes {', '.join(sorted(known))}"))
        try:
            got = o.run(self, **args)
        except Exception as x:  # noqa: BLE001  an operation's error is data
            return Envelope(failure=Failure("bad_args" if isinstance(x, (ValueError, TypeError)) else "op_threw", first_line(x)))
        got.notes = [*taken.notes, *got.notes]
        if left := [x for x in self.undiscovered if x not in args.get("programs", ())]:
            if got.ok and name in LOWER_BOUNDS:
                got.complete = False
                got.notes.insert(0, f"!! a lower bound: {len(left)} programs are not loaded: {', '.join(left[:5])}")
        if got.ok and o.table:
            got.df = projected(got.df, o.table)
        if got.ok and limit is not None:
            cut = cap_list(got.df, limit, *([] if name in RANKED else [F.col(f"`{c}`") for c in got.df.columns]))
            got.df, got.truncated = cut.df, cut.truncated
        return got

    def sql(self, requests: Sequence[tuple[str, str | None, dict]], sql: str, **bounds) -> BatchResult:
        """A batch of (operation, alias, arguments) and one SELECT. Producers run without their limits."""
        return cross_root_sql([(self, *r) for r in requests], sql, **bounds)

    def status(self) -> DataFrame:
        rows = [(n, o.table is not None, all(f in self.facts for f in o.needs), TABLES.get(o.table or "", "")) for n, o in sorted(OPS.items())]
        return self.spark.createDataFrame(rows, "op string, tabular boolean, available boolean, columns string")


def cross_root_sql(requests: Sequence[tuple[Engine, str, str | None, dict]], sql: str, **bounds) -> BatchResult:
    """Producers of several engines under one SELECT, in one plan. With more than one root each table has
    a last column ``root``."""
    several = len({e.root for e, *_ in requests}) > 1

    def produce(e: Engine, name: str, args: dict):
        def go() -> Envelope:
            got = e.run(name, None, **{k: v for k, v in args.items() if k != "limit"})
            if not got.ok:
                raise ValueError(got.failure.message)
            if several:
                got.df = got.df.withColumn("root", F.lit(e.root))
            return got

        return go

    tabular = lambda n: n not in OPS or OPS[n].table is not None
    return run_batch(requests[0][0].spark, [Request(n, produce(e, n, args), alias, tabular(n)) for e, n, alias, args in requests], sql, **bounds)


def _absent(e: Engine) -> str:
    """What to add where nothing was found but programs are left out."""
    if not e.undiscovered:
        return ""
    more = len(e.undiscovered) - 3
    return f"; it may be declared in programs that are not loaded: {', '.join(e.undiscovered[:3])}" + (f" and {more} more" if more > 0 else "")


def _counted_filter(df: DataFrame, include: Sequence[str], exclude: Sequence[str], notes: list[str]) -> DataFrame:
    """The path filter; what it drops is counted and said."""
    if not include and not exclude:
        return df
    passes = kept(F.col("file"), include, exclude)
    dropped = df.where(~passes).count()
    if dropped:
        notes.append(f"{dropped} rows excluded by the path filter")
    return df.where(passes)


@op("search_symbol", "symbols")
def search_symbol(e, query, kind=None, exported_only=False, include=(), exclude=()):
    notes: list[str] = []
    found = catalogue.search_symbol(e["symbols"], query, kind, exported_only)
    if not found.limit(1).count():
        notes.append(f"no symbol matches {query}" + _absent(e))
        stem = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "")
        named = e["symbols"].where(F.lower(stem) == query.lower()).select("file").distinct()
        if files := [r["file"] for r in named.orderBy("file").limit(3).collect()]:
            more = named.count() - len(files)
            notes.append(f"files have that name: {', '.join(files)}" + (f" and {more} more" if more else "") + "; find_definition takes a file")
    return Envelope(_counted_filter(found, include, exclude, notes).withColumn("confidence", F.lit("certain")).orderBy(~F.coalesce("real_decl", F.lit(True)), "rank", "file", "line"), notes=notes)


@op("find_usages", "refs")
def find_usages(e, symbols, role=None, group_by=None, include=(), exclude=(), collapse_imports=False, merge_declarations=False, kind=None, exported_only=False, text=None, file=None, programs=()):
    """Sites of up to twenty symbols, flat or by encloser; ``text`` adds hits of that word elsewhere.

    ``programs`` adds the references of further programs (facts ``refs_other``) to this call. With a
    ``file``, a name that is no symbol of its own but a member declared there is looked up as that
    member; of several such members the call names them instead of choosing.
    """
    if len(symbols) > 20:
        raise ValueError("at most 20 symbols")
    notes: list[str] = []
    refs = e["refs"]
    if programs and "refs_other" in e.facts:
        refs = refs.unionByName(e["refs_other"].where(F.col("program").isin(list(programs))), allowMissingColumns=True)
    wanted = F.col("symbol").isin(list(symbols))
    known = {r[0] for r in refs.where(wanted).select("symbol").distinct().collect()}
    for s in [s for s in symbols if s not in known]:
        members = []
        if file and "symbols" in e.facts:
            members = e["symbols"].where((F.col("file") == file) & F.col("container").isNotNull() & ((F.col("name") == s) | (F.concat_ws(".", "container", "name") == s))).select("id", "container", "name", "line").orderBy("line").limit(20).collect()
        if len(members) > 1:
            raise ValueError(f"{s} is one of several members of {file}: " + ", ".join(f"{m['container']}.{m['name']} at line {m['line']} ({m['id']})" for m in members))
        if members:
            wanted = wanted | (F.col("symbol_id") == members[0]["id"])
            notes.append(f"{s} is taken as the member {members[0]['container']}.{members[0]['name']}")
        else:
            notes.append(f"not found: {s}")
    rows = refs.where(wanted & (F.col("role") != "jsx-closing"))
    rows = usages.first_program(rows, ["symbol_id", "symbol", "file", "start"], ["program_rank", "program"])
    rows = _counted_filter(rows, include, exclude, notes)
    roles = {r["role"]: r["n"] for r in usages.role_breakdown(rows).collect()}
    notes.append("roles: " + ", ".join(f"{k} {v}" for k, v in sorted(roles.items())))
    if role:
        rows = rows.where(F.col("role") == role)
    elif collapse_imports:
        rows = usages.collapse(rows).where("not hidden")
    if group_by == "enclosing":
        keys = ["symbol", "encloser_id", "encloser", "encloser_kind", "encloser_file"]
        rows = rows.withColumn("encloser_file", F.col("file"))
        out = usages.by_encloser(rows, keys, [kind] if kind else (), exported_only, ["start", "file", "line", "col"])
        out = out.withColumn("role", F.col("roles")).withColumn("program", F.col("programs")).withColumn("ref_file", F.col("site.file")).withColumn("ref_line", F.col("site.line")).withColumn("ref_col", F.col("site.col"))
        return Envelope(out.withColumn("file", F.col("encloser_file")).withColumn("confidence", F.lit("certain")).withColumn("provenance", F.lit("type")), notes=notes)
    if merge_declarations:
        site = ["symbol", "file", "start", "line", "col", "role"]
        ids = rows.groupBy(*site).agg(F.array_join(F.sort_array(F.collect_set("symbol_id")), ",").alias("decls"))
        rows = usages.first_program(rows, site, ["program_rank", "symbol_id"]).join(ids, site)
    out = rows.withColumn("confidence", F.lit("certain")).withColumn("provenance", F.lit("type"))
    if text:
        hits = usages.text_spans(e["text_lines"], text)
        ends = F.when(F.col("end_line") > F.col("line"), F.lit(1 << 30)).otherwise(F.coalesce("end_col", F.col("col") + F.length("symbol")))
        spans = rows.select("file", "line", "col", ends.alias("end_col")) if {"end_line", "end_col"} <= set(rows.columns) else rows.select("file", "line", "col", (F.col("col") + F.length("symbol")).alias("end_col"))
        clear = usages.text_overlay(hits, spans, ["file", "line"], (F.col("h.col") < F.col("r.end_col")) & (F.col("r.col") < F.col("h.end_col")))
        out = out.unionByName(clear.select("file", "line", "col", "confidence").withColumn("symbol", F.lit(text)).withColumn("provenance", F.lit("heuristic:text")), allowMissingColumns=True)
    return Envelope(out, notes=notes)


@op("construction_sites", "object_literals")
def construction_sites(e, target, include=(), exclude=()):
    notes: list[str] = []
    return Envelope(_counted_filter(types.constructions(e["object_literals"], target), include, exclude, notes), notes=notes)


@op("discrimination_sites", "discriminations")
def discrimination_sites(e, target, include=(), exclude=()):
    notes: list[str] = []
    return Envelope(_counted_filter(types.discriminations(e["discriminations"].where(F.col("type_id") == target)), include, exclude, notes), notes=notes)


@op("member_usages", "refs")
def member_usages(e, members):
    return Envelope(types.member_uses(e["refs"], list(members)))


@op("importers_of", "imports")
def importers_of(e, module, subtree=False):
    if subtree:
        rows = graph.subtree_importers(e["imports"], module)
        v = graph.subtree_verdict(rows).first()
        return Envelope(rows.withColumn("module", F.lit(module)).withColumn("target", F.col("resolved")), notes=[f"blockers {v['blockers']}, unconfirmed {v['unconfirmed']}, safe {v['safe']}"])
    known = bool(e["imports"].where(F.col("resolved") == module).limit(1).count())
    rows = graph.importers(e["imports"], module, known)
    return Envelope((rows if "confidence" in rows.columns else rows.withColumn("confidence", F.lit("certain"))).withColumn("module", F.lit(module)).withColumn("target", F.col("resolved")))


@op("find_unused_exports", "symbols", "refs")
def find_unused_exports(e, include=(), exclude=()):
    notes: list[str] = ["entry points appear by design"]
    left = modules.unused_exports(e["symbols"], e["refs"], e.facts.get("imports"), e.facts.get("exports"), e.undiscovered)
    return Envelope(_counted_filter(left.withColumn("symbol", F.col("id")), include, exclude, notes), notes=notes)


@op("find_phantom_deps", "imports", "manifests")
def find_phantom_deps(e, builtins=(), aliases=()):
    return Envelope(dead.phantom_deps(e["imports"], e["manifests"], builtins, aliases))


@op("find_unused_props", "type_members", "jsx_attrs")
def find_unused_props(e, component):
    declared = e["type_members"].where(F.col("component") == component)
    attrs = e["jsx_attrs"].where(F.col("component") == component)
    found = dead.unused_props(declared, attrs.where("attr is not null").select("component", F.col("attr").alias("name")), attrs.where("has_spread or opaque"))
    return Envelope(found, notes=[] if declared.limit(1).count() else [f"no such component: {component}"])


@op("scss_classes", "css_classes")
def scss_classes(e, file=None):
    return Envelope(e["css_classes"].where(F.col("file") == file) if file else e["css_classes"])


@op("find_unused_scss_classes", "css_classes", "css_accesses", "css_composes")
def find_unused_scss_classes(e, include=(), exclude=()):
    notes: list[str] = []
    return Envelope(_counted_filter(dead.unused_classes(e["css_classes"], e["css_accesses"], e["css_composes"]), include, exclude, notes), notes=notes)


@op("css_cascade", "css_rules", "css_decls")
def css_cascade(e, css_class, file=None, include=(), exclude=()):
    """The winning declaration of each property of a class. ``file``: the sheet that owns the class (without
    it, the only sheet that has it); classes of one name in other sheets are other classes."""
    notes: list[str] = []
    rules = _counted_filter(e["css_rules"].where(F.array_contains("subject_classes", css_class)), include, exclude, notes)
    sheets = [r[0] for r in rules.select("file").distinct().limit(2).collect()]
    owner = file or (sheets[0] if len(sheets) == 1 else None)
    if not sheets:
        notes.append(f"no rule has .{css_class} as its subject")
    elif owner is None:
        notes.append("several sheets have rules for this class and no owning one is given: all of them count as other modules")
    if [s for s in sheets if s != owner]:
        notes.append("rules of other modules are named by syntax alone: there the name is that of another class, unless composed, global or put on the same element")
    return Envelope(cascade.explained(e["css_decls"], rules, css_class, owner), notes=notes)


@op("i18n_lookup", "locale_keys")
def i18n_lookup(e, key=None, prefix=None, value=None, exact=False, locale=None):
    return Envelope(catalogue.lookup(e["locale_keys"], key, prefix, value, exact, locale))


@op("find_unused_i18n_keys", "locale_keys", "literal_calls")
def find_unused_i18n_keys(e, prefix=None, include=(), exclude=(), partials="list"):
    notes: list[str] = []
    keys = catalogue.lookup(e["locale_keys"], prefix=prefix) if prefix else e["locale_keys"]
    calls = e["literal_calls"]
    dynamic = calls.where("dynamic").select(template_head(F.col("text")).alias("key"))
    headless = bool(dynamic.where("key is null").limit(1).count())
    found = dead.unused_keys(keys, calls.where("not dynamic").select(F.col("arg").alias("key")), dynamic.where("key is not null"), headless)
    if partials == "hide":
        found = found.where("confidence = 'certain'")
    return Envelope(_counted_filter(found, include, exclude, notes), notes=notes)


@op("find_missing_i18n_keys", "locale_keys", "literal_calls")
def find_missing_i18n_keys(e):
    locales = e["locale_keys"].select("locale").distinct()
    if "locale_failures" in e.facts:
        locales = locales.join(e["locale_failures"].select("locale"), "locale", "left_anti")
    used = e["literal_calls"].where("not dynamic").select(F.col("arg").alias("key"), F.col("file").alias("usage_file"), F.col("line").alias("usage_line"))
    n = e["literal_calls"].where("dynamic").count()
    return Envelope(dead.missing_keys(used, locales, e["locale_keys"]), notes=[f"{n} dynamic usages are not checked"] if n else [])


@op("list_endpoints", "endpoints")
def list_endpoints(e, path=None, method=None):
    return Envelope(catalogue.endpoints(e["endpoints"].withColumn("path_params", F.array_join("path_params", ",")), path, method))


@op("list", "function_decls")
def list_registry(e, registry, include=(), exclude=()):
    decls = catalogue.classified(e["function_decls"]).withColumn("key", F.col("name")).withColumn("provenance", F.lit("heuristic:react"))
    owners = {"components": decls.where("class = 'component'"), "hooks": decls.where("class = 'hook'")}
    if "jsx_sites" in e.facts:
        owners["dialogs"] = catalogue.dialogs(decls, e["jsx_sites"], ("Dialog", "Modal", "Drawer", "Popover", "AlertDialog", "Sheet"))
    for name, fact in (("queries", "rq_queries"), ("mutations", "rq_mutations")):
        if fact in e.facts:
            owners[name] = e[fact].withColumn("key", F.col("name")).withColumn("provenance", F.lit("heuristic:react-query"))
    found, available = catalogue.registry_list(owners, registry, include, exclude)
    if found is None:
        return Envelope(e["function_decls"].limit(0), notes=[f"no registry {registry}; there are {', '.join(available)}"])
    return Envelope(found.withColumn("kind", F.lit(registry)))


@op("invalidations_for", "rq_edges", "rq_queries")
def invalidations_for(e, mutation):
    """A row for each query that an invalidation affects, or one with a null where it affects none."""
    edges = e["rq_edges"].where(F.col("mutation") == mutation).withColumn("_edge", F.monotonically_increasing_id())
    match = key_match(F.col("segments"), F.col("q_segments"), F.col("is_exact"), F.col("is_all"), F.col("narrowed"))
    queries = e["rq_queries"].select(F.col("name").alias("affects"), F.col("segments").alias("q_segments"))
    # Joined on the first segment where both sides have a plain one; the few open keys meet all queries.
    first = lambda c: F.when(F.get(c, F.lit(0))["kind"] == "static", F.get(c, F.lit(0))["value"])
    edges, queries = edges.withColumn("_a", first(F.col("segments"))), queries.withColumn("_b", first(F.col("q_segments")))
    open_ = edges.where("_a is null or is_all")  # of one mutation, so a handful
    open_ = F.broadcast(open_) if open_.limit(1001).count() <= 1000 else open_
    near = edges.where("_a is not null and not is_all").join(queries, F.col("_a") == F.col("_b")).unionByName(open_.join(queries, F.lit(True))).unionByName(edges.where("_a is not null and not is_all").join(queries.where("_b is null"), F.lit(True)))
    hit = near.withColumn("confidence", match).where("confidence is not null").select("_edge", "affects", "confidence")
    shown = F.array_join(F.transform("segments", lambda s: F.coalesce(s["value"], F.lit("*"))), ".")
    return Envelope(edges.join(hit, "_edge", "left").withColumn("key", shown).withColumn("broad", F.col("is_all").cast("long")))


@op("find_definition", "symbols")
def find_definition(e, name=None, symbol_id=None, file=None, line=None):
    return Envelope(catalogue.definitions(e["symbols"], name, symbol_id, file, line))


@op("source", "symbols")
def source(e, targets):
    found, gone = catalogue.sources(e.spark.createDataFrame([(t,) for t in targets], "name string"), e["symbols"])
    return Envelope(found, notes=[f"unresolved: {r[0]}" for r in gone.collect()])


@op("expand_type", "type_members")
def expand_type(e, type_id, member_limit=40):
    return Envelope(catalogue.expanded(e["type_members"], type_id, min(member_limit, 200)))


@op("symbols_overview", "symbols")
def symbols_overview(e, kinds=(), query=None, duplicates_only=False, exported_only=True, cap=300, include=(), exclude=()):
    """Names by config, at most ``cap`` a group; or the names declared in several files."""
    notes: list[str] = []
    s = e["symbols"].where("exported") if exported_only else e["symbols"]
    s = s.where(F.col("kind").isin(list(kinds))) if kinds else s
    s = s.where(F.contains(F.lower("name"), F.lit(query.lower()))) if query else s
    s = _counted_filter(s, include, exclude, notes)
    notes += [f"{r['kind']}: {r['names']}" for r in catalogue.kind_histogram(s).orderBy(F.desc("names"), "kind").collect()]
    if duplicates_only:
        return Envelope(catalogue.collisions(s), notes=notes)
    return Envelope(catalogue.capped_groups(s.select("config", "name").distinct(), ["config"], cap, "name"), notes=notes)


def _closed(c: graph.Closure, df: DataFrame) -> Envelope:
    notes = [f"depth {r['depth']}: {r['n']}" for r in graph.by_depth(c.nodes).orderBy("depth").collect()]
    return Envelope(df, notes=[*notes, "complete" if c.capped is None else f"incomplete: capped by {c.capped}"])


@op("impact", "refs")
def impact(e, symbol_ids, depth=3, nodes=200, kind=None, exported_only=False, include=(), exclude=()):
    """Dependents by depth. The filters are a view: what they hide was walked through, and is counted."""
    callables = None
    if "symbols" in e.facts and "callable" in e["symbols"].columns:
        callables = e["symbols"].where(F.col("callable") | F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("node"))
    nodes = min(nodes, 2000)
    walk = graph.impact(e["refs"], e.spark.createDataFrame([(s,) for s in symbol_ids], "node string"), min(depth, 12), nodes, nodes, callables)
    told = walk.disclosures().first()
    notes = [f"depth {r['depth']}: {r['n']}" for r in graph.by_depth(walk.nodes).orderBy("depth").collect()]
    if walk.capped:
        notes.append(f"!! incomplete: capped by {walk.capped}, {told['boundary_nodes']} nodes are not looked up")
    if told["hubs"]:
        notes.append(f"!! {told['hubs']} nodes have more direct dependents than are followed ({nodes})")
    if told["dead_ends"]:
        notes.append(f"!! {told['dead_ends']} modules run or read a dependent at their top level and can't be looked up; what depends on them is not here")
    if told["value_reads"]:
        notes.append(f"partial: {told['value_reads']} dependents read a callable as a value (reads_as_value); calls through it are not followed")
    if told["complete"]:
        notes.append("complete")
    out = walk.nodes
    if kind or exported_only or include or exclude:
        known = e["refs"].where("encloser_id is not null").groupBy(F.col("encloser_id").alias("node")).agg(
            F.min("encloser_kind").alias("_kind"), F.max("encloser_exported").alias("_exported"), F.min("file").alias("file")
        )
        out = out.join(known, "node", "left")
        shown = F.lit(True) if kind is None else F.coalesce(F.col("_kind") == kind, F.lit(False))
        shown = shown & (F.coalesce("_exported", F.lit(False)) if exported_only else F.lit(True))
        shown = shown & (kept(F.col("file"), include, exclude) if include or exclude else F.lit(True))
        out = out.where(shown).drop("_kind", "_exported")
        notes.append(f"{told['nodes'] - out.count()} of {told['nodes']} dependents are hidden by the filter; the walk is not")
    got = Envelope(out, notes=notes)
    got.complete = told["complete"]
    return got


# Endings of files that take part in imports.
PROGRAM_FILES = r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$"


@op("affected", "imports")
def affected(e, files, depth=25, nodes=1000, test_globs=graph.TEST_GLOBS, deleted=()):
    """Tests of the changed files. What can't be followed makes the answer a lower bound, and is named."""
    changed = e.spark.createDataFrame([(f,) for f in files], "file string")
    gone = e.spark.createDataFrame([(f,) for f in deleted], "file string") if deleted else None
    tests, c = graph.affected_tests(e["imports"], changed, test_globs, gone, min(depth, 50), min(nodes, 5000))
    outside = sorted(r["file"] for r in changed.where(~F.col("file").rlike(PROGRAM_FILES)).collect())
    lazy = 0
    if "dynamic" in e["imports"].columns:
        reached = c.nodes.select("node").unionByName(changed.select(F.col("file").alias("node"))).distinct()
        lazy = e["imports"].where("dynamic and resolved is null").limit(1).count() if not reached.isEmpty() else 0
    notes = [f"depth {r['depth']}: {r['n']}" for r in graph.by_depth(c.nodes).orderBy("depth").collect()]
    if c.capped:
        notes.append(f"!! a lower bound: capped by {c.capped}, at least {c.frontier_left} files are not followed; run all tests")
    for given, why in ((sorted(deleted), "are deleted, so what imported them can't be followed"), (outside, "take no part in imports (other kinds of files)")):
        if given:
            notes.append(f"!! a lower bound: {len(given)} changed files {why}: {', '.join(given[:5])}" + (f" and {len(given) - 5} more" if len(given) > 5 else ""))
    if lazy:
        notes.append("imports of computed paths are not followed")
    notes.append(f"tests are told by their paths: {', '.join(test_globs)}")
    got = Envelope(tests, notes=notes)
    got.complete = c.capped is None and not deleted and not outside and not e.undiscovered
    notes.append("complete" if got.complete else "incomplete")
    return got


@op("impact_type_error", "diagnostics", "diagnostics_after")
def impact_type_error(e):
    """Diagnostics that an edit introduces, as a multiset over file, line and message."""
    return Envelope(changes.introduced(e["diagnostics"], e["diagnostics_after"], "file", "line", "message"))


@op("trace_invalidation", "rq_edges", "rq_affects", "rq_hosts", "mounts", table="trace")
def trace_invalidation(e, mutation, depth=12, usages=50):
    """With the fact ``hook_uses`` (host, user, kind) hooks are followed to the components that use them."""
    edges = e["rq_edges"].where(F.col("mutation") == mutation)
    found, notes, cut = graph.invalidation_trace(edges, e["rq_affects"], e["rq_hosts"], e["mounts"], e.facts.get("hook_uses"), depth, usages)
    told = [f"{r['node']}: {r['note']}" for r in notes.orderBy("node", "note").limit(51).collect()]
    got = Envelope(found, notes=told[:50] + ["and more"] * (len(told) > 50))
    got.complete = not cut
    return got


@op("trace_prop_through_tree", "prop_passes", table="trace")
def trace_prop_through_tree(e, component, prop, depth=12, nodes=300):
    chain = graph.prop_trace(e["prop_passes"], e.spark.createDataFrame([(component, prop)], "component string, prop string"), depth, nodes)
    notes = [f"{r['node']}: {r['note']}" for r in chain.notes.orderBy("node", "note").limit(50).collect()]
    got = Envelope(chain.hops, notes=[*notes, "incomplete: capped" if chain.truncated else "complete"])
    got.complete = not chain.truncated
    return got


@op("trace_field_to_render", "field_reads", table="trace")
def trace_field_to_render(e, field):
    rows = graph.trace_field(e["field_reads"].where(F.col("field") == field))
    return Envelope(rows.select(F.col("field").alias("from"), "relation", F.col("site").alias("to"), "confidence"))


@op("trace_type_widening", "flow_edges", table="trace")
def trace_type_widening(e, node, depth=16, nodes=200):
    rows, c = graph.trace_widening(e["flow_edges"], e.spark.createDataFrame([(node,)], "node string"), depth, nodes)
    return _closed(c, rows.select(F.col("src").alias("from"), "relation", F.col("dst").alias("to"), "confidence", F.concat_ws(": ", "verdict", "note").alias("note")))


@op("rename_symbol", "refs")
def rename_symbol(e, symbol_id, new_name):
    """The edits of a rename, as rows; nothing is written. What keeps the old name is said."""
    plan = changes.rename_plan(e["refs"], symbol_id, new_name)
    over = changes.edit_conflicts(plan).count()
    notes = [f"{over} edits overlap"] if over else []
    aliases = plan.where(F.contains("text", F.lit(" as "))).count()
    left = changes.rename_survivors(e["refs"].where(F.col("symbol_id") == symbol_id), plan)
    names = sorted(r["file"] for r in left.select("file").distinct().limit(4).collect())
    if aliases or names:
        notes.append(f"the old name stays: {aliases} re-exports keep it as an alias" + (f", {left.count()} references in files that are not edited have it: {', '.join(names[:3])}" if names else ""))
    return Envelope(plan, notes=notes)


@op("move_file", "imports")
def move_file(e, source, dest):
    return Envelope(changes.move_plan(e["imports"], source, dest))


@op("feedback")
def feedback(e, path, kind, title, detail="", example=""):
    """Appends one section to an inbox file on the driver."""
    if len(detail) > 4000:
        raise ValueError("detail has at most 4000 characters")
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"\n## {dt.datetime.now(dt.timezone.utc).isoformat()} {kind}: {title}\n\nroot: {e.root}\n\n{detail}\n" + (f"\n```\n{example}\n```\n" if example else ""))
    return Envelope(e.spark.createDataFrame([(kind, title)], "kind string, title string"))


def constant_columns(df: DataFrame) -> dict[str, object]:
    """Columns that have one value in all rows, for a renderer to put in the head."""
    stats = df.agg(*[F.struct(F.count_distinct(F.col(f"`{c}`")).alias("n"), F.min(F.col(f"`{c}`")).alias("v"), F.count_if(F.col(f"`{c}`").isNull()).alias("z")).alias(c) for c in df.columns]).first()
    return {c: stats[c]["v"] for c in df.columns if stats[c]["n"] == 1 and stats[c]["z"] == 0}


def dominant(df: DataFrame, column: str, seq: Column) -> DataFrame:
    """The most frequent value of a column, the first seen of several."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "_first", F.col(column).alias("v"))).alias("b")).where("b is not null")
    return best.select(F.col("b.v").alias(column), (-F.col("b.m")).alias("n"))
