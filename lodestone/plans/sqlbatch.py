"""Several producers and one read-only SELECT over them, in a single lazy plan.

Producers are DataFrames registered as views under their aliases, so Catalyst optimises through
them. A statement passes only if its parsed plan consists of query nodes, reads nothing but the
aliases (and its own CTEs), and calls only built-in functions of the allowed groups. What is run
is the text that was parsed, in parentheses behind the aliases, and it is checked once more as such.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.envelope import Envelope, Failure, Truncation, merged_freshness

TABLE_ROWS = 100_000
RESULT_ROWS = 1_000
_ALIAS = re.compile(r"^[a-z_][a-z0-9_]{0,30}$")
#: Groups of built-in functions that compute from their arguments alone; those of the groups that are
#: left out may call Java, read files or tell about the session.
_GROUPS = frozenset(
    "agg_funcs array_funcs binary_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs date_funcs generator_funcs hash_funcs json_funcs "
    "lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split()
)
_NAMED = frozenset(["typeof"])
_NEVER = frozenset(["current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "raise_error", "input_file_name", "input_file_block_start", "input_file_block_length"])
_TABLE_FUNCTIONS = frozenset(["explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"])
#: Nodes of the parsed plan that only read.
_QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Join", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedHaving", "OneRowRelation", "UnresolvedInlineTable", "WithWindowDefinition", "Generate", "LateralJoin", "Offset", "UnresolvedSubqueryColumnAliases",
    "Window", "Pivot", "Unpivot", "LocalRelation", "Tail", "UnresolvedOrdinal", "Sample", "ResolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases",
}


@dataclass
class Request:
    """One producer: a function that gives an Envelope, or a DataFrame, or raises."""

    name: str
    produce: Callable[[], Envelope | DataFrame]
    alias: str | None = None
    tabular: bool = True


@dataclass
class BatchResult:
    """The answer of the statement and the producers' own, in the order of the requests. What was kept in
    memory for them goes with ``release`` or at the end of a ``with`` block."""

    sql: Envelope
    producers: dict[str, Envelope] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def __enter__(self) -> BatchResult:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Refused(ValueError):
    pass


# Words that no alias may be.
RESERVED = frozenset(
    """all alter and anti any array as asc begin between both by case cast check collate column commit constraint create cross current
    current_date current_time current_timestamp default delete desc distinct drop else end escape except exists explain false fetch filter for
    foreign from full grant group grouping having in index inner insert intersect interval into is join lateral leading left like limit merge
    minus natural not null offset on only or order outer over overlaps partition pivot primary references replace right rollback rollup row
    rows select semi set some table tablesample then to trailing transaction trigger true truncate union unique unknown unpivot update user
    using values view when where window with within""".split()
)


def plan_aliases(requests: Sequence[Request]) -> list[str]:
    """Aliases as given, else ``t`` or ``t0``, ``t1`` and on; refused before any producer runs."""
    out = []
    if without := [r.name for r in requests if not r.tabular]:
        raise Refused(f"has no table: {', '.join(without)}")
    for i, r in enumerate(requests):
        alias = r.alias or ("t" if len(requests) == 1 else f"t{i}")
        if not _ALIAS.match(alias) or alias in RESERVED:
            raise Refused(f"alias not allowed: {alias}")
        if alias in out:
            raise Refused(f"alias used twice: {alias}")
        out.append(alias)
    return out


def _iterate(seq):
    if seq is not None:
        it = seq.iterator()
        while it.hasNext():
            yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _walk(node):
    """All nodes of a plan, and all expressions in them, subqueries included."""
    yield node, None
    for children in (node.children(), node.innerChildren()):
        for child in _iterate(children):
            yield from _walk(child)
    for expression in _iterate(node.expressions()):
        yield from _inside(expression)


def _inside(expression):
    yield None, expression
    if _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "TableSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from _walk(expression.plan())
    for child in _iterate(expression.children()):
        yield from _inside(child)


def _parts(names) -> list[str]:
    return [str(x) for x in _iterate(names)]


def _builtin_group(spark: SparkSession, name: str) -> str | None:
    """The group of a built-in function, or None if there is none of that name."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    found = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    return str(found.get().getGroup()) if found.isDefined() else None


def _check_function(spark: SparkSession, names: list[str], table: bool = False) -> None:
    name = names[-1].lower()
    if len(names) != 1 or name in _NEVER or not (name in _TABLE_FUNCTIONS if table else name in _NAMED or _builtin_group(spark, name) in _GROUPS):
        raise Refused(f"function not allowed: {'.'.join(names)}")


def first_line(error: BaseException) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0]


def check_read_only(spark: SparkSession, sql: str, aliases: Sequence[str]) -> None:
    """Raises Refused unless ``sql`` is one SELECT (or WITH) over the aliases. ``${`` is refused even in a
    literal: the session replaces such text by settings, properties and variables of the process
    before it parses a statement."""
    if "${" in sql:
        raise Refused("${ is not allowed, as text would be put in its place; write '$' || '{' for the signs themselves")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the JVM's parse error, whatever its class
        raise Refused("not a single valid statement: " + first_line(getattr(e, "java_exception", None) and Exception(e.java_exception.getMessage()) or e)) from None
    known, ctes, relations = {a.lower() for a in aliases}, set(), []
    for node, expression in _walk(plan):
        if expression is not None:
            kind = _kind(expression)
            if "UnresolvedIdentifier" in kind:
                raise Refused("names are written out, not computed")
            if kind == "UnresolvedFunction":
                _check_function(spark, _parts(expression.nameParts()))
            elif kind == "UnresolvedGenerator":
                _check_function(spark, [str(expression.name().funcName())], True)
            elif kind == "UnresolvedTableValuedFunction":
                _check_function(spark, _parts(expression.name()), True)
            continue
        kind = _kind(node)
        if kind not in _QUERY_NODES and node.nodeName() not in _QUERY_NODES:
            raise Refused(f"not read-only: {node.nodeName()}")
        if kind == "UnresolvedTableValuedFunction":
            _check_function(spark, _parts(node.name()), True)
        elif kind == "UnresolvedWith":
            ctes.update(str(pair._1()).lower() for pair in _iterate(node.cteRelations()))
        elif kind == "UnresolvedRelation":
            relations.append(_parts(node.multipartIdentifier()))
    for r in relations:
        if len(r) != 1 or r[0].lower() not in ctes | known:
            raise Refused(f"no such table: {'.'.join(r)}")
    # A CTE's name is only known inside its own query; beside it the name must mean nothing else.
    for c in ctes - known:
        if spark.catalog.tableExists(f"`{c.replace('`', '``')}`"):
            raise Refused(f"name is taken: {c}")


def _bounded(df: DataFrame, rows: int | None) -> tuple[DataFrame, bool]:
    """The first ``rows`` rows, and whether there are more. A frame within the bound is computed once
    and kept; None: no bound, and nothing is computed."""
    if rows is None:
        return df, False
    kept = df.limit(rows + 1).persist()
    if kept.count() <= rows:
        return kept, False
    kept.unpersist()
    return df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]).limit(rows), True


def run_batch(
    spark: SparkSession, requests: Sequence[Request], sql: str, table_rows: int | None = TABLE_ROWS, result_rows: int | None = RESULT_ROWS, returns: str = "all"
) -> BatchResult:
    """Runs the producers, then ``sql`` over them. Any refused alias, operation without a table or statement
    fails the whole call before a producer runs; a failed producer blocks only the SELECT, whose failure
    names it, and its neighbours stay. ``returns``: ``all``, or ``sql`` for the statement's answer
    alone. Tables that were kept go as soon as the answer is."""
    try:
        if returns not in ("all", "sql"):
            raise Refused(f"returns is all or sql, not {returns}")
        aliases = plan_aliases(requests)
        check_read_only(spark, sql, aliases)
    except Refused as e:
        return BatchResult(Envelope(failure=Failure("bad_args", str(e))))
    made: dict[str, Envelope] = {}
    for alias, r in zip(aliases, requests):
        try:
            got = r.produce()
            made[alias] = got if isinstance(got, Envelope) else Envelope(got)
        except Exception as e:  # noqa: BLE001  a producer's failure is data
            made[alias] = Envelope(failure=Failure("op_threw", f"{r.name}: {first_line(e)}"))
    shown_too = made if returns == "all" else {}
    broken = {a: e.failure for a, e in made.items() if not e.ok}
    if broken:
        return BatchResult(Envelope(failure=Failure("producer_failed", "; ".join(f"{a}: {f.message}" for a, f in broken.items()))), shown_too)
    tables: dict[str, DataFrame] = {}
    bounded, result = [], BatchResult(Envelope(), shown_too)
    for alias, e in made.items():
        tables[alias], over = _bounded(e.df, table_rows)
        if table_rows is not None and not over:
            result.held.append(tables[alias])
        if over or e.truncated:
            bounded.append(alias)
    notes = [n for e in made.values() for n in e.notes]
    if bounded:
        notes.append(f"partial tables: {', '.join(bounded)}; NOT IN over them is not to be trusted")
    out = result.sql = select(spark, tables, sql)
    if out.ok and result_rows is not None:
        kept = out.df.limit(result_rows + 1).persist()
        if kept.count() > result_rows:
            out.truncated = Truncation(result_rows, out.df.count(), "add a LIMIT or aggregate")
        out.df = kept.limit(result_rows) if out.truncated else kept
        result.release()
        result.held.append(kept)
    elif not out.ok:
        result.release()
    out.notes, out.bounded_tables, out.freshness = notes + out.notes, bounded, merged_freshness([e.freshness for e in made.values()])
    return result


def select(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> Envelope:
    """One statement over named frames. The views exist only while it is analysed."""
    names = {alias: f"v_{uuid.uuid4().hex}" for alias in tables}
    heads = ", ".join(f"`{a}` AS (SELECT * FROM {names[a]})" for a in tables)
    # The statement stays as it is, in parentheses behind the aliases; newlines end its comments.
    whole = f"WITH {heads}\n(\n{sql.strip().rstrip(';').rstrip()}\n)"
    try:
        check_read_only(spark, whole, [*tables, *names.values()])
        for alias, df in tables.items():
            df.createOrReplaceTempView(names[alias])
        return Envelope(spark.sql(whole))
    except Refused as e:
        return Envelope(failure=Failure("bad_args", str(e)))
    except PySparkException as e:
        shown = "; ".join(f"{a}({', '.join(d.columns)})" for a, d in tables.items())
        return Envelope(failure=Failure("bad_args", f"{first_line(e)} -- tables: {shown}"))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)
