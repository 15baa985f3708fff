"""Walks whose state is more than a set of nodes: dependents with what is known of each, and hop
chains in which the kind of a node decides whether the walk goes on.

Both go level by level, one join a level; a level is materialised in the shared folder, and only its
size (and, under a cap, the place of the cut) comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.storage import materialised

# Roles that only read or write a value, that run or render it, and that pass it on.
VALUE_ROLES = ("read", "write")
CALL_ROLES = ("call", "jsx")
PASSING_ROLES = ("import", "reexport")


def dependents(refs: DataFrame) -> DataFrame:
    """(src, dst, roles, n, kind): the enclosers of each symbol's references, with the set of their roles.
    refs: symbol_id, encloser_id, role, and maybe encloser_kind. An encloser that only declares the
    symbol is no dependent."""
    kind = F.min("encloser_kind") if "encloser_kind" in refs.columns else F.lit(None).cast("string")
    rolled = refs.where("encloser_id is not null").groupBy(F.col("symbol_id").alias("src"), F.col("encloser_id").alias("dst")).agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n"), kind.alias("kind")
    )
    return rolled.where(F.size(F.array_except("roles", F.array(F.lit("decl")))) > 0)


def _only(roles: Column, names: Sequence[str]) -> Column:
    return (F.size(roles) > 0) & (F.size(F.array_except(roles, F.array(*[F.lit(x) for x in names]))) == 0)


@dataclass
class Walk:
    """``state``: node, depth (0: seeds), roles, parent, n, group_total (dependents before the fan-out cap; null
    if never looked up), expanded, boundary (``nodes`` or ``depth``: left open by that cap), dead_end
    (cannot be looked up, and was reached by more than an import), hub (has more dependents than
    the fan-out cap), reads_as_value (the callable that is only read here)."""

    state: DataFrame
    capped: str | None

    @property
    def nodes(self) -> DataFrame:
        return self.state.where("depth > 0")

    def disclosures(self) -> DataFrame:
        """One row: what keeps the answer from being complete."""
        found = self.state.agg(
            F.count_if(F.col("depth") > 0).alias("nodes"), F.count_if(F.col("boundary").isNotNull()).alias("boundary_nodes"), F.count_if("dead_end").alias("dead_ends"),
            F.count_if("hub").alias("hubs"), F.count_if(F.col("reads_as_value").isNotNull()).alias("value_reads"),
        ).withColumn("capped", F.lit(self.capped).cast("string"))
        return found.withColumn("complete", F.col("capped").isNull() & (F.col("dead_ends") + F.col("hubs") + F.col("value_reads") == 0))


def dependents_walk(groups: DataFrame, seeds: DataFrame, depth: int = 3, nodes: int | None = 200, fan_out: int | None = None, callables: DataFrame | None = None) -> Walk:
    """What depends on ``seeds`` (node), breadth first, each node with the state of ``Walk``.

    ``groups``: of ``dependents``. A node's dependents are taken by number of references, then id, and at
    most ``fan_out`` of them; nodes are looked up in the order in which they were found, so a cap on
    ``nodes`` may cut in the middle of a level: the nodes of that level and those of the level before
    that were not looked up by then are boundary nodes. Modules (kind ``module``) can't be looked up.
    ``callables`` (node): what is called elsewhere; a symbol that some dependent calls or renders counts
    too. Filters belong on the result, never on the walk.
    """
    totals = groups.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("group_total"), F.max(F.arrays_overlap("roles", F.array(*[F.lit(x) for x in CALL_ROLES]))).alias("called"))
    if callables is not None:
        known = callables.select("node").distinct().withColumn("_callable", F.lit(True))
        totals = totals.join(known, "node", "left").withColumn("called", F.col("called") | F.coalesce("_callable", F.lit(False))).drop("_callable")
    totals = materialised(totals)
    if fan_out is not None:
        groups = groups.withColumn("_rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where(F.col("_rank") <= fan_out).drop("_rank")
    groups = materialised(groups)
    none = F.lit(None).cast(seeds.schema["node"].dataType)
    in_order = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.orderBy(*by)) if nodes is not None else F.lit(0))
    start = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("roles"), none.alias("parent"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("kind"), none.alias("reads_as_value"))
    seen = frontier = materialised(in_order(start, "node"))
    have, capped, cut_at, level, width = 0, None, 0, 0, frontier.count()
    while level < depth and width:
        if nodes is not None and have >= nodes:
            capped, cut_at = "nodes", width
            break
        level += 1
        alive = frontier.where("kind is null or kind <> 'module'").select("node", "place").join(totals, "node").select(F.col("node").alias("src"), "place", "called")
        step = alive.join(groups, "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = step.groupBy("dst").agg(F.min(F.struct("place", (-F.col("n")).alias("_n"), "src", "called", "roles", "kind")).alias("_f"))
        value = F.when(F.col("_f.called") & _only(F.col("_f.roles"), VALUE_ROLES), F.col("_f.src"))
        found = materialised(first.select(
            F.col("dst").alias("node"), F.lit(level).alias("depth"), F.col("_f.roles").alias("roles"), F.col("_f.src").alias("parent"), (-F.col("_f._n")).alias("n"), F.col("_f.kind").alias("kind"),
            value.alias("reads_as_value"), F.struct("_f.place", "_f._n").alias("_order"),
        ))
        size = found.count()
        if nodes is not None:
            # At most ``nodes`` rows are ever put in order.
            found = materialised(in_order(found.orderBy("_order", "node").limit(nodes - have), "_order", "node"))
            if have + size >= nodes:
                cut_at = found.agg(F.max("_order.place")).first()[0] or 0
                capped = "nodes" if have + size > nodes or cut_at < width else None
        else:
            found = found.withColumn("place", F.lit(0))
        width = size if nodes is None else min(size, nodes - have)
        have += width
        frontier = found.drop("_order")
        seen = materialised(seen.unionByName(frontier))
        if capped:
            break
    if capped is None and width and level == depth:
        capped = "depth"
    # Left open: the nodes of the last level, and under a cap those of the level before behind the cut.
    open_ = F.lit(False)
    if capped:
        open_ = (F.col("depth") == level) | (F.lit(capped == "nodes") & (F.col("depth") == level - 1) & (F.col("place") > cut_at))
    module = F.coalesce(F.col("kind") == "module", F.lit(False))
    looked_up = F.col("boundary").isNull() & ~module
    out = seen.withColumn("boundary", F.when(open_, F.lit(capped))).join(totals.select("node", "group_total"), "node", "left")
    out = out.withColumns({
        "dead_end": F.col("boundary").isNull() & module & ~_only(F.col("roles"), PASSING_ROLES), "expanded": looked_up,
        "group_total": F.when(looked_up, F.coalesce("group_total", F.lit(0))),
    })
    hub = F.coalesce(F.col("group_total"), F.lit(0)) > (fan_out if fan_out is not None else (1 << 62))
    return Walk(materialised(out.withColumn("hub", hub).select("node", "depth", "roles", "parent", "n", "group_total", "expanded", "boundary", "dead_end", "hub", "reads_as_value")), capped)


@dataclass
class Chain:
    """``hops``: from, relation, to, depth, confidence, note. ``nodes``: node, kind, depth, where reached first. ``notes``:
    node, note: chains that were cut, and dead ends."""

    hops: DataFrame
    nodes: DataFrame
    notes: DataFrame
    truncated: bool


def typed_walk(start: DataFrame, edges: DataFrame, goes_on: Column, relation: Column | str, depth: int = 12, limit: int | None = 50, missing: str | None = "nothing found") -> Chain:
    """Follows ``edges`` from the nodes of ``start`` (node, kind), level by level.

    ``edges``: src, dst, kind (of dst), confidence, and maybe note, go (whether this edge leads on) and order.
    Only nodes for which ``goes_on`` (over node and kind) holds are left again; all others are leaves.
    A node's edges are taken in ``order``, at most ``limit``; an edge is a hop even if its node was
    reached before, but no node is left twice, so cycles end. Nodes at ``depth`` that would lead on, nodes with more
    edges than the limit and, with ``missing``, nodes that lead nowhere are told in notes.
    """
    for name, kind in (("note", "string"), ("go", "boolean"), ("order", "long")):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(True if name == "go" else None).cast(kind))
    edges = edges.where("src <> dst")
    totals = materialised(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("t")))
    if limit is not None:
        edges = edges.withColumn("_rank", F.row_number().over(Window.partitionBy("src").orderBy("order", "dst"))).where(F.col("_rank") <= limit).drop("_rank")
    edges = materialised(edges)
    seen = materialised(start.select("node", "kind").distinct().withColumn("depth", F.lit(0)))
    frontier, hops, notes, truncated = seen, [], [], False
    note = lambda rows, text: rows.select("node", text.alias("note"))
    for level in range(depth + 1):
        open_ = frontier.where(goes_on)
        if level == depth:
            notes.append(note(open_, F.lit(f"not followed: {depth} steps from the start")))
            truncated = truncated or bool(open_.limit(1).count())
            break
        step = materialised(open_.select(F.col("node").alias("src")).join(edges, "src"))
        relate = F.lit(relation) if isinstance(relation, str) else relation
        hops.append(step.select(F.col("src").alias("from"), relate.alias("relation"), F.col("dst").alias("to"), F.lit(level + 1).alias("depth"), "confidence", "note"))
        more = open_.join(totals.where(F.col("t") > (limit if limit is not None else 1 << 62)), "node")
        notes.append(note(more, F.concat(F.lit(f"{limit} of "), F.col("t").cast("string"), F.lit(" are followed"))))
        truncated = truncated or bool(more.limit(1).count())
        if missing is not None:
            notes.append(note(open_.join(step.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), F.lit(missing)))
        fresh = step.where("go").groupBy(F.col("dst").alias("node")).agg(F.min("kind").alias("kind")).join(seen.select("node"), "node", "left_anti")
        frontier = materialised(fresh.withColumn("depth", F.lit(level + 1)))
        seen = materialised(seen.unionByName(frontier))
        if not frontier.limit(1).count():
            break
    return Chain(reduce(DataFrame.unionByName, hops), seen, reduce(DataFrame.unionByName, notes).distinct(), truncated)
