"""Graph questions: bounded closures, importers, traces, hop tables, topological order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.storage import materialised
from lodestone.operators.walks import Chain, Walk, dependents, dependents_walk, typed_walk


@dataclass
class Closure:
    """Nodes (node, depth) without the seeds, what cut the walk short, if anything, and how many nodes of
    the next or the cut level are known to be left out."""

    nodes: DataFrame
    capped: str | None
    frontier_left: int


def closure(edges: DataFrame, seeds: DataFrame, depth: int, nodes: int | None = None) -> Closure:
    """Nodes that ``edges`` (src, dst) reach from ``seeds`` (node) within ``depth`` steps.

    One join a level; each level is checkpointed, and only its size comes to the driver. Seeds are
    never reported, a node has its least depth. With a cap of ``nodes``, the last level is cut in
    the order of node. A filter is a view on the result and never narrows the walk.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = materialised(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, have, capped, left = seen, 0, None, 0
    for level in range(1, depth + 2):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if level > depth:
            left = step.count()
            capped = "depth" if left else capped
            break
        frontier = materialised(step.withColumn("depth", F.lit(level)))
        size = frontier.count()
        if nodes is not None and have + size > nodes:
            capped, left = "nodes", have + size - nodes
            frontier, size = materialised(frontier.orderBy("node").limit(nodes - have)), nodes - have
        have += size
        seen = materialised(seen.unionByName(frontier)) if level % 4 == 0 else seen.unionByName(frontier)
        if not size or capped:
            break
    return Closure(seen.where("depth > 0"), capped, left)


def by_depth(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def impact(refs: DataFrame, seeds: DataFrame, depth: int = 3, nodes: int | None = 200, fan_out: int | None = None, callables: DataFrame | None = None) -> Walk:
    """What depends on the seeds: enclosers of references to them, then of references to those.
    refs: symbol_id, encloser_id, role, and maybe encloser_kind; pure declarations are no dependence."""
    return dependents_walk(dependents(refs), seeds, depth, nodes, fan_out, callables)


# Names of test files.
TEST_GLOBS = ("**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/__tests__/**", "**/test/**", "**/tests/**", "**/e2e/**", "**/*.e2e.*", "**/*.cy.*", "**/cypress/**", "**/*.stories.test.*")


def affected_tests(imports: DataFrame, changed: DataFrame, test_globs: Sequence[str] = TEST_GLOBS, deleted: DataFrame | None = None, depth: int = 25, nodes: int = 1000) -> tuple[DataFrame, Closure]:
    """Tests (file, depth) that import a changed file, directly or not, or are changed themselves;
    deleted files are no tests. imports: file, resolved."""
    edges = imports.where("resolved is not null").select(F.col("resolved").alias("src"), F.col("file").alias("dst"))
    found = closure(edges, changed.select(F.col("file").alias("node")), depth, nodes)
    every = found.nodes.select(F.col("node").alias("file"), "depth").unionByName(changed.select("file").distinct().withColumn("depth", F.lit(0)))
    tests = every.where(kept(F.col("file"), list(test_globs)))
    return (tests.join(deleted.select("file"), "file", "left_anti") if deleted is not None else tests), found


def importers(imports: DataFrame, module: str, resolved: bool = True) -> DataFrame:
    """Files that import a module, by resolved path; by the written one only if it resolves nowhere."""
    return imports.where(F.col("resolved") == module) if resolved else imports.where((F.col("spec") == module) & F.col("resolved").isNull()).withColumn("confidence", F.lit("unresolved"))


def subtree_importers(imports: DataFrame, prefix: str) -> DataFrame:
    """Imports of anything under a directory, each external (a blocker for moving it), internal, or
    unconfirmed (resolved nowhere, but written so)."""
    under = lambda c: F.col(c).startswith(prefix.rstrip("/") + "/")
    scope = F.when(F.col("resolved").isNull(), "unconfirmed").when(under("file"), "internal").otherwise("external")
    return imports.where(under("resolved") | (F.col("resolved").isNull() & F.contains(F.col("spec"), F.lit(prefix)))).withColumn("scope", scope)


def subtree_verdict(rows: DataFrame, complete: bool = True) -> DataFrame:
    """blockers: distinct external files over all rows; safe only if none is left open."""
    found = rows.agg(F.count_distinct(F.when(F.col("scope") == "external", F.col("file"))).alias("blockers"), F.count_if(F.col("scope") == "unconfirmed").alias("unconfirmed"))
    return found.withColumn("safe", (F.col("blockers") == 0) & (F.col("unconfirmed") == 0) & F.lit(complete))


HOPS = ("from", "relation", "to", "to_loc", "confidence", "provenance", "note")


def hops(*parts: DataFrame) -> DataFrame:
    """Hop tables (the columns HOPS and seq) in one, the first of each (from, relation, to) kept."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("from", "relation", "to", "seq")]
    first = F.min(F.struct("seq", *rest)).alias("_f")
    return every.groupBy("from", "relation", "to").agg(first).select("from", "relation", "to", *[F.col(f"_f.{c}").alias(c) for c in rest])


def trace_invalidation(edges: DataFrame, affects: DataFrame, hosts: DataFrame, mounts: DataFrame, uses: DataFrame | None = None, depth: int = 12, limit: int = 50) -> DataFrame:
    return invalidation_trace(edges, affects, hosts, mounts, uses, depth, limit)[0]


def invalidation_trace(edges: DataFrame, affects: DataFrame, hosts: DataFrame, mounts: DataFrame, uses: DataFrame | None = None, depth: int = 12, limit: int = 50) -> tuple[DataFrame, DataFrame, bool]:
    """mutation -invalidates-> key -affects-> query -in-> host; a component is mounted-at its sites, a
    hook is used-by others, which are components or hooks again, and so on until components.

    edges: mutation, key, confidence; affects: key, query, confidence; hosts: query, host, kind
    (component, hook, or what is neither and leads no further); mounts: host, site; uses: host (a hook),
    user, kind, and maybe order, at most ``limit`` for each hook. Without ``uses`` the mounts of a
    hook are its users. Sites are places, not hosts: what renders anew are the components. Gives the
    hops, notes (node, note: cut chains, hooks without users, components without mounts, hosts that are
    neither) and whether anything was cut.
    """
    def hop(df, a, relation, b, seq, confidence="certain", provenance="heuristic:react-query"):
        return df.select(F.col(a).alias("from"), F.lit(relation).alias("relation"), F.col(b).alias("to"), F.lit(None).cast("string").alias("to_loc"), (F.col("confidence") if confidence is None else F.lit(confidence)).alias("confidence"), F.lit(provenance).alias("provenance"), F.lit(None).cast("string").alias("note"), F.lit(seq).alias("seq"))

    reached = edges.select("mutation", "key").join(affects.select("key", "query").distinct(), "key").select("query").distinct()
    mine = hosts.join(reached, "query", "left_semi")
    head = [hop(edges, "mutation", "invalidates", "key", 0, None), hop(affects.join(edges.select("key"), "key", "left_semi"), "key", "affects", "query", 1, None), hop(mine, "query", "in", "host", 2)]
    if uses is None:
        ends = mounts.join(mine.select("host", "kind").distinct(), "host")
        found = hops(*head, hop(ends.where("kind = 'component'"), "host", "mounted-at", "site", 3), hop(ends.where("kind <> 'component'"), "host", "used-by", "site", 3))
        return found, mine.limit(0).select(F.col("host").alias("node"), F.lit("").alias("note")), False
    flow = uses.select(F.col("host").alias("src"), F.col("user").alias("dst"), "kind", F.lit("certain").alias("confidence"), *[c for c in ("order",) if c in uses.columns])
    chain = typed_walk(mine.select(F.col("host").alias("node"), "kind"), flow, F.col("kind") == "hook", "used-by", depth, limit, "no users found")
    used = chain.hops.select("from", "relation", "to", "confidence", (F.col("depth") + 2).alias("seq")).withColumns({"to_loc": F.lit(None).cast("string"), "provenance": F.lit("type"), "note": F.lit(None).cast("string")})
    shown = chain.nodes.where("kind = 'component'").select(F.col("node").alias("host"))
    placed = mounts.join(shown, "host", "left_semi")
    found = hops(*head, used, hop(placed, "host", "mounted-at", "site", 1000, provenance="syntactic"))
    bare = shown.join(mounts.select("host"), "host", "left_anti").select(F.col("host").alias("node"), F.lit("no static mount site").alias("note"))
    neither = chain.nodes.where("kind not in ('component', 'hook')").select("node", F.lit("neither a component nor a hook").alias("note"))
    return found, chain.notes.unionByName(bare).unionByName(neither), chain.truncated


def prop_trace(passes: DataFrame, seed: DataFrame, depth: int = 12, limit: int | None = 300) -> Chain:
    """A prop through the component tree. passes: component, prop, child, child_prop, how (explicit,
    renamed, spread, derived), and maybe child_kind (what is no component is a sink). Of several ways
    into one child the plainest counts: under one name, under another, by a spread, in an expression.
    A spread or derived pass is a hop that leads no further, as the prop's name or value is not known
    behind it. At most ``limit`` passes of one component are followed."""
    how = F.when(F.col("how") == "explicit", F.when(F.col("child_prop") == F.col("prop"), 0).otherwise(1)).when(F.col("how") == "renamed", 1).when(F.col("how") == "spread", 2).otherwise(3)
    kind = F.col("child_kind") if "child_kind" in passes.columns else F.lit("component")
    passes = passes.withColumns({"_way": how, "_kind": kind}).groupBy("component", "prop", "child", "child_prop").agg(F.min(F.struct("_way", "how", "_kind")).alias("_w"))
    node = lambda a, b: F.concat_ws("#", a, b)
    edges = passes.select(
        node("component", "prop").alias("src"), node("child", "child_prop").alias("dst"), F.col("_w._kind").alias("kind"),
        F.when(F.col("_w.how") == "explicit", "partial").otherwise("dynamic").alias("confidence"), F.col("_w.how").alias("note"), F.col("_w.how").isin("explicit", "renamed").alias("go"), F.col("_w._way").cast("long").alias("order"),
    )
    relation = F.when(F.col("note") == "explicit", "passes").when(F.col("note") == "renamed", "renames").when(F.col("note") == "spread", "spreads").otherwise("derives")
    start = seed.select(node("component", "prop").alias("node"), F.lit("component").alias("kind"))
    return typed_walk(start, edges, F.col("kind") == "component", relation, depth, limit, None)


def trace_prop(passes: DataFrame, seed: DataFrame, depth: int = 12, nodes: int | None = 300) -> tuple[DataFrame, Chain]:
    chain = prop_trace(passes, seed, depth, nodes)
    return chain.hops.select("from", "relation", "to", "confidence").distinct(), chain


def trace_field(reads: DataFrame) -> DataFrame:
    """One hop from a field to where it is rendered. reads: field, site, position, role."""
    relation = F.when(F.col("position").isin("intrinsic-child", "intrinsic-attr"), "rendered-in").when(F.col("position").isin("value-child", "value-attr"), "passed-to").when(F.col("role") == "destructure", "destructured-at")
    return reads.where("role <> 'write'").select("field", relation.alias("relation"), "site", F.when(relation == "rendered-in", "certain").otherwise("partial").alias("confidence")).where("relation is not null")


def widening_verdict(rows: DataFrame) -> DataFrame:
    """Adds verdict, confidence, note and go (whether the walk goes on) to flows (forward, backward:
    assignability of the source to the sink and back; src_any, src_unknown, sink_any, sink_unknown,
    src_literal, sink_union). Only a sink that is strictly wider is a widening; the verdict of all
    others is null. Flags that are not known count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    loose, to_any, to_unknown = flag("src_any") | flag("src_unknown"), flag("sink_any") & ~flag("src_any"), flag("sink_unknown") & ~flag("sink_any") & ~(flag("src_any") | flag("src_unknown"))
    wider = ~loose & ~flag("sink_any") & ~flag("sink_unknown") & flag("forward") & ~flag("backward")
    verdict = (
        F.when(to_any, "to-any").when(to_unknown, "to-unknown").when(wider & flag("src_literal") & ~flag("sink_literal"), "literal-widening")
        .when(wider & flag("sink_union"), "union-widened").when(wider, "narrowing-lost")
    )
    note = F.when(to_any, "the type is erased here").when(to_unknown, "the type is lost until it is narrowed again")
    return rows.withColumns({"verdict": verdict, "confidence": F.when(to_any | to_unknown, "dynamic").otherwise("certain"), "note": note, "go": ~(to_any | to_unknown)})


def trace_widening(flows: DataFrame, seeds: DataFrame, depth: int = 16, nodes: int = 200) -> tuple[DataFrame, Closure]:
    """Forward value flow (src, dst, relation and the flags of widening_verdict); any and unknown stop
    the walk, as do reassignments and returns, which are leaves."""
    rows = widening_verdict(flows)
    found = closure(rows.where(F.col("go") & F.col("relation").isin("passed-to", "assigned-to")), seeds, depth, nodes)
    reached = found.nodes.select("node").unionByName(seeds.select("node")).distinct()
    return rows.join(reached, rows["src"] == reached["node"], "left_semi").select("src", "relation", "dst", "verdict", "confidence", "note").distinct(), found


def owner(calls: DataFrame) -> DataFrame:
    """The nearest marked ancestor of each call. calls: id, parent, marked. Rows (id, owner).

    Ways up are doubled in each round, so rounds are logarithmic in the depth. A parent cycle without
    a marked call has no owner.
    """
    start = calls.select("id", F.col("parent").alias("at"), F.when(F.col("marked"), F.col("id")).alias("own"))
    # jump: from a call that is not marked to where the search goes on, or what it found.
    jump = materialised(start.select("id", F.when(F.col("own").isNull(), F.col("at")).alias("at"), F.col("own").alias("found")))
    for _ in range(64):
        onward = jump.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("found").alias("_found"))
        open_ = jump.where("found is null and at is not null")
        if not open_.limit(1).count():
            break
        moved = open_.join(onward, "at", "left").select("id", F.when(F.col("_found").isNull(), F.col("_at")).alias("at"), F.col("_found").alias("found"))
        moved = moved.where("at is null or found is not null or at <> id")
        jump = materialised(jump.where("found is not null or at is null").unionByName(moved))
    up = jump.select(F.col("id").alias("parent"), F.col("found").alias("owner"))
    return calls.select("id", "parent").join(up, "parent", "left").select("id", "owner")


class CycleError(ValueError):
    """Carries the cycle, the missing dependency or the duplicate."""


def toposort(needs: Iterable[tuple[str, Sequence[str]]]) -> list[str]:
    """Names in an order in which each follows what it needs; refuses cycles, gaps and duplicates."""
    given: dict[str, Sequence[str]] = {}
    for name, deps in needs:
        if name in given:
            raise CycleError(f"duplicate: {name}")
        given[name] = deps
    done: list[str] = []
    state: Mapping[str, int] = dict.fromkeys(given, 0)

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name not in given:
            raise CycleError(f"missing: {path[-1]} needs {name}")
        if state[name] == 2:
            return
        if state[name] == 1:
            raise CycleError("cycle: " + " -> ".join((*path[path.index(name) :], name)))
        state[name] = 1
        for d in given[name]:
            visit(d, (*path, name))
        state[name] = 2
        done.append(name)

    for name in given:
        visit(name, ())
    return done
