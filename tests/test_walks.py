"""Walks with state against a plain breadth-first search, and typed hops."""

import random

import pytest

from lodestone.operators import graph, walks
from lodestone.plans.engine import Engine


def plain_walk(groups, seeds, depth, nodes, fan_out):
    """groups: src -> [(dst, roles, n, kind)]."""
    order = {s: sorted(g, key=lambda x: (-x[2], x[0]))[:fan_out] for s, g in groups.items()}
    frontier = [(s, None, []) for s in sorted(seeds)]
    found, kinds, state, boundary, capped = {}, {}, {}, set(), None
    seen = set(seeds)
    for level in range(1, depth + 1):
        new = []
        for i, (parent, kind, roles) in enumerate(frontier):
            if len(found) >= nodes:
                capped = "nodes"
                boundary = {x[0] for x in frontier[i:] + new}
                break
            if kind == "module":
                state[parent] = "dead" if set(roles) - {"import", "reexport"} else "end"
                continue
            state[parent] = "hub" if len(groups.get(parent, [])) > fan_out else "seen"
            called = any(set(g[1]) & {"call", "jsx"} for g in groups.get(parent, []))
            for dst, r, n, k in order.get(parent, []):
                if dst in seen:
                    continue
                if len(found) >= nodes:
                    capped = "nodes"
                    boundary = {x[0] for x in frontier[i + 1 :] + new}
                    break
                seen.add(dst)
                found[dst] = (level, parent, called and not set(r) - {"read", "write"})
                new.append((dst, k, r))
            if capped:
                break
        frontier = new
        if capped or not frontier:
            break
    if not capped and frontier:
        capped, boundary = "depth", {x[0] for x in frontier}
    return found, state, boundary, capped


@pytest.mark.parametrize("seed, depth, nodes, fan_out", [(1, 3, 12, 3), (2, 4, 500, 4), (3, 2, 8, 2), (4, 5, 1, 9), (5, 3, 20, 1), (6, 6, 25, 3)])
def test_walk_against_plain_search(spark, seed, depth, nodes, fan_out):
    rng = random.Random(seed)
    groups = {}
    for s in range(40):
        for d in rng.sample(range(40), rng.randint(0, 5)):
            if d != s:
                roles = sorted(rng.sample(["read", "write", "call", "jsx", "import", "reexport", "type"], rng.randint(1, 2)))
                groups.setdefault(f"n{s:02}", []).append((f"n{d:02}", roles, rng.randint(1, 3), "module" if d % 6 == 0 else "function"))
    rows = [(s, d, r, n, k) for s, g in groups.items() for d, r, n, k in g]
    df = spark.createDataFrame(rows, "src string, dst string, roles array<string>, n long, kind string")
    seeds = ["n01", "n02"]
    walk = walks.dependents_walk(df, spark.createDataFrame([(s,) for s in seeds], "node string"), depth, nodes, fan_out)
    found, state, boundary, capped = plain_walk(groups, seeds, depth, nodes, fan_out)
    got = {r["node"]: r for r in walk.state.collect()}
    assert {k: (v["depth"], v["parent"], v["reads_as_value"] is not None) for k, v in got.items() if v["depth"]} == found
    assert walk.capped == capped and {k for k, v in got.items() if v["boundary"]} == boundary
    assert {k for k, v in got.items() if v["hub"]} == {k for k, v in state.items() if v == "hub"}
    assert {k for k, v in got.items() if v["dead_end"]} == {k for k, v in state.items() if v == "dead"}
    told = walk.disclosures().first()
    assert told["nodes"] == len(found) and told["boundary_nodes"] == len(boundary) and (not told["complete"] or capped is None)


def test_impact_says_what_it_leaves_open(spark):
    rows = [("f", "A", "call", "function", True, "a.ts"), ("f", "B", "read", "function", False, "b.ts"), ("f", "M", "call", "module", False, "m.ts"), ("A", "C", "call", "function", True, "c.ts"), ("f", "f", "decl", "function", True, "f.ts"), ("f", "I", "import", "module", False, "i.ts")]
    refs = spark.createDataFrame(rows, "symbol_id string, encloser_id string, role string, encloser_kind string, encloser_exported boolean, file string")
    e = Engine(spark, {"refs": refs})
    out = e.run("impact", symbol_ids=["f"])
    assert {r["node"] for r in out.df.collect()} == {"A", "B", "M", "I", "C"} and not out.complete
    assert any("1 modules" in n for n in out.notes) and any("1 dependents read a callable" in n for n in out.notes)
    view = e.run("impact", symbol_ids=["f"], include=["c.ts"])
    assert [r["node"] for r in view.df.collect()] == ["C"] and any("4 of 5" in n for n in view.notes)
    assert {r["node"] for r in e.run("impact", symbol_ids=["f"], exported_only=True).df.collect()} == {"A", "C"}
    assert "complete" in e.run("impact", symbol_ids=["A"]).notes
    none = e.run("impact", symbol_ids=["nobody"])
    assert none.df.count() == 0 and none.complete


def test_hooks_of_hooks_end_at_their_mounts(spark):
    make = spark.createDataFrame
    facts = {
        "rq_edges": make([("save", "k", "certain")], "mutation string, key string, confidence string"), "rq_affects": make([("k", "q", "certain")], "key string, query string, confidence string"),
        "rq_hosts": make([("q", "useA", "hook")], "query string, host string, kind string"), "mounts": make([("Page", "p.tsx:1"), ("Page", "p.tsx:9"), ("Idle", "i.tsx:1")], "host string, site string"),
        "hook_uses": make([("useA", "useB", "hook"), ("useB", "useC", "hook"), ("useC", "Page", "component"), ("useC", "useA", "hook"), ("useB", "Bare", "component"), ("useB", "helper", "other"), ("useA", "useA", "hook"), ("useC", "useLone", "hook")], "host string, user string, kind string"),
    }
    e = Engine(spark, facts)
    out = e.run("trace_invalidation", mutation="save")
    hops = {(r["from"], r["relation"], r["to"]) for r in out.df.collect()}
    assert hops == {
        ("save", "invalidates", "k"), ("k", "affects", "q"), ("q", "in", "useA"), ("useA", "used-by", "useB"), ("useB", "used-by", "useC"), ("useC", "used-by", "Page"), ("useC", "used-by", "useA"), ("useB", "used-by", "Bare"),
        ("useB", "used-by", "helper"), ("useC", "used-by", "useLone"), ("Page", "mounted-at", "p.tsx:1"), ("Page", "mounted-at", "p.tsx:9"),
    }
    assert {"Bare: no static mount site", "helper: neither a component nor a hook", "useLone: no users found"} <= set(out.notes) and out.complete
    cut = e.run("trace_invalidation", mutation="save", depth=2)
    assert not cut.complete and not {r["to"] for r in cut.df.collect()} & {"Page"} and any(n.startswith("useC: not followed") for n in cut.notes)
    few = e.run("trace_invalidation", mutation="save", usages=1)
    assert not few.complete and any("1 of 3 are followed" in n for n in few.notes)


def test_prop_hops_stop_where_the_name_is_lost(spark):
    rows = [("A", "x", "B", "x", "explicit", "component"), ("A", "x", "B", "x", "spread", "component"), ("B", "x", "C", "y", "renamed", "component"), ("C", "y", "D", "y", "spread", "component"), ("D", "y", "E", "y", "explicit", "component"), ("C", "y", "div", "title", "explicit", "sink"), ("C", "y", "A", "x", "renamed", "component")]
    passes = spark.createDataFrame(rows, "component string, prop string, child string, child_prop string, how string, child_kind string")
    chain = graph.prop_trace(passes, spark.createDataFrame([("A", "x")], "component string, prop string"))
    assert {(r["from"], r["relation"], r["to"], r["depth"]) for r in chain.hops.collect()} == {("A#x", "passes", "B#x", 1), ("B#x", "renames", "C#y", 2), ("C#y", "spreads", "D#y", 3), ("C#y", "passes", "div#title", 3), ("C#y", "renames", "A#x", 3)}
    assert not chain.truncated
    short = graph.prop_trace(passes, spark.createDataFrame([("A", "x")], "component string, prop string"), depth=1)
    assert short.truncated and short.hops.count() == 1


def test_cascade_is_certain_only_where_it_holds_always(spark):
    from lodestone.sources import repo

    sheets = {"a.scss": ".a { color: blue; top: 1px; left: 2px } .a:hover { color: red } .b .a { top: 3px } @media print { .a { width: 1px } } .a.on { right: 1px }", "z.scss": ".d { top: 1px } .c .d { top: 2px } .d::before { left: 1px } div.d { width: $w } .d[x] { right: 2px } .d:not(.e) { bottom: 1px }"}
    files = spark.createDataFrame([(k, bytearray(v, "utf-8")) for k, v in sheets.items()], "path string, content binary")
    styles = repo.styles(files)
    e = Engine(spark, {"css_rules": repo.css_rules(styles), "css_decls": repo.css_decls(styles)})
    got = {r["prop"]: (r["value"], r["confidence"], r["note"]) for r in e.run("css_cascade", css_class="a").df.collect()}
    assert got["left"] == ("2px", "certain", None)
    assert got["color"][:2] == ("red", "partial") and "pseudo-class" in got["color"][2]
    assert got["top"][:2] == ("3px", "partial") and "another element" in got["top"][2]
    assert got["width"][1] == "partial" and "@media print" in got["width"][2] and ".on" in got["right"][2]
    got = {r["prop"]: (r["value"], r["confidence"], r["note"]) for r in e.run("css_cascade", css_class="d").df.collect()}
    assert got["top"][:2] == ("2px", "partial") and "pseudo-element" in got["left"][2] and "element type" in got["width"][2] and "computed" in got["width"][2] and "attribute" in got["right"][2] and ":not()" in got["bottom"][2]
    other = e.run("css_cascade", css_class="d", file="a.scss")
    assert all(r["confidence"] == "partial" and "another module" in r["note"] for r in other.df.collect()) and other.notes
    assert e.run("css_cascade", css_class="none").notes == ["no rule has .none as its subject"]


def test_batches_release_what_they_kept(spark):
    from lodestone.plans.sqlbatch import Request, run_batch

    df = spark.range(20).withColumnRenamed("id", "n")
    with run_batch(spark, [Request("r", lambda: df, "t")], "SELECT count(*) AS c FROM t") as out:
        assert out.sql.ok and out.sql.df.first()["c"] == 20 and len(out.held) == 1
    assert not out.held
    only = run_batch(spark, [Request("r", lambda: df, "t")], "SELECT n FROM t WHERE n < 2", returns="sql")
    assert only.producers == {} and only.sql.df.count() == 2
    only.release()
    ran = []
    bad = run_batch(spark, [Request("r", lambda: ran.append(1) or df, "t"), Request("x", lambda: df, "u", tabular=False)], "SELECT 1 FROM t")
    assert bad.sql.failure.code == "bad_args" and "has no table: x" in bad.sql.failure.message and not ran
    for sql in ("SELECT '${env:HOME}' FROM t", "SELECT '${system:user.home}' FROM t", "SELECT ${spark.app.name} FROM t", "SELECT 1 FROM t -- ${hiveconf:x}"):
        got = run_batch(spark, [Request("r", lambda: df, "t")], sql)
        assert got.sql.failure and got.sql.failure.code == "bad_args", sql
    literal = run_batch(spark, [Request("r", lambda: df, "t")], "SELECT '$' || '{env:HOME}' AS s FROM t LIMIT 1")
    assert literal.sql.df.first()["s"] == "$" + "{env:HOME}"
    literal.release()
