"""Operators on facts that are known by construction."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, values
from lodestone.operators import cascade, catalogue, changes, dead, facts, graph, usages


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_globs():
    import re

    ok = lambda g, p: any(re.match(paths.glob_regex(x), p) for x in paths.expand_dirs([g]))
    assert ok("src", "src") and ok("src", "src/a/b.ts") and not ok("src", "srcs/a")
    assert ok("**/*.test.*", "a.test.ts") and ok("**/*.test.*", "x/y/a.test.ts") and not ok("*.ts", "x/a.ts")
    assert ok("a/{b,c}/?.ts", "a/c/x.ts") and not ok("a/{b,c}/?.ts", "a/d/x.ts") and ok(".x/**", ".x/.y")
    assert ok("a(b)+c", "a(b)+c/d")


def test_rollup_and_collapse(spark):
    refs = spark.createDataFrame(
        [("Input", "f1", "import", "m", "p"), ("Input", "f1", "jsx", "A", "p"), ("Input", "f2", "import", "m2", "q"), ("Input", "f1", "call", "A", "q")],
        "symbol_id string, file string, role string, encloser string, program string",
    )
    assert rows(usages.by_encloser(refs, ["encloser"]), "encloser", "count", "roles", "programs") == [("A", 2, "call,jsx", "p,q"), ("m", 1, "import", "p"), ("m2", 1, "import", "q")]
    assert rows(usages.collapse(refs).where("hidden"), "file", "role") == [("f1", "import")]
    kept, dropped = usages.filtered(refs, include=["f1"])
    assert kept.count() == 3 and dropped.first()[0] == 1


def test_text_hits_use_ascii_boundaries(spark):
    lines = spark.createDataFrame([(1, "foo foo_ foo"), (2, "food"), (3, "éfoo")], "line int, text string")
    assert rows(usages.text_hits(lines, "foo"), "line", "hits") == [(1, 2), (3, 1)]


def test_dead_ladders(spark):
    keys = spark.createDataFrame([("a.b",), ("a.bc",), ("x.y",), ("used",)], "key string")
    used = spark.createDataFrame([("used",)], "key string")
    for head, demoted in (("a.b", {"a.b", "a.bc"}), ("a.bc", {"a.bc"}), ("a.", {"a.b", "a.bc"}), ("x.y.longer", set())):
        found = rows(dead.unused_keys(keys, used, spark.createDataFrame([(head,)], "key string")), "key", "confidence")
        assert {k for k, c in found if c == "dynamic"} == demoted and len(found) == 3
    heads = spark.createDataFrame([("a.b",)], "key string")
    assert {r[1] for r in rows(dead.unused_keys(keys, used, heads, any_dynamic=True), "key", "confidence")} == {"dynamic"}
    locales = spark.createDataFrame([("en",), ("ru",)], "locale string")
    defined = spark.createDataFrame([("a", "en"), ("b", "en"), ("b", "ru")], "key string, locale string")
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "key string, line int")
    assert rows(dead.missing_keys(asked, locales, defined), "key", "locale", "line") == [("a", "ru", 1)]


def test_unused_classes(spark):
    c = spark.createDataFrame([("s", "a", False, False), ("s", "b", True, False), ("t", "c", False, False), ("t", "d", False, True)], "file string, name string, global boolean, linked boolean")
    c = c.withColumn("entangled", F.lit(False)).withColumn("interpolated", F.lit(False))
    acc = spark.createDataFrame([("s", "a"), ("t", None)], "file string, name string")
    none = acc.limit(0)
    assert rows(dead.unused_classes(c, acc, none), "name", "confidence") == [("b", "dynamic"), ("c", "dynamic"), ("d", "dynamic")]


def test_phantom_deps(spark):
    i = spark.createDataFrame(
        [("emr", "@a/emr", "@mui/material", False, "x", 1), ("emr", "@a/emr", "@mui/material", False, "y", 2), ("emr", "@a/emr", "react", False, "x", 3), ("emr", "@a/emr", "node:fs", False, "x", 4),
         ("emr", "@a/emr", "./l", False, "x", 5), ("emr", "@a/emr", "@a/emr", False, "x", 6), ("emr", "@a/emr", "geojson", True, "x", 7)],
        "package_dir string, package string, spec string, type_only boolean, file string, line int",
    )
    m = spark.createDataFrame([("emr", "react"), ("emr", "@types/geojson")], "package_dir string, dep string")
    assert rows(dead.phantom_deps(i, m), "spec", "sites") == [("@mui/material", 2)]
    sub = [("emr", "@a/emr", x, False, "x", n) for n, x in enumerate(("react/jsx-runtime", "@a/emr/sub", "fs/promises", "#own", "/abs", "", "left/pad", "left", "@s/p/q"))]
    found = dead.phantom_deps(spark.createDataFrame(sub, i.schema), m)
    assert rows(found, "spec", "sites") == [("@s/p", 1), ("left", 2)]
    placed = spark.createDataFrame([(*r, where) for r, where in zip(sub[-3:], ("src/left.ts", "node_modules/left/i.js", None))], i.schema.add("resolved", "string"))
    assert rows(dead.phantom_deps(placed, m), "spec", "sites") == [("@s/p", 1), ("left", 1)]


def test_closure_is_shortest_path_and_capped(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5), (5, 5)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    c = graph.closure(edges, seed, 5)
    assert rows(c.nodes, "node", "depth") == [(2, 1), (3, 1), (4, 2), (5, 3)] and c.capped is None
    c = graph.closure(edges, seed, 1)
    assert rows(c.nodes, "node") == [(2,), (3,)] and c.capped == "depth" and c.frontier_left == 1
    c = graph.closure(edges, seed, 5, nodes=3)
    assert c.nodes.count() == 3 and c.capped == "nodes"


def test_affected_and_importers(spark):
    imports = spark.createDataFrame([("a.test.ts", "lib/a.ts", "./a"), ("lib/a.ts", "lib/b.ts", "./b"), ("c.test.ts", None, "lib/zzz")], "file string, resolved string, spec string")
    changed = spark.createDataFrame([("lib/b.ts",), ("gone.test.ts",), ("new.test.ts",)], "file string")
    gone = spark.createDataFrame([("gone.test.ts",)], "file string")
    tests, found = graph.affected_tests(imports, changed, deleted=gone)
    assert rows(tests, "file", "depth") == [("a.test.ts", 2), ("new.test.ts", 0)] and found.capped is None
    sub = graph.subtree_importers(imports, "lib")
    assert rows(sub, "file", "scope") == [("a.test.ts", "external"), ("c.test.ts", "unconfirmed"), ("lib/a.ts", "internal")]
    assert graph.subtree_verdict(sub).first()["safe"] is False


def test_owner_of_deep_calls(spark):
    """A chain of 200 calls, a cycle without a marked call, and a parent that is not there."""
    calls = [(0, None, True)] + [(i, i - 1, i == 90) for i in range(1, 200)] + [(500, 501, False), (501, 500, False), (600, 999, False), (700, 700, False)]
    got = dict(rows(graph.owner(spark.createDataFrame(calls, "id long, parent long, marked boolean")), "id", "owner"))
    assert got == {0: None, **{i: 0 if i <= 90 else 90 for i in range(1, 200)}, 500: None, 501: None, 600: None, 700: None}


def test_widening_counts_strictly_wider_sinks(spark):
    flags = ("forward", "backward", "src_any", "src_unknown", "src_literal", "sink_any", "sink_unknown", "sink_literal", "sink_union")
    cases = [
        (dict(forward=1, backward=1, sink_any=1), "to-any", "dynamic", False), (dict(forward=1, backward=1, sink_any=1, src_any=1), None, "certain", True), (dict(forward=1, sink_unknown=1), "to-unknown", "dynamic", False),
        (dict(forward=1, sink_unknown=1, src_any=1), None, "certain", True), (dict(forward=1, src_any=1), None, "certain", True), (dict(forward=1, backward=1), None, "certain", True), (dict(backward=1), None, "certain", True),
        (dict(), None, "certain", True), (dict(forward=1, src_literal=1), "literal-widening", "certain", True), (dict(forward=1, src_literal=1, sink_literal=1, sink_union=1), "union-widened", "certain", True),
        (dict(forward=1, sink_union=1), "union-widened", "certain", True), (dict(forward=1), "narrowing-lost", "certain", True),
    ]
    df = spark.createDataFrame([(i, *(bool(c.get(f)) for f in flags)) for i, (c, *_) in enumerate(cases)], "i int, " + ", ".join(f"{f} boolean" for f in flags))
    assert rows(graph.widening_verdict(df), "i", "verdict", "confidence", "go") == sorted([(i, *want) for i, (_, *want) in enumerate(cases)], key=repr)


def test_roles_by_syntax(spark):
    from lodestone.operators import classify

    a = lambda *kinds: [{"kind": k.rstrip("!"), "on_name": k.endswith("!")} for k in kinds]
    cases = [
        (a("Identifier"), True, False, None, "decl"), (a("Identifier", "ExportSpecifier", "ImportDeclaration"), False, False, None, "reexport"), (a("Identifier", "ImportSpecifier"), False, True, None, "import"),
        (a("Identifier", "JsxSelfClosingElement!"), False, False, None, "jsx"), (a("Identifier", "JsxAttribute", "JsxOpeningElement"), False, False, None, "read"), (a("Identifier", "JsxClosingElement!"), False, False, None, "jsx-closing"),
        (a("Identifier", "TypeNode", "CallExpression!"), False, False, None, "type"), (a("Identifier", "CallExpression!"), False, False, None, "call"), (a("Identifier", "CallExpression", "NewExpression!"), False, False, None, "call"),
        (a("Identifier", "PropertySignature!"), False, False, None, "type"), (a("Identifier", "PropertySignature"), False, True, None, "write"), (a("Identifier"), False, True, "member-read", "read"), (a("Identifier"), False, True, "local-write", "write"), (a(), False, False, None, "read"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<struct<kind:string,on_name:boolean>>, d boolean, w boolean, m string, want string")
    assert df.withColumn("got", classify.role(F.col("a"), F.col("d"), F.col("w"), F.col("m"))).where("not (got <=> want)").collect() == []
    assert df.select(classify.role(F.col("a"), F.col("d"), F.col("w"), None, F.lit(True)).alias("r")).distinct().collect()[0]["r"] == "decl"


def test_query_registries(spark):
    from lodestone.operators import classify

    shape = "struct<kind:string,value:string,elements:array<struct<kind:string,value:string>>>"
    v = lambda k, x=None, e=None: {"kind": k, "value": x, "elements": e}
    el = lambda *xs: [{"kind": k, "value": x} for k, x in xs]
    p = lambda *xs: [{"name": n, "kind": k, "value": x} for n, k, x in xs]
    calls = [
        (1, None, "useQuery", "Todos", "a", 1, v("array", None, el(("string", "todos"), ("number", "1"))), None), (2, None, "useInfiniteQuery", "More", "a", 2, v("array", None, el(("string", "todos"), ("identifier", None))), None),
        (3, None, "useQuery", "One", "a", 3, v("string", "one"), None), (4, None, "useQuery", "Made", "a", 4, v("call"), None), (5, None, "useQuery", "None", "a", 5, None, None),
        (10, None, "useMutation", "Save", "b", 1, None, None), (11, 10, "onSuccess", None, "b", 2, None, None), (12, 11, "invalidateQueries", None, "b", 3, v("array", None, el(("string", "todos"))), p(("queryKey", "array", None))),
        (13, 11, "refetchQueries", None, "b", 4, None, None), (14, 11, "removeQueries", None, "b", 5, v("string", "one"), p(("queryKey", "string", "one"), ("exact", "boolean", "true"))),
        (15, 11, "invalidateQueries", None, "b", 6, v("string", "one"), p(("queryKey", "string", "one"), ("predicate", "function", None))), (16, 11, "invalidateQueries", None, "b", 7, None, p(("exact", "identifier", None))),
        (20, None, "invalidateQueries", None, "c", 1, v("string", "one"), None),
    ]
    df = spark.createDataFrame(calls, f"id long, parent long, callee string, host string, file string, line int, key {shape}, props array<struct<name:string,kind:string,value:string>>")
    queries, mutations, edges = classify.query_registries(df)
    assert [(r["id"], [(s["kind"], s["value"]) for s in r["segments"] or []], r["opaque"], r["confidence"]) for r in queries.orderBy("id").collect()] == [
        (1, [("static", "todos"), ("static", "1")], None, "certain"), (2, [("static", "todos"), ("dynamic", None)], None, "partial"), (3, [("static", "one")], None, "certain"), (4, [], "call", "dynamic"), (5, [], None, "unresolved"),
    ]
    assert rows(mutations, "id", "host") == [(10, "Save")]
    assert rows(edges, "id", "mutation_id", "method", "is_all", "is_exact", "narrowed") == [
        (12, 10, "invalidateQueries", False, False, False), (13, 10, "refetchQueries", True, False, False), (14, 10, "removeQueries", False, True, False), (15, 10, "invalidateQueries", False, False, True), (16, 10, "invalidateQueries", True, False, True),
    ]


def test_trace_and_owner(spark):
    edges = spark.createDataFrame([("save", "todos", "certain")], "mutation string, key string, confidence string")
    affects = spark.createDataFrame([("todos", "useTodos", "certain"), ("other", "q", "certain")], "key string, query string, confidence string")
    hosts = spark.createDataFrame([("useTodos", "List", "component")], "query string, host string, kind string")
    mounts = spark.createDataFrame([("List", "App:3")], "host string, site string")
    out = graph.trace_invalidation(edges, affects, hosts, mounts)
    assert [r[1] for r in rows(out, "from", "relation", "to")] == ["mounted-at", "invalidates", "affects", "in"] or out.count() == 4
    calls = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, None, False)], "id long, parent long, marked boolean")
    assert rows(graph.owner(calls)) == [(1, None), (2, 1), (3, 1), (4, None)]
    passes = spark.createDataFrame([("A", "x", "B", "y", "explicit"), ("A", "x", "B", "y", "spread"), ("B", "y", "C", "z", "spread"), ("B", "y", "C", "z", "derived"), ("C", "z", "D", "w", "explicit")], "component string, prop string, child string, child_prop string, how string")
    hops, _ = graph.trace_prop(passes, spark.createDataFrame([("A", "x")], "component string, prop string"))
    assert rows(hops, "from", "relation", "to") == [("A#x", "passes", "B#y"), ("B#y", "spreads", "C#z")]


def test_toposort():
    assert graph.toposort([("b", ["a"]), ("a", []), ("c", ["b", "a"])]) == ["a", "b", "c"]
    for bad in ([("a", ["b"]), ("b", ["a"])], [("a", ["x"])], [("a", []), ("a", [])]):
        with pytest.raises(graph.CycleError):
            graph.toposort(bad)


def test_specificity_and_winner(spark):
    cases = {"#a .b c": (1, 1, 1), "a:hover::before": (0, 1, 2), ":where(#a)": (0, 0, 0), ":is(#a, .b) c": (1, 0, 1), ":not(.a.b)": (0, 2, 0), "[x=y].k": (0, 2, 0), ":global(.a) .b": (0, 2, 0), "*": (0, 0, 0)}
    assert {k: cascade.specificity(k) for k in cases} == cases
    d = spark.createDataFrame(
        [("color", "red", False, 0, 1, 0, 5, "x"), ("color", "blue", False, 0, 1, 0, 9, "x"), ("color", "tan", False, 0, 1, 0, 1, "y"), ("top", "1", True, 0, 0, 1, 1, "x"), ("top", "2", False, 1, 0, 0, 2, "x")],
        "prop string, value string, important boolean, a int, b int, c int, pos int, file string",
    )
    got = {r["prop"]: r for r in cascade.winners(d, ["prop"]).collect()}
    assert (got["color"]["value"], got["color"]["confidence"], got["color"]["tied_files"]) == ("blue", "partial", 2)
    assert (got["top"]["value"], got["top"]["important"], got["top"]["specificity"]) == ("1", 1, "0,0,1")


def test_key_match_table(spark):
    s, d = (lambda v: {"kind": "static", "value": v}), {"kind": "dynamic", "value": None}
    cases = [
        ([s("a")], [s("a"), s("b")], False, False, False, "certain"), ([s("a")], [s("b")], False, False, False, None), ([s("a"), d], [s("a"), s("b")], False, False, False, "partial"),
        ([s("a")], [s("a"), s("b")], True, False, False, None), ([s("a"), s("b")], [s("a")], False, False, False, None), (None, [s("a")], False, False, False, "dynamic"), ([], None, False, False, False, "dynamic"),
        ([s("a")], None, False, False, False, None), ([s("a")], [s("a")], False, True, False, "dynamic"), ([s("a")], [s("a")], True, False, True, "partial"), ([d], [s("a")], False, False, False, "partial"),
    ]
    seg = "array<struct<kind:string,value:string>>"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, e {seg}, q {seg}, exact boolean, broad boolean, narrowed boolean, want string")
    out = df.withColumn("got", values.key_match(F.col("e"), F.col("q"), F.col("exact"), F.col("broad"), F.col("narrowed")))
    assert out.where("not (got <=> want)").collect() == []


def test_values(spark):
    names = spark.createDataFrame([("useAppForm",), ("UseAppFormX",), ("xuseappformy",), ("userAgentFoo",), ("none",)], "name string")
    assert [r[0] for r in names.select(values.match_rank(F.col("name"), "useAppForm")).collect()] == [0, 1, 2, None, None]
    assert names.where(values.match_rank(F.col("name"), "uAF") == 3).count() == 2
    assert names.select(values.fnv1a64(F.lit("a"))).first()[0] == "af63dc4c8601ec8c"
    t = spark.createDataFrame([("ab\ncd",)], "t string")
    got = [t.select(values.offset_location(F.col("t"), F.lit(i))).first()[0] for i in (0, 2, 3, 5, 6)]
    assert [tuple(g) if g else None for g in got] == [(1, 1), (1, 3), (2, 1), (2, 3), None]
    c = spark.createDataFrame([("certain",), ("dynamic",), ("partial",)], "c string")
    assert c.agg(values.worst_of(F.col("c"))).first()[0] == "dynamic"
    span = "struct<file:string,line:int,col:int,end_line:int,end_col:int>"
    s = spark.createDataFrame([(("f", 1, 1, 1, 5), ("f", 1, 5, 1, 9)), (("f", 1, 1, 3, 1), ("f", 2, 1, 2, 4))], f"a {span}, b {span}")
    assert rows(s.select(values.span_intersects("a", "b"), values.span_contains("a", "b"))) == [(False, False), (True, True)]


def test_catalogue(spark):
    files = spark.createDataFrame([("a/b/x.ts",), ("z.ts",)], "file string")
    member = spark.createDataFrame([("a/b/x.ts", "tsconfig.json"), ("a/b/x.ts", "a/tsconfig.app.json"), ("a/b/x.ts", "a/tsconfig.json")], "file string, config string")
    assert rows(catalogue.primary_config(files, member), "file", "config") == [("a/b/x.ts", "a/tsconfig.json"), ("z.ts", "(no tsconfig)")]
    defs = spark.createDataFrame([("a.b", "Hi"), ("a.bc", "ho"), ("a.b.c", "HIGH")], "key string, value string").withColumn("locale", F.lit("en"))
    assert rows(catalogue.lookup(defs, prefix="a.b"), "key") == [("a.b",), ("a.b.c",)]
    assert rows(catalogue.lookup(defs, value="hi"), "key") == [("a.b",), ("a.b.c",)]
    with pytest.raises(ValueError):
        catalogue.lookup(defs, key="a", prefix="b")
    decls = spark.createDataFrame([("Card", True, "certain"), ("useX", False, "certain"), ("used", False, "certain"), ("Plain", False, "certain")], "name string, returns_jsx boolean, jsx_conf string")
    assert rows(catalogue.classified(decls), "name", "class") == [("Card", "component"), ("Plain", "other"), ("useX", "hook"), ("used", "other")]


def test_type_facts(spark):
    lits = spark.createDataFrame([("T", True, False, False, False, 1), ("T", False, False, False, False, 2), ("T", False, True, False, False, 3), ("T", True, False, True, False, 4)], "type_id string, assignable boolean, any boolean, generic boolean, any_member boolean, line int")
    assert rows(facts.constructions(lits, "T"), "line", "confidence") == [(1, "certain"), (3, "dynamic"), (4, "partial")]
    sites = spark.createDataFrame([(["a", "b", "c"], ["c", "a"], True, True)], "domain array<string>, covered array<string>, has_default boolean, uniform boolean")
    assert rows(facts.discriminations(sites), "covers", "missing", "has_default", "confidence") == [("a c", "b", 1, "certain")]


def test_changes(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    a = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "k string, v int")
    assert rows(changes.snapshot_diff(b, a, "k", "v")) == [("b", "changed"), ("d", "added")]
    edits = spark.createDataFrame([("f", 0, 5), ("f", 5, 8), ("f", 7, 9), ("g", 3, 3), ("g", 3, 6), ("h", 1, 4), ("h", 1, 2)], "file string, begin int, end int")
    assert rows(changes.edit_conflicts(edits), "file", "begin", "end") == [("f", 7, 9), ("h", 1, 4)]
    f = spark.createDataFrame([("p", 1, 2, "x"), ("q", 3, 4, "y")], "path string, size long, mtime_ms long, hash string")
    one = changes.rollup_fingerprint(f).first()
    assert tuple(one) == tuple(changes.rollup_fingerprint(f.orderBy(F.desc("path")).repartition(3)).first())
    assert tuple(one) != tuple(changes.rollup_fingerprint(f.where("path = 'p'")).first())
    assert rows(changes.introduced(b.select("k"), a.select("k"), "k")) == [("d",)]


def test_depths_agree_with_a_plain_search(spark):
    import random

    random.seed(5)
    pairs = {(random.randrange(40), random.randrange(40)) for _ in range(60)}
    depth, frontier = {0: 0}, [0]
    for level in itertools.count(1):
        frontier = sorted({b for a, b in pairs if a in frontier and b not in depth})
        if not frontier:
            break
        depth.update(dict.fromkeys(frontier, level))
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    got = graph.closure(edges, spark.createDataFrame([(0,)], "node int"), 40)
    assert dict(rows(got.nodes, "node", "depth")) == {k: v for k, v in depth.items() if v}
