"""Operations by name, their tables, and batches over one and several roots."""

import pytest

from lodestone.plans.engine import OPS, TABLES, Engine, constant_columns, cross_root_sql

REFS = "symbol_id string, symbol string, file string, start int, line int, col int, end_line int, end_col int, role string, program string, program_rank int, encloser_id string, encloser string, encloser_kind string, encloser_exported boolean, destructures string"


def ref(symbol, file, start, role, encloser, exported=False, program="p", rank=0):
    return (f"id:{symbol}", symbol, file, start, start, 1, start, 9, role, program, rank, f"id:{encloser}" if encloser else None, encloser, "function", exported, None)


@pytest.fixture(scope="module")
def engine(spark):
    refs = [ref("Input", "a.tsx", 1, "import", None), ref("Input", "a.tsx", 5, "jsx", "A", True), ref("Input", "a.tsx", 5, "jsx", "A", True, "q", 1), ref("Input", "b.tsx", 4, "jsx", "B"), ref("useAppForm", "b.tsx", 3, "call", "B"), ref("A", "c.tsx", 7, "jsx", "C"), ref("B", "b.tsx", 1, "decl", None)]
    symbols = [("id:A", "A", "function", None, "a.tsx", 5, 1, True, True, True, "t"), ("id:B", "B", "function", None, "b.tsx", 4, 1, True, True, True, "t"), ("id:Z", "Az", "const", None, "z.ts", 1, 1, True, False, True, "u")]
    seg = "array<struct<kind:string,value:string>>"
    s = lambda *v: [{"kind": "static", "value": x} for x in v]
    make = spark.createDataFrame
    return Engine(spark, {
        "refs": make(refs, REFS),
        "symbols": make(symbols, "id string, name string, kind string, container string, file string, line int, col int, exported boolean, callable boolean, real_decl boolean, config string"),
        "imports": make([("x.test.ts", 1, "./a", "a.tsx", "A"), ("a.tsx", 1, "./i", "i.tsx", "Input")], "file string, line int, spec string, resolved string, imports string"),
        "locale_keys": make([("en.json", "en", "a.b", "Hi", 1), ("en.json", "en", "dead", "x", 2), ("ru.json", "ru", "dead", "y", 1), ("en.json", "en", "t.k", "x", 3)], "file string, locale string, key string, value string, line int"),
        "literal_calls": make([("t", "a.b", False, None, "a.tsx", 3), ("t", None, True, "`t.${x}`", "a.tsx", 4)], "fn string, arg string, dynamic boolean, text string, file string, line int"),
        "css_rules": make([("s.scss", 0, ".a", 0, 1, 0, ["a"], False), ("s.scss", 1, ".p .a", 0, 2, 0, ["a"], False)], "file string, rule_ix int, selector string, a int, b int, c int, subject_classes array<string>, interpolated boolean"),
        "css_decls": make([("s.scss", 0, "top", "1", False, 1), ("s.scss", 1, "top", "2", False, 0)], "file string, rule_ix int, prop string, value string, important boolean, pos int"),
        "rq_edges": make([("m1", "save", "invalidate", False, False, False, s("todos"), None), ("m1", "save", "invalidate", False, False, False, s("none"), None)], f"mutation_id string, mutation string, method string, is_all boolean, is_exact boolean, narrowed boolean, segments {seg}, opaque string"),
        "rq_queries": make([("q1", "useTodos", "query", s("todos", "list"), None), ("q2", "useOther", "query", s("other"), None)], f"id string, name string, kind string, segments {seg}, opaque string"),
        "function_decls": make([("f1", "Card", True, "certain", "a.tsx", 1, 1), ("f2", "useX", False, "certain", "a.tsx", 2, 1)], "id string, name string, returns_jsx boolean, jsx_conf string, file string, line int, col int"),
        "endpoints": make([("GET", "/Users/{id}", ["id"], None, None, "U", 200, "certain")], "method string, path string, path_params array<string>, query string, body string, response string, status int, confidence string"),
    })


def got(e, name, *columns, **args):
    out = e.run(name, **args)
    assert out.ok, out.failure
    return sorted((tuple(r) for r in out.df.select(*columns).collect()), key=repr)


def test_tables_have_their_columns(engine):
    for name, args in {"search_symbol": {"query": "a"}, "find_usages": {"symbols": ["Input"]}, "importers_of": {"module": "a.tsx"}, "find_unused_exports": {}, "css_cascade": {"css_class": "a"}, "i18n_lookup": {}, "list_endpoints": {}, "list": {"registry": "components"}, "invalidations_for": {"mutation": "save"}}.items():
        out = engine.run(name, **args)
        assert out.ok, (name, out.failure)
        assert out.df.columns == [c.split(":")[0] for c in TABLES[name].split()], name
        assert [t for _, t in out.df.dtypes] == ["bigint" if c.endswith(":i") else "string" for c in TABLES[name].split()]


def test_usages(engine):
    assert got(engine, "find_usages", "file", "line", "role", symbols=["Input"]) == [("a.tsx", 1, "import"), ("a.tsx", 5, "jsx"), ("b.tsx", 4, "jsx")]
    assert got(engine, "find_usages", "file", "role", symbols=["Input"], collapse_imports=True) == [("a.tsx", "jsx"), ("b.tsx", "jsx")]
    assert got(engine, "find_usages", "encloser", "count", "is_exported", symbols=["Input"], role="jsx", group_by="enclosing") == [("A", 1, 1), ("B", 1, 0)]
    out = engine.run("find_usages", symbols=["Input", "Ghost"], exclude=["a.tsx"])
    assert "not found: Ghost" in out.notes and "2 rows excluded by the path filter" in out.notes and out.df.count() == 1


def test_text_overlay_is_by_span(spark, engine):
    """A hit stays unless a reference covers its very place; other places of the line are hits."""
    lines = spark.createDataFrame([("a.tsx", 1, "Input, and Input xInput"), ("b.tsx", 4, "Input + Input"), ("d.md", 2, "an Input, Input")], "file string, line int, text string")
    e = Engine(spark, {**engine.facts, "text_lines": lines})
    out = e.run("find_usages", symbols=["Input"], text="Input")
    assert out.ok, out.failure
    hits = sorted((r["file"], r["line"], r["col"]) for r in out.df.where("confidence = 'unresolved'").collect())
    assert hits == [("a.tsx", 1, 12), ("b.tsx", 4, 9), ("d.md", 2, 4), ("d.md", 2, 11)]
    assert got(engine, "find_usages", "file", "encloser", "decls", symbols=["A"], merge_declarations=True) == [("c.tsx", "C", "id:A")]


def test_dead_things(engine):
    assert got(engine, "find_unused_exports", "name") == [("Az",), ("B",)]
    assert got(engine, "find_unused_i18n_keys", "key", "confidence") == [("dead", "certain"), ("dead", "certain"), ("t.k", "dynamic")]
    assert got(engine, "find_missing_i18n_keys", "key", "locale", "usage_line") == [("a.b", "ru", 3)]


def test_lookups_and_graph(engine):
    assert got(engine, "search_symbol", "name", query="a") == [("A",), ("Az",)]
    assert got(engine, "css_cascade", "prop", "value", "winner_selector", css_class="a") == [("top", "2", ".p .a")]
    assert got(engine, "invalidations_for", "key", "affects", "confidence", mutation="save") == [("none", None, None), ("todos", "useTodos", "certain")]
    assert got(engine, "list_endpoints", "path_params", path="users") == [("id",)]
    assert got(engine, "impact", "node", "depth", symbol_ids=["id:Input"]) == [("id:A", 1), ("id:B", 1), ("id:C", 2)]
    assert got(engine, "affected", "file", "depth", files=["i.tsx"]) == [("x.test.ts", 2)]
    assert got(engine, "rename_symbol", "file", "begin", "end", "text", symbol_id="id:A", new_name="Q") == [("c.tsx", 7, 8, "Q")]
    assert constant_columns(engine["function_decls"].select("file", "name")) == {"file": "a.tsx"}


def test_other_names_of_arguments(engine):
    out = engine.run("find_usages", symbols="Input", pathExclude="a.tsx", groupBy="enclosing")
    assert out.ok and [r["encloser"] for r in out.df.collect()] == ["B"] and "groupBy is taken as group_by" in out.notes


def test_lower_bounds_programs_and_members(spark, engine):
    more = spark.createDataFrame([ref("Input", "q.tsx", 2, "jsx", "Q", program="q"), ref("Input", "r.tsx", 2, "jsx", "R", program="r")], REFS)
    symbols = engine["symbols"].unionByName(spark.createDataFrame([("id:load", "load", "method", "Store", "s.ts", 3, 1, False, True, True, "t"), ("id:x1", "x", "property", "P", "s.ts", 5, 1, False, False, True, "t"), ("id:x2", "x", "property", "Q", "s.ts", 9, 1, False, False, True, "t")], engine["symbols"].schema))
    member = spark.createDataFrame([("id:load", "Store.load", *ref("load", "t.ts", 4, "call", "T")[2:])], REFS)
    e = Engine(spark, {**engine.facts, "refs": engine["refs"].unionByName(member), "refs_other": more, "symbols": symbols}, undiscovered=["q", "r"])
    out = e.run("find_usages", symbols=["Input"])
    assert not out.complete and out.notes[0].startswith("!! a lower bound: 2 programs") and out.df.count() == 3
    out = e.run("find_usages", symbols=["Input"], programs=["q"])
    assert not out.complete and "1 programs are not loaded: r" in out.notes[0] and out.df.count() == 4
    assert e.run("find_usages", symbols=["Input"], programs=["q", "r"]).complete and e.run("i18n_lookup").complete and engine.run("find_usages", symbols=["Input"]).complete
    out = e.run("find_usages", symbols=["load"], file="s.ts")
    assert "load is taken as the member Store.load" in out.notes and [r["file"] for r in out.df.collect()] == ["t.ts"]
    failed = e.run("find_usages", symbols=["x"], file="s.ts").failure
    assert failed.code == "bad_args" and "P.x at line 5" in failed.message and "Q.x at line 9" in failed.message
    assert "not found: nope" in e.run("find_usages", symbols=["nope"], file="s.ts").notes


def test_dominant(spark, engine):
    from pyspark.sql import functions as F

    from lodestone.plans.engine import dominant

    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "i int, v string")
    assert [tuple(r) for r in dominant(df, "v", F.col("i")).collect()] == [("b", 2)] and dominant(df.limit(0), "v", F.col("i")).count() == 0


def test_failures_are_data(engine, tmp_path):
    assert engine.run("nope").failure.code == "unknown_op" and engine.run("member_usages", x=1).failure.code == "bad_args"
    assert engine.run("construction_sites", target="T").failure.code == "unavailable" and engine.run("i18n_lookup", key="a", value="b").failure.code == "bad_args"
    cut = engine.run("find_usages", symbols=["Input"], limit=1)
    assert (cut.truncated.shown, cut.truncated.total, cut.df.count()) == (1, 3, 1)
    assert engine.run("feedback", path=str(tmp_path / "inbox.md"), kind="bug", title="T").ok and "bug: T" in (tmp_path / "inbox.md").read_text()
    assert engine.status().count() == len(OPS)


def test_sql_over_operations(engine):
    two = [("find_usages", "renders", {"symbols": ["Input"], "role": "jsx", "group_by": "enclosing", "limit": 1}), ("find_usages", "forms", {"symbols": ["useAppForm"], "group_by": "enclosing"})]
    out = engine.sql(two, "SELECT encloser FROM renders WHERE encloser_id NOT IN (SELECT encloser_id FROM forms)")
    assert [r[0] for r in out.sql.df.collect()] == ["A"]
    assert "no table" in engine.sql([("impact", None, {"symbol_ids": ["id:A"]})], "SELECT 1").sql.failure.message
    both = cross_root_sql([(engine, "search_symbol", "a", {"query": "A"}), (engine, "find_unused_exports", "b", {})], "SELECT a.name FROM a JOIN b ON a.name = b.name")
    assert [r[0] for r in both.sql.df.collect()] == ["Az"]


def test_targets_limits_and_hints(engine):
    assert [r["name"] for r in engine.run("find_definition", target="A").df.collect()] == [r["name"] for r in engine.run("find_definition", name="A").df.collect()] == ["A"]
    by_name, by_target = engine.run("find_usages", symbols=["Input"]), engine.run("find_usages", target="Input")
    assert by_target.ok and by_target.df.count() == by_name.df.count() > 0
    assert engine.run("impact", target="id:nobody").failure.message == "no symbol named id:nobody"
    first = engine["symbols"].where("name = 'A'").first()
    at = engine.run("impact", target=f"{first['file']}:{first['line']}")
    assert at.ok and at.df.count() == engine.run("impact", symbol_ids=[first["id"]]).df.count()
    assert engine.run("list_endpoints", target="a.tsx:1").failure.code == "bad_args"
    many = engine.spark.range(60).selectExpr("concat('i', id) id", "concat('name', id) name", "'const' kind", "cast(null as string) container", "'names.ts' file", "cast(id as int) line", "1 col", "true exported", "false callable", "true real_decl", "'c' config")
    from lodestone.plans.engine import Engine

    e = Engine(engine.spark, {"symbols": many}, undiscovered=["a.json", "b.json", "c.json", "d.json"])
    cut = e.run("search_symbol", query="name")
    assert cut.df.count() == 25 and cut.truncated.total == 60 and e.run("search_symbol", None, query="name").df.count() == 60
    with e.sql([("search_symbol", "s", {"query": "name"})], "SELECT count(*) AS n FROM s") as got:
        assert got.sql.df.first()["n"] == 60
    none = e.run("search_symbol", query="names")
    assert any("files have that name: names.ts" in n for n in none.notes) and any("and 1 more" in n for n in none.notes)


def test_affected_names_what_it_can_not_follow(engine):
    got = engine.run("affected", files=["i.tsx", "logo.svg"], deleted=["old.ts"])
    assert not got.complete and any("1 changed files are deleted" in n and "old.ts" in n for n in got.notes) and any("logo.svg" in n for n in got.notes)
    assert engine.run("affected", files=["i.tsx"]).complete


def test_renames_say_where_the_old_name_stays(spark):
    from lodestone.plans.engine import Engine

    rows = [("s", "old", "a.ts", 5, "decl", "old"), ("s", "old", "b.ts", 9, "reexport", "old"), ("s", "old", "c.ts", 1, "call", "alias"), ("s", "old", "node_modules/p/d.ts", 3, "call", "old")]
    e = Engine(spark, {"refs": spark.createDataFrame(rows, "symbol_id string, symbol string, file string, start int, role string, spelled string")})
    out = e.run("rename_symbol", symbol_id="s", new_name="new")
    assert sorted((r["file"], r["begin"], r["end"], r["text"]) for r in out.df.collect()) == [("a.ts", 5, 8, "new"), ("b.ts", 9, 12, "new as old")]
    assert out.notes == ["the old name stays: 1 re-exports keep it as an alias, 1 references in files that are not edited have it: node_modules/p/d.ts"]


def test_global_blocks_have_no_classes_of_their_own(spark):
    from lodestone.sources import repo

    text = ".a { :global { .g { top: 1px } } } :global { .h { top: 1px } } :global .i { top: 1px } .b :global(.j) { top: 1px } .k:global(.l).m { top: 1px }"
    files = spark.createDataFrame([("s.scss", bytearray(text, "utf-8"))], "path string, content binary")
    styles = repo.styles(files)
    assert {r["name"] for r in repo.css_classes(styles).where("not global").collect()} == {"a", "b", "k", "m"}
    assert {r["name"] for r in repo.class_names(styles).collect()} == {"a", "b", "k", "m"}
