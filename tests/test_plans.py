"""The SQL batch, its gate, envelopes, rendering, sources and streaming."""

import json

import pytest

from lodestone.plans import envelope, registry, render, sqlbatch
from lodestone.plans.engine import OPS
from lodestone.sources import repo
from lodestone.streaming import refresh


def batch(spark, sql, **more):
    refs = spark.createDataFrame([("Input", "A"), ("Input", "B"), ("useAppForm", "B")], "symbol string, encloser string")
    make = lambda s: lambda: refs.where(f"symbol = '{s}'")
    return sqlbatch.run_batch(spark, [sqlbatch.Request("u", make("Input"), "renders"), sqlbatch.Request("u", make("useAppForm"), "forms")], sql, **more)


def test_anti_join(spark):
    out = batch(spark, "SELECT encloser FROM renders WHERE encloser NOT IN (SELECT encloser FROM forms)")
    assert [r[0] for r in out.sql.df.collect()] == ["A"]


@pytest.mark.parametrize("sql", [
    "INSERT INTO renders VALUES ('x', 'y')", "UPDATE renders SET encloser = 'x'", "DELETE FROM renders", "SELECT 1; DROP TABLE renders", "PRAGMA user_version", "ATTACH DATABASE 'x' AS y",
    "WITH a AS (SELECT 1) DELETE FROM renders", "WITH a AS (SELECT 1) INSERT INTO renders SELECT * FROM a", "/* SELECT */ DROP TABLE renders", "-- SELECT\nINSERT INTO renders SELECT 1",
    "SELECT * FROM parquet.`/tmp`", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM elsewhere", "SELECT 1 WHERE EXISTS (SELECT 1 FROM elsewhere)", "SELECT (SELECT max(x) FROM elsewhere)", "SET a = b",
    "'; DROP TABLE renders; --", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') FROM renders",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM renders", "SELECT * FROM IDENTIFIER('renders')", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "WITH `text./etc/hostname` AS (SELECT 1) SELECT * FROM text.`/etc/hostname`", "SELECT * FROM range(10)", "SELECT input_file_name() FROM renders", "SELECT current_user() FROM renders", "SELECT system.builtin.reflect('a', 'b')",
    "SELECT encloser FROM renders WHERE encloser IN (SELECT reflect('java.lang.System', 'getProperty', 'user.home'))", "SELECT transform(array(1), x -> java_method('java.lang.System', 'nanoTime')) FROM renders",
    "SELECT * FROM renders LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'user.home'))) t AS x", "SELECT 1 FROM renders ORDER BY (SELECT max(x) FROM elsewhere)", "EXPLAIN SELECT 1", "SHOW TABLES",
    "SELECT 1) UNION ALL (SELECT 2", "", "WITH elsewhere AS (SELECT * FROM renders) SELECT 1 FROM (SELECT * FROM elsewhere), parquet.`/tmp/x`", "CACHE TABLE renders", "SELECT * FROM renders TABLESAMPLE (1 ROWS), csv.`/etc/passwd`",
])
def test_hostile_statements_are_refused(spark, sql):
    assert batch(spark, sql).sql.failure.code == "bad_args"


def test_what_is_checked_is_what_runs(spark):
    out = batch(spark, "SELECT 'a/*' AS b, \"*/' AS b, value FROM text.`/etc/hostname` --\" AS c FROM forms")
    assert [tuple(r) for r in out.sql.df.collect()] == [("a/*", "*/' AS b, value FROM text.`/etc/hostname` --")]


def test_names_of_other_tables_are_taken(spark):
    spark.range(1).createOrReplaceTempView("secret_view")
    try:
        assert "taken" in batch(spark, "SELECT * FROM secret_view, (WITH secret_view AS (SELECT 1) SELECT * FROM secret_view)").sql.failure.message
    finally:
        spark.catalog.dropTempView("secret_view")


def test_queries_that_pass(spark):
    for sql in (
        "SELECT encloser FROM renders WHERE encloser = 'a--b' OR encloser = '/* x */'", "/* head */ SELECT encloser -- tail\nFROM renders -- end", "-- SELECT\nWITH a AS (SELECT 1 AS x) (SELECT x FROM a) ;", "SELECT 1 AS `drop table`, 'INSERT; --' AS s",
        "SELECT transform(collect_set(encloser), x -> upper(x)) AS a, typeof(1) AS b FROM renders", "SELECT e FROM renders LATERAL VIEW explode(array(encloser, symbol)) t AS e", "WITH a AS (SELECT encloser FROM renders), b AS (SELECT * FROM a) SELECT x.encloser FROM a x, b y",
        "WITH a AS (SELECT * FROM renders) SELECT count(*) AS n FROM a", "SELECT encloser, row_number() OVER (ORDER BY encloser) AS n FROM renders ORDER BY n LIMIT 1",
        "SELECT r.encloser FROM renders r JOIN forms f ON r.encloser = f.encloser UNION ALL SELECT encloser FROM forms", "SELECT symbol, count(*) FILTER (WHERE encloser = 'A') AS n FROM renders GROUP BY symbol HAVING count(*) > 1",
    ):
        out = batch(spark, sql)
        assert out.sql.ok, out.sql.failure
        out.sql.df.collect()


def test_bounds_and_notes(spark):
    out = batch(spark, "SELECT * FROM renders", table_rows=1)
    assert out.sql.bounded_tables == ["renders"] and out.sql.df.count() == 1 and "NOT IN" in out.sql.notes[0]
    out = batch(spark, "SELECT * FROM renders", result_rows=1)
    assert (out.sql.truncated.shown, out.sql.truncated.total) == (1, 2)


def test_schema_in_error_and_aliases(spark):
    assert "renders(symbol, encloser)" in batch(spark, "SELECT nope FROM renders").sql.failure.message
    df = spark.range(1)
    for aliases in (["select"], ["A"], ["x", "x"], ["1a"]):
        out = sqlbatch.run_batch(spark, [sqlbatch.Request("r", lambda: df, a) for a in aliases], "SELECT 1")
        assert out.sql.failure.code == "bad_args"
    assert sqlbatch.run_batch(spark, [sqlbatch.Request("r", lambda: df)], "SELECT * FROM t").sql.ok


def test_failed_producer_keeps_its_neighbours(spark):
    def fails():
        raise RuntimeError("boom")

    out = sqlbatch.run_batch(spark, [sqlbatch.Request("good", lambda: spark.range(1)), sqlbatch.Request("bad", fails)], "SELECT * FROM t0")
    assert "boom" in out.sql.failure.message and out.producers["t0"].ok and not out.producers["t1"].ok


def test_render(spark):
    df = spark.createDataFrame([(None, "a|b"), (1, "12")], "x int, y string")
    text = render.table(envelope.Envelope(df))
    assert "∅ | \"a|b\"" in text and "1 | \"12\"" in text and text.endswith("(2 rows)")
    assert json.loads(render.as_json(envelope.Envelope(df)))["rows"] == [[None, "a|b"], [1, "12"]]
    assert render.capped_bytes("é" * 10, 5) == "éé…"
    cut = envelope.cap_list(df, 1, "x")
    assert (cut.truncated.shown, cut.truncated.total) == (1, 2) and envelope.cap_list(df, 2).truncated is None
    a, b = envelope.Freshness(1, 0, ("x",), "c"), envelope.Freshness(2, 1, ("y",), "c")
    assert envelope.merged_freshness([a, b]) == envelope.Freshness(3, 1, ("x", "y"), "c")


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.ts").write_text("import a from 'a'")
    (tmp_path / "src/a.ts").write_text("import React, { useState } from 'react';\nimport './x.css';\n\nexport * from \"./b\";\nimport type { T } from 't';\nconst l = () => import('./lazy');\nt('k.a'); t(`k.${x}`); t('k.b', 1);\n<div className=\"one two\"/>; cn('three')\n")
    (tmp_path / "src/en.json").write_text('{"a": {"b": "x", "c": [1, 2]}, "d": 3}')
    (tmp_path / "src/ru.json").write_text('{"a": {"b": "y", "c": ')
    (tmp_path / "src/s.scss").write_text(".a { color: red; &:hover { color: blue !important; } .b, .c { top: 1px } } /* .no {x:y} */ :global(.g) { x: y }")
    (tmp_path / "package.json").write_text('{"name": "p", "dependencies": {"react": "1"}, "devDependencies": {"@types/t": "1"}}')
    files = repo.walk(spark, str(tmp_path))
    assert files.where("path like '%node_modules%'").count() == 0
    got = {(r["line"], r["spec"], r["imports"], r["kind"], r["type_only"]) for r in repo.imports(files.where("path like '%.ts'")).collect()}
    assert (1, "react", "React,useState", "import", False) in got and (2, "./x.css", "", "side-effect", False) in got
    assert (4, "./b", "*", "re-export", False) in got and (5, "t", "T", "import", True) in got
    assert {(r["dep"], r["section"]) for r in repo.manifests(files).collect()} == {("react", "dependencies"), ("@types/t", "devDependencies")}
    keys = {(r["locale"], r["key"], r["value"]) for r in repo.locale_keys(files.where("path like '%/src/%.json'")).where("error is null").collect()}
    assert keys == {("en", "a.b", "x"), ("en", "a.c", "[1,2]"), ("en", "d", "3"), ("ru", "a.b", "y")}
    styles = repo.styles(files.where("path like '%.scss'"))
    assert {(r["selector"], r["prop"], r["important"]) for r in styles.collect()} >= {(".a", "color", False), (".a:hover", "color", True), (".a .b", "top", False), (".a .c", "top", False)}
    assert {r["name"] for r in repo.class_names(styles).collect()} == {"a", "b", "c"}
    assert {r["token"] for r in repo.class_tokens(files.where("path like '%.ts'")).collect()} == {"one", "two", "three"}
    calls = {(r["arg"], r["dynamic"]) for r in repo.literal_calls(files.where("path like '%.ts'"), ["t"]).collect()}
    assert calls == {("k.a", False), ("k.b", False), (None, True)}
    assert repo.fingerprints(files).count() == 5
    assert repo.lines(files.where("path like '%/a.ts'")).where("line = 2").first()["text"] == "import './x.css';"


def test_endpoints(spark, tmp_path):
    (tmp_path / "api.d.ts").write_text('export interface paths {\n    "/users/{id}": {\n        get: operations["x"];\n        put?: never;\n        delete: {};\n    };\n}\n')
    got = {(r["path"], r["method"], tuple(r["path_params"]), r["confidence"]) for r in repo.endpoint_cards(repo.walk(spark, str(tmp_path))).collect()}
    assert got == {("/users/{id}", "GET", ("id",), "unresolved"), ("/users/{id}", "DELETE", ("id",), "partial")}


def tree(root):
    """A small repository: one package, two locales, sheets, an API and code that uses them."""
    put = lambda path, text: ((root / path).parent.mkdir(parents=True, exist_ok=True), (root / path).write_text(text))
    put("apps/emr/package.json", '{"name": "@a/emr", "dependencies": {"react": "1", "lodash": "4"}, "devDependencies": {"@types/geojson": "1"}}')
    put("package.json", '{"name": "root", "dependencies": {"@mui/material": "5"}}')
    put("apps/emr/src/App.tsx", """import React from 'react';
import { Button } from '@mui/material/Button';
import fp from 'lodash/fp';
import { readFile } from 'fs/promises';
import type { Point } from 'geojson';
import x from '#internal/x';
import styles from './app.module.scss';
import { helper } from './lib/helper';
export const App = ({ s }) => { t('title'); t(`App.${s}`); return <div className={clsx('one', s && 'two', { three: s })}><p className={styles.root}>{helper}</p><Button/></div>; };
// Button in a comment
""")
    put("apps/emr/src/lib/helper.ts", "import styles from '../other.scss';\nexport const helper = styles['used-one'];\nexport * from './deep';\n")
    put("apps/emr/src/lib/deep/index.ts", "export const d = () => import('@mui/material');\n")
    put("apps/emr/src/App.test.tsx", "import { App } from './App';\n")
    put("apps/emr/src/app.module.scss", ".root { color: red; composes: base from './other.scss'; }\n.dead { top: 0 }\n.panel .root { color: blue !important }\n:global(.shell) { left: 0 }\n.half { .tied { top: 1px } }\n")
    put("apps/emr/src/other.scss", ".used-one { top: 0 }\n.base { top: 0 }\n.gone { top: 0 }\n.mix { @extend .kept; }\n.kept { left: 0 }\n")
    put("locales/en.json", '{\n  "title": "Hi",\n  "App": { "a": "A" },\n  "orphan": { "neverUsed": "x" },\n  "onlyInEn": "e"\n}\n')
    put("locales/ru.json", '{\n  "App": { "a": "A" },\n  "orphan": { "neverUsed": "x" }\n}\n')
    put("locales/de.json", '{ "title": "x", ')
    put("api.d.ts", 'export interface paths {\n    "/users/{id}": {\n        get: operations["getUser"];\n        put?: never;\n        post: operations["lost"];\n    };\n}\nexport interface operations {\n    getUser: {\n        parameters: { path: { id: string }; query?: { deep: boolean } };\n        responses: { 200: { content: { "application/json": components["schemas"]["User"] } }; 404: never };\n    };\n}\n')


def test_operations_on_the_text_of_a_tree(spark, tmp_path):
    """Sources give what the operations read, with nothing put in by hand."""
    from lodestone.plans.engine import Engine

    tree(tmp_path)
    root = f"file:{tmp_path}"
    e = Engine(spark, repo.facts(spark, str(tmp_path)))

    def got(name, *columns, **args):
        out = e.run(name, **args)
        assert out.ok, (name, out.failure)
        return sorted((tuple(x.replace(f"{root}/", "") if isinstance(x, str) else x for x in r) for r in out.df.select(*columns).collect()), key=repr)

    assert got("find_phantom_deps", "package_dir", "spec", "sites") == [("apps/emr", "@mui/material", 1)]
    assert got("find_unused_i18n_keys", "key", "file", "line", "confidence") == [
        ("App.a", "locales/en.json", 3, "dynamic"), ("App.a", "locales/ru.json", 2, "dynamic"), ("onlyInEn", "locales/en.json", 5, "certain"), ("orphan.neverUsed", "locales/en.json", 4, "certain"), ("orphan.neverUsed", "locales/ru.json", 3, "certain"),
    ]
    assert got("find_missing_i18n_keys", "key", "locale", "usage_line") == [("title", "ru", 9)]
    assert got("list_endpoints", "method", "path", "path_params", "query", "response", "status", "confidence") == [
        ("GET", "/users/{id}", "id", "{ deep: boolean }", "User", 200, "certain"), ("POST", "/users/{id}", "id", None, None, None, "unresolved"),
    ]
    assert got("css_cascade", "prop", "value", "winner_selector", "important", css_class="root") == [("color", "blue", ".panel .root", 1)]
    assert got("find_unused_scss_classes", "name", "confidence") == [
        ("dead", "certain"), ("gone", "certain"), ("half", "partial"), ("kept", "partial"), ("mix", "certain"), ("panel", "partial"), ("shell", "dynamic"), ("tied", "partial"),
    ]
    assert got("importers_of", "file", "line", module=f"{root}/apps/emr/src/lib/helper.ts") == [("apps/emr/src/App.tsx", 8)]
    assert got("importers_of", "file", module=f"{root}/apps/emr/src/lib/deep/index.ts") == [("apps/emr/src/lib/helper.ts",)]
    assert got("affected", "file", "depth", files=[f"{root}/apps/emr/src/lib/deep/index.ts"]) == [("apps/emr/src/App.test.tsx", 3)]
    assert got("i18n_lookup", "key", "locale", value="Hi") == [("title", "en")]
    assert got("scss_classes", "name", file=f"{root}/apps/emr/src/app.module.scss") == [("dead",), ("half",), ("panel",), ("root",), ("shell",), ("tied",)]
    assert {r["token"] for r in e["class_tokens"].collect()} >= {"one", "two", "three"}
    assert [r["file"].rsplit("/", 1)[-1] for r in e["locale_failures"].collect()] == ["de.json"]
    needed = {name: op.needs for name, op in OPS.items() if set(op.needs) <= set(e.facts)}
    assert {"find_phantom_deps", "find_unused_i18n_keys", "find_missing_i18n_keys", "list_endpoints", "css_cascade", "importers_of", "affected", "find_unused_scss_classes", "scss_classes", "i18n_lookup", "move_file"} <= set(needed)


def test_wrapped_templates_demote_all(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.values import package_name, template_head

    texts = [("`App.${s}`", "App."), ("`App.${s}`.toLowerCase()", None), ("`a.${x}` + s", None), ("tag`a.${x}`", None), ("`${x}.y`", None), ("k", None), ("`a\\n.${x}`", None), ("`plain`", "plain"), ("`a\n${x}`", None), ("`", None), ("`a.b.${x}.c.${y}`", "a.b.")]
    rows = spark.createDataFrame(texts, "text string, head string")
    assert [(r["text"], r["h"]) for r in rows.select("text", template_head(F.col("text")).alias("h")).collect()] == texts
    names = [("@mui/material/Button", "@mui/material"), ("lodash/fp", "lodash"), ("react", "react"), ("@a/b", "@a/b")]
    assert [(r["s"], r["n"]) for r in spark.createDataFrame(names, "s string, n string").select("s", package_name(F.col("s")).alias("n")).collect()] == names


def test_refresh_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "path string, mtime_ms long, size long, removed boolean"
    spark.createDataFrame([("a", 1, 10, False), ("b", 1, 20, False), ("a", 2, 11, False)], kind).coalesce(1).write.parquet(src)
    refresh.follow(spark, src, kind, out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", 3, 20, True), ("c", 3, 30, False)], kind).coalesce(1).write.mode("append").parquet(src)
    refresh.follow(spark, src, kind, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["path"], r["size"]) for r in spark.read.parquet(f"{out}/v1").collect())
    assert got == [("a", 11), ("c", 30)]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    sql = registry.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    canon = lambda rows: sorted(map(repr, rows))
    assert canon(tuple(r) for r in got.select(*columns).collect()) == canon(want.select(*[f'"{c}"' for c in columns]).fetchall())
