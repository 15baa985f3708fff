"""The masking scanner and what is read off masked text."""

import random
import re

import pytest

from lodestone.operators import modules
from lodestone.plans.engine import Engine
from lodestone.sources import program_text as p

TEXT = """import a from './a'; // import c from 'no'
/* import x from 'ghost-pkg' */
const s = `import y from 'ghost2' ${ import('./dyn') } tail ${`in ${f("}")} `} end`;
import def, { b as c, type T } from "./b"
import type { Q } from './q'
import * as ns from './ns'
import './side'
const m = import('./d'); const r = require('./r'); import z = require('./z');
const q = import(expr); obj.import('./no'); x = a / b / c; re = /import k from 'no2'/g; if (/['"]/.test(x)) {}
export * from './s'
export * as st from './st'
export { k as n, default as D } from './k'
export { own as other, plain }
export default function Main() { return <div>it's {t('real.key')} </div> }
export const { p, o: oo } = f(), z2 = 1
export const fn = async () => 1
export class K {} export interface I {}
let s2 = 'import v from "no3"'; return /x'y/.test(s2)
// t('dead.key')
/* t(dyn) */
t("a.b", { x: 1 }); t(`k.${v}`); t(cond ? 'a' : 'b', f(1, 2)); t(); ot('x'); t ('sp'); i18n.t('no')
"""


def test_imports_of_code_only():
    got = [(TEXT.count("\n", 0, r[0]) + 1, r[1], r[4]) for r in p.import_statements(TEXT)]
    assert got == [
        (1, "./a", "import"), (3, "./dyn", "dynamic"), (4, "./b", "import"), (5, "./q", "import"), (6, "./ns", "import"), (7, "./side", "side-effect"), (8, "./d", "dynamic"), (8, "./r", "require"),
        (8, "./z", "require"), (9, None, "computed"), (10, "./s", "re-export"), (11, "./st", "re-export"), (12, "./k", "re-export"),
    ]
    bound = {r[1]: r[5] for r in p.import_statements(TEXT)}
    assert bound["./b"] == [("b", "c"), ("T", "T"), ("default", "def")] and bound["./ns"] == [("*", "ns")]
    assert bound["./s"] == [("*", "*")] and bound["./st"] == [("*", "st")] and bound["./k"] == [("k", "n"), ("default", "D")]


def test_exports_and_calls_of_code_only():
    assert [r[1:] for r in p.export_statements(TEXT)] == [
        ("other", "own", "list"), ("plain", "plain", "list"), ("default", "Main", "function"), ("p", "p", "const"), ("oo", "oo", "const"), ("fn", "fn", "const"), ("K", "K", "class"), ("I", "I", "interface"),
    ]
    assert [r[2:] for r in p.calls(TEXT, re.compile(r"(?<![\w$.])(t)\s*\(\s*"))] == [
        ("real.key", "'real.key'"), ("a.b", '"a.b"'), (None, "`k.${v}`"), (None, "cond ? 'a' : 'b'"), ("sp", "'sp'"),
    ]


def test_masked_text_keeps_every_place():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice(["'", '"', "`", "${", "}", "{", "/", "/*", "*/", "//", "\n", "\\", "a", " ", "return ", "<"]) for _ in range(random.randint(0, 60)))
        for strings in (True, False):
            got = p.masked(text, strings)
            assert len(got) == len(text) and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        ends = [x for _, a, b in p.spans(text) for x in (a, b)]
        assert ends == sorted(ends) and all(0 <= x <= len(text) for x in ends)


@pytest.mark.parametrize("text", ["'" * 50_000, "/" * 50_000, "`${" * 20_000, "{" * 50_000 + "}" * 50_000, "a/b" * 30_000, "t('x')" * 20_000])
def test_long_odd_texts_end(text):
    assert len(p.masked(text)) == len(text)
    p.import_statements(text)


def test_sources_run_on_files(spark, tmp_path):
    from lodestone.sources import repo

    (tmp_path / "a.ts").write_text(TEXT)
    (tmp_path / "b.ts").write_text("export const b = 1, T = 2;\nexport default 3\n")
    (tmp_path / "k.ts").write_text("export const k = 1; export const dead = 2; export const whole = 3\n")
    (tmp_path / "ns.ts").write_text("export function seen() {}\n")
    facts = repo.facts(spark, str(tmp_path))
    assert {r["spec"] for r in facts["imports"].collect()} == {"./a", "./dyn", "./b", "./q", "./ns", "./side", "./d", "./r", "./z", None, "./s", "./st", "./k"}
    assert [(r["arg"], r["line"]) for r in facts["literal_calls"].orderBy("line").collect()][:1] == [("real.key", 14)]
    assert {r["name"] for r in facts["exports"].where("file like '%/b.ts'").collect()} == {"b", "default"}
    taken = modules.taken_names(facts["imports"])
    resolved = modules.resolved_exports(facts["exports"], taken)
    names = {(r["name"], r["origin"].rsplit("/", 1)[-1], r["origin_name"]) for r in resolved.where("module like '%/a.ts'").collect()}
    assert {("n", "k.ts", "k"), ("other", "a.ts", "other"), ("default", "a.ts", "default")} <= names


def barrels(spark):
    exports = [("a.ts", "x", "x"), ("a.ts", "default", "A"), ("a.ts", "y", "y"), ("lib.ts", "own", "own"), ("index.ts", "y", "y2"), ("u.ts", "z", "z"), ("solo.ts", "gone", "gone")]
    take = lambda f, to, kind, *names: (f, to, kind, [{"name": a, "local": b} for a, b in names], kind == "dynamic", kind == "re-export" and ("*", "*") in names)
    imports = [
        take("lib.ts", "a.ts", "re-export", ("*", "*")), take("index.ts", "lib.ts", "re-export", ("*", "*")), take("lib.ts", "index.ts", "re-export", ("*", "*")),
        take("index.ts", "u.ts", "re-export", ("z", "zed")), take("main.ts", "index.ts", "import", ("x", "x1"), ("zed", "zed")), take("other.ts", "index.ts", "re-export", ("*", "all")), take("last.ts", "other.ts", "import", ("all", "all")),
        take("lazy.ts", "solo.ts", "dynamic", ("*", "*")),
    ]
    made = spark.createDataFrame(imports, "file string, resolved string, kind string, bindings array<struct<name:string,local:string>>, dynamic boolean, star_reexport boolean")
    return spark.createDataFrame(exports, "file string, name string, local string"), made


def test_exports_through_barrels_renames_and_cycles(spark):
    exports, imports = barrels(spark)
    taken = modules.taken_names(imports)
    resolved = modules.resolved_exports(exports, taken)
    got = {tuple(r) for r in resolved.collect()}
    assert {("index.ts", "x", "a.ts", "x"), ("lib.ts", "x", "a.ts", "x"), ("index.ts", "zed", "u.ts", "z"), ("index.ts", "y", "index.ts", "y"), ("lib.ts", "y", "a.ts", "y"), ("other.ts", "all", "index.ts", "*")} <= got
    assert ("index.ts", "default", "a.ts", "default") not in got and ("index.ts", "y", "a.ts", "y") not in got and ("lib.ts", "own", "lib.ts", "own") in got
    uses = {(r["origin"], r["origin_name"], r["file"], r["whole"]) for r in modules.export_uses(resolved, taken).collect()}
    assert ("a.ts", "x", "main.ts", False) in uses and ("u.ts", "z", "main.ts", False) in uses and ("a.ts", "x", "last.ts", True) in uses
    assert ("solo.ts", "gone", "lazy.ts", True) in uses


def test_no_false_certain_of_unused_exports(spark):
    exports, imports = barrels(spark)
    symbols = spark.createDataFrame([(f"{f}:{n}", n, "const", f, 1, 1, True) for f, n, _ in exports.collect()] + [("q.ts:q", "q", "const", "q.ts", 1, 1, True), ("w.ts:w", "w", "const", "w.ts", 1, 1, True)], "id string, name string, kind string, file string, line int, col int, exported boolean")
    refs = spark.createDataFrame([("q.ts:q", "reexport", "q.ts"), ("w.ts:w", "reexport", "v.ts")], "symbol_id string, role string, file string")

    def run(undiscovered=(), extra=()):
        more = spark.createDataFrame(list(extra), imports.schema) if extra else imports.limit(0)
        out = Engine(spark, {"symbols": symbols, "refs": refs, "imports": imports.unionByName(more), "exports": exports}, undiscovered=undiscovered).run("find_unused_exports")
        assert out.ok, out.failure
        return {r["symbol"]: (r["confidence"], r["note"]) for r in out.df.collect()}

    got = run()
    # Used by name through two modules, under another name: not reported. A re-export at home is no sign.
    assert "a.ts:x" not in got and "u.ts:z" not in got and got["q.ts:q"] == ("certain", None)
    assert got["w.ts:w"][0] == got["a.ts:y"][0] == got["lib.ts:own"][0] == got["solo.ts:gone"][0] == "partial"
    assert "dynamically" in got["solo.ts:gone"][1] and "re-exported" in got["w.ts:w"][1]
    assert got["a.ts:default"][0] == "partial"
    computed = run(extra=[("c.ts", None, "computed", [{"name": "*", "local": "*"}], True, False)])
    assert computed["q.ts:q"] == ("partial", dict(modules.REASONS)["computed"])
    assert run(["tsconfig.e2e.json"])["q.ts:q"][0] == "partial"
