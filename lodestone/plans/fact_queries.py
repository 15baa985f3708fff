"""Operations that read source text or keep state, on facts that stand for the driver's tables, each
with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import catalogue, changes, graph, modules, positions, walks
from lodestone.plans.engine import Engine
from lodestone.plans.registry import register
from lodestone.sources import program_text


def _t(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _files(parts: DataFrame, *pieces) -> DataFrame:
    """(path, content) of a program file for each part; pieces are text or columns."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return parts.select(F.concat(F.lit("f"), _text("p_partkey"), F.lit(".ts")).alias("path"), text.cast("binary").alias("content"))


@register("source_imports", """
WITH p AS (SELECT 'f' || p_partkey || '.ts' AS file, p_partkey AS k, p_size AS s FROM part)
SELECT file, CAST(3 AS INTEGER) AS line, './m' || s AS spec, 'import' AS kind, 'x' || s || ' as y,z' AS imports, FALSE AS star FROM p
UNION ALL SELECT file, 4, './dyn' || s, 'dynamic', '', FALSE FROM p
UNION ALL SELECT file, 5, './star' || s, 're-export', '*', TRUE FROM p WHERE k % 3 = 0
UNION ALL SELECT file, 6, './r' || k, 'require', '', FALSE FROM p
UNION ALL SELECT file, 7, NULL, 'computed', '', FALSE FROM p WHERE k % 5 = 0""")
def source_imports(spark, sf):
    """A program file for each part: imports in code, in comments, strings and templates."""
    part = _t(spark, sf, "part").select("p_partkey", "p_size")
    k, s = _text("p_partkey"), _text("p_size")
    star = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('export * from "./star'), s, F.lit('";\n'))).otherwise("const s = \"import w from 'no'\";\n")
    computed = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("import(p"), k, F.lit(");\n"))).otherwise("")
    files = _files(
        part, "// import a from 'c", k, "'\n/* export * from 'd", k, "' */\nimport { x", s, " as y, z } from './m", s, "';\nconst t = `import q from 'e", k, "' ${import('./dyn", s, "')}`;\n",
        star, "const r = require('./r", k, "'); obj.import('./no'); q = a / b / 'import v from \"no\"';\n", computed,
    )
    return program_text.imports(files).select("file", "line", "spec", "kind", "imports", F.col("star_reexport").alias("star"))


@register("source_calls", """
WITH p AS (SELECT 'f' || p_partkey || '.ts' AS file, p_partkey AS k, p_size AS s FROM part)
SELECT file, CAST(2 AS BIGINT) AS line, 'k.' || s AS arg, FALSE AS dynamic, '''k.' || s || '''' AS text FROM p
UNION ALL SELECT file, 3, NULL, TRUE, '`d.${v' || k || '}`' FROM p UNION ALL SELECT file, 4, 'q' || k, FALSE, '"q' || k || '"' FROM p
UNION ALL SELECT file, 5, 'it.' || s, FALSE, '''it.' || s || '''' FROM p""")
def source_calls(spark, sf):
    """Calls of ``t`` in code, templates and JSX, among such in comments and strings."""
    k, s = _text("p_partkey"), _text("p_size")
    files = _files(
        _t(spark, sf, "part").select("p_partkey", "p_size"), "// t('dead", k, "')\n/* t(dyn) */ t('k.", s, "', 1)\nx = `t('no') ${t(`d.${v", k, "}`)}`; ot('no'); x.t('no')\n\"t('str')\"; t(\"q", k,
        "\"); t(); /t('re')/.test(x)\n<p>it's {t('it.", s, "')} </p>\n",
    )
    return program_text.literal_calls(files, ["t"]).select("file", "line", "arg", "dynamic", "text")


@register("export_resolution", """
WITH RECURSIVE c AS (SELECT c_custkey AS c FROM customer),
own AS (SELECT c, 'o' || (c % 7) AS n FROM c UNION SELECT c, 'default' FROM c WHERE c % 10 = 0),
e AS (SELECT c, 'r' || (c % 5) AS n, c // 2 AS s, 'o' || ((c // 2) % 7) AS sn FROM c WHERE c % 3 = 0 AND c > 1
      UNION SELECT c, NULL, c // 2, NULL FROM c WHERE c % 4 IN (1, 3) AND c > 1 UNION SELECT 1, NULL, 7, NULL),
named AS (SELECT c, n FROM own UNION SELECT c, n FROM e WHERE n IS NOT NULL),
r AS (SELECT c AS m, n, c AS o, n AS onn FROM own
      UNION SELECT e.c, coalesce(e.n, r.n), r.o, r.onn FROM r JOIN e ON e.s = r.m LEFT JOIN named k ON k.c = e.c AND k.n = r.n
      WHERE e.sn = r.n OR (e.sn IS NULL AND r.n <> 'default' AND k.c IS NULL))
SELECT 'm' || m AS module, n AS name, 'm' || o AS origin, onn AS origin_name FROM r""")
def export_resolution(spark, sf):
    """Customers as modules: some list a name of module c/2 under another name, some pass on all of it,
    and 1, 3 and 7 pass on each other."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("c"))
    module = lambda x: F.concat(F.lit("m"), x.cast("string"))
    half = F.floor(F.col("c") / 2)
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    exports = c.select(module(F.col("c")).alias("file"), name("o", F.col("c") % 7).alias("name")).unionByName(c.where("c % 10 = 0").select(module(F.col("c")).alias("file"), F.lit("default").alias("name"))).withColumn("local", F.col("name"))
    takes = lambda rows, source, n, local: rows.select(module(F.col("c")).alias("file"), module(source).alias("resolved"), F.lit("re-export").alias("kind"), F.array(F.struct(n.alias("name"), local.alias("local"))).alias("bindings"))
    star = F.lit("*")
    stars = takes(c.where("c % 4 in (1, 3) and c > 1"), half, star, star).unionByName(takes(c.where("c = 1"), F.lit(7), star, star))
    listed = takes(c.where("c % 3 = 0 and c > 1"), half, name("o", half % 7), name("r", F.col("c") % 5))
    return modules.resolved_exports(exports, modules.taken_names(listed.unionByName(stars)))


@register("unused_exports_ladder", f"""
WITH s AS (SELECT p_partkey AS id, 'p' || p_partkey AS name, 'm' || (p_partkey % 40) AS file FROM part WHERE p_size > 5),
r AS (SELECT l_partkey AS id, l_returnflag AS f, 'm' || (l_suppkey % 40) AS place FROM lineitem WHERE l_quantity >= 45),
i AS (SELECT 'm' || (s_suppkey % 40) AS file, 'm' || s_nationkey AS target, s_nationkey IN (3, 7) AS dyn, s_nationkey IN (11, 13) AS star FROM supplier),
d AS (SELECT s.*, EXISTS (SELECT 1 FROM r WHERE r.id = s.id AND f = 'R' AND place <> s.file) AS barrel, EXISTS (SELECT 1 FROM i WHERE target = s.file AND i.file <> s.file AND dyn) AS dyn,
  EXISTS (SELECT 1 FROM i WHERE target = s.file AND i.file <> s.file AND star) AS star FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = s.id AND f = 'A'))
SELECT name, file, CASE WHEN barrel OR dyn OR star THEN 'partial' ELSE 'certain' END AS confidence,
  CASE WHEN barrel THEN '{dict(modules.REASONS)["barrel"]}' WHEN dyn THEN '{dict(modules.REASONS)["dynamic"]}' WHEN star THEN '{dict(modules.REASONS)["star"]}' END AS note FROM d""")
def unused_exports_ladder(spark, sf):
    """The operation itself: parts as exports of 40 modules, line items as references and re-exports,
    suppliers as imports, some dynamic or of everything."""
    module = lambda x: F.concat(F.lit("m"), x.cast("string"))
    symbols = _t(spark, sf, "part").select(
        _text("p_partkey").alias("id"), F.concat(F.lit("p"), _text("p_partkey")).alias("name"), F.lit("const").alias("kind"), module(F.col("p_partkey") % 40).alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"), (F.col("p_size") > 5).alias("exported")
    )
    role = F.when(F.col("l_returnflag") == "R", "reexport").when(F.col("l_returnflag") == "A", "call").otherwise("decl")
    refs = _t(spark, sf, "lineitem").where("l_quantity >= 45").select(_text("l_partkey").alias("symbol_id"), role.alias("role"), module(F.col("l_suppkey") % 40).alias("file"))
    nation = F.col("s_nationkey")
    imports = _t(spark, sf, "supplier").select(module(F.col("s_suppkey") % 40).alias("file"), module(nation).alias("resolved"), nation.isin(3, 7).alias("dynamic"), nation.isin(11, 13).alias("star_reexport"))
    out = Engine(spark, {"symbols": symbols, "refs": refs, "imports": imports}).run("find_unused_exports")
    if not out.ok:
        raise ValueError(out.failure.message)
    return out.df.select("name", "file", "confidence", "note")


_DEPTH, _NODES, _FAN_OUT = 3, 100, 3


def _level(i: int) -> str:
    """SQL of one level: rows found from the level before, in order, and those that fit under the cap."""
    seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(i))
    return f"""
f{i} AS (SELECT dst AS node, min(struct_pack(place := b.place, m := -g.n, src := g.src, roles := g.roles, kind := g.kind, called := t.called)) AS x FROM l{i - 1} b JOIN g ON g.src = b.node AND g.rank <= {_FAN_OUT} JOIN t ON t.src = b.node
  WHERE b.kind <> 'module' AND g.dst NOT IN ({seen}) GROUP BY 1),
o{i} AS (SELECT node, row_number() OVER (ORDER BY x.place, x.m, node) AS place, x FROM f{i}),
l{i} AS (SELECT node, place, x.kind AS kind, x.roles AS roles, x.src AS parent, x.called AS called, x.place AS from_, {i} AS depth FROM o{i} WHERE place <= {_NODES} - (SELECT count(*) FROM ({seen})) + (SELECT count(*) FROM l0))"""


@register("impact_walk", f"""
WITH r AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CASE b.l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'call' ELSE 'import' END AS role
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_quantity >= 35 AND b.l_quantity >= 35),
g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM
  (SELECT src, dst, list_sort(list_distinct(list(role))) AS roles, count(*) AS n, CASE WHEN dst % 5 = 0 THEN 'module' ELSE 'function' END AS kind FROM r GROUP BY 1, 2)),
t AS (SELECT src, count(*) AS total, bool_or(list_contains(roles, 'call')) AS called FROM g GROUP BY 1),
l0 AS (SELECT node, row_number() OVER (ORDER BY node) AS place, '' AS kind, [] AS roles, CAST(NULL AS BIGINT) AS parent, FALSE AS called, CAST(0 AS BIGINT) AS from_, 0 AS depth
  FROM (SELECT DISTINCT src AS node FROM g ORDER BY 1 LIMIT 10)),{",".join(_level(i) for i in range(1, _DEPTH + 1))},
every AS ({" UNION ALL ".join(f"SELECT node, depth, place, roles, parent, kind, called, from_ FROM l{i}" for i in range(1, _DEPTH + 1))}),
cut AS (SELECT max(depth) AS deepest, count(*) AS n, max(from_) FILTER (WHERE depth = (SELECT max(depth) FROM every)) AS last FROM every),
b AS (SELECT every.*, CASE WHEN n >= {_NODES} AND (depth = deepest OR depth = deepest - 1 AND place > last) THEN 'nodes' WHEN n < {_NODES} AND depth = {_DEPTH} THEN 'depth' END AS boundary FROM every, cut)
SELECT node, CAST(depth AS INTEGER) AS depth, array_to_string(roles, ',') AS roles, parent, CASE WHEN boundary IS NULL AND kind <> 'module' THEN coalesce(total, 0) END AS group_total,
  boundary IS NULL AND kind <> 'module' AS expanded, boundary, boundary IS NULL AND kind = 'module' AND len(list_filter(roles, lambda x: x NOT IN ('import', 'reexport'))) > 0 AS dead_end,
  boundary IS NULL AND kind <> 'module' AND coalesce(total, 0) > {_FAN_OUT} AS hub, CASE WHEN b.called AND len(list_filter(roles, lambda x: x NOT IN ('read', 'write'))) = 0 THEN parent END AS reads_as_value
FROM b LEFT JOIN t ON t.src = b.node""")
def impact_walk(spark, sf):
    """Parts bought together as symbols and enclosers, cut in the middle of a level, with all that is told
    of each node."""
    line = _t(spark, sf, "lineitem").where("l_quantity >= 35").select("l_orderkey", "l_partkey", "l_returnflag")
    a, b = line.alias("a"), line.alias("b")
    role = F.when(F.col("b.l_returnflag") == "R", "read").when(F.col("b.l_returnflag") == "A", "call").otherwise("import")
    refs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") != F.col("b.l_partkey"))).select(
        F.col("a.l_partkey").alias("symbol_id"), F.col("b.l_partkey").alias("encloser_id"), role.alias("role"), F.when(F.col("b.l_partkey") % 5 == 0, "module").otherwise("function").alias("encloser_kind")
    )
    groups = walks.dependents(refs)
    seeds = groups.select(F.col("src").alias("node")).distinct().orderBy("node").limit(10)
    return walks.dependents_walk(groups, seeds, _DEPTH, _NODES, _FAN_OUT).nodes.withColumn("roles", F.array_join("roles", ",")).drop("n")


@register("invalidation_chain", """
WITH RECURSIVE e AS (SELECT r_name AS m, n_name AS k, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 1),
q AS (SELECT k, 'c' || c_custkey AS q, 'h' || (c_custkey % 60) AS h FROM e JOIN customer ON c_nationkey = n_nationkey),
d AS (SELECT DISTINCT c_custkey % 60 AS i FROM customer),
u AS (SELECT 'h' || i AS h, 'h' || (i // 2) AS v, 'hook' AS kind FROM d WHERE i >= 8 UNION SELECT 'h' || i, 'C' || (i % 10), 'component' FROM d WHERE i < 16 UNION SELECT 'h4', 'h9', 'hook'),
w AS (SELECT h AS node, 'hook' AS kind FROM q UNION SELECT v, u.kind FROM w JOIN u ON u.h = w.node WHERE w.kind = 'hook')
SELECT m AS "from", 'invalidates' AS relation, k AS "to", 'certain' AS confidence FROM e UNION SELECT k, 'affects', q, 'partial' FROM q UNION SELECT q, 'in', h, 'certain' FROM q
UNION SELECT h, 'used-by', v, 'certain' FROM u WHERE h IN (SELECT node FROM w)
UNION SELECT node, 'mounted-at', event_type || ' ' || node, 'certain' FROM w, (SELECT DISTINCT event_type FROM events) WHERE kind = 'component'""")
def invalidation_chain(spark, sf):
    """Customers as queries in hooks that are used by hooks, two of which use each other, until components."""
    nation = _t(spark, sf, "nation")
    edges = _t(spark, sf, "region").where("r_regionkey = 1").join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("mutation"), F.col("n_name").alias("key"), F.lit("certain").alias("confidence"))
    people = _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    query, i = F.concat(F.lit("c"), _text("c_custkey")), F.col("i")
    hook = lambda x: F.concat(F.lit("h"), x.cast("string"))
    affects = people.select(F.col("n_name").alias("key"), query.alias("query"), F.lit("partial").alias("confidence"))
    hosts = people.select(query.alias("query"), hook(F.col("c_custkey") % 60).alias("host"), F.lit("hook").alias("kind"))
    each = people.select((F.col("c_custkey") % 60).alias("i")).distinct()
    uses = each.where("i >= 8").select(hook(i).alias("host"), hook(F.floor(i / 2)).alias("user"), F.lit("hook").alias("kind"))
    uses = uses.unionByName(each.where("i < 16").select(hook(i).alias("host"), F.concat(F.lit("C"), (i % 10).cast("string")).alias("user"), F.lit("component").alias("kind")))
    uses = uses.unionByName(each.where("i = 4").select(hook(i).alias("host"), hook(F.lit(9)).alias("user"), F.lit("hook").alias("kind")))
    sites = _t(spark, sf, "events").select("event_type").distinct()
    shown = F.concat(F.lit("C"), (i % 10).cast("string"))
    mounts = each.where("i < 16").select(shown.alias("host")).distinct().join(sites).select("host", F.concat("event_type", F.lit(" "), "host").alias("site"))
    return graph.trace_invalidation(edges, affects, hosts, mounts, uses).select("from", "relation", "to", "confidence")


@register("cascade_reasons", """
WITH r AS (SELECT p_partkey AS k, 'f' || (p_partkey % 3) AS file, p_brand AS prop, p_name AS value, p_partkey % 11 = 0 AS imp, p_partkey % 7 AS v, p_size > 40 AS media, p_size % 9 = 0 AS comp FROM part),
s AS (SELECT *, CASE v WHEN 0 THEN '.c' WHEN 1 THEN '.c:hover' WHEN 2 THEN '.box .c' WHEN 3 THEN 'a.c' WHEN 4 THEN '.c.d' WHEN 5 THEN '.c[x]' ELSE '.c:not(.e)' END AS selector,
  CASE WHEN v IN (1, 2, 4, 5, 6) THEN 2 ELSE 1 END AS b, CASE WHEN v = 3 THEN 1 ELSE 0 END AS c,
  concat_ws('; ', CASE v WHEN 1 THEN 'holds in a state or place only (a pseudo-class)' WHEN 2 THEN 'needs another element around or before it' WHEN 5 THEN 'holds with an attribute only'
    WHEN 6 THEN 'excludes elements by :not()' WHEN 3 THEN 'holds for one element type only' END, CASE WHEN media THEN 'holds under @media print only' END, CASE WHEN v = 4 THEN 'the element must also have .d' END,
    CASE WHEN comp THEN 'its value is computed and given as written' END) AS why FROM r),
l AS (SELECT *, row_number() OVER (PARTITION BY prop, file ORDER BY imp DESC, b DESC, c DESC, k DESC) AS n FROM s),
t AS (SELECT *, dense_rank() OVER (PARTITION BY prop ORDER BY imp DESC, b DESC, c DESC) AS d FROM l WHERE n = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY file) AS f, count(*) OVER (PARTITION BY prop) AS ties FROM t WHERE d = 1),
x AS (SELECT *, concat_ws('; ', CASE WHEN ties > 1 THEN 'ties with ' || (ties - 1) || ' other modules, whose order is not known' END, CASE WHEN file <> 'f1' THEN 'of another module' END, CASE WHEN why <> '' THEN why END) AS note FROM w WHERE f = 1)
SELECT prop, value, '0,' || b || ',' || c AS specificity, file AS winner_file, selector AS winner_selector, CAST(imp AS BIGINT) AS important,
  CASE WHEN note = '' THEN 'certain' ELSE 'partial' END AS confidence, CASE WHEN note <> '' THEN note END AS note FROM x""")
def cascade_reasons(spark, sf):
    """The operation itself: parts as rules of three sheets for one class, under conditions of every kind."""
    part = _t(spark, sf, "part")
    v = F.col("p_partkey") % 7
    forms = (".c", ".c:hover", ".box .c", "a.c", ".c.d", ".c[x]", ".c:not(.e)")
    conditions = ([], [":hover"], [".box"], [], [], ["[x]"], [":not(.e)"])
    pick = lambda options, make: F.element_at(F.array(*[make(x) for x in options]), (v + 1).cast("int"))
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    base = part.select(
        F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("file"), F.col("p_partkey").alias("rule_ix"), pick(forms, F.lit).alias("selector"), F.lit(0).alias("a"), F.when(v.isin(1, 2, 4, 5, 6), 2).otherwise(1).alias("b"),
        F.when(v == 3, 1).otherwise(0).alias("c"), F.when(v == 4, texts(["c", "d"])).otherwise(texts(["c"])).alias("subject_classes"), pick(conditions, texts).alias("conditions"), F.when(F.col("p_size") > 40, texts(["@media print"])).otherwise(texts([])).alias("at_context"),
        F.lit(False).alias("global"), F.lit(False).alias("interpolated"), F.col("p_brand").alias("prop"), F.col("p_name").alias("value"), (F.col("p_partkey") % 11 == 0).alias("important"), (F.col("p_size") % 9 == 0).alias("computed"), F.col("p_partkey").alias("pos"),
    )
    rules = base.drop("prop", "value", "important", "computed", "pos")
    out = Engine(spark, {"css_rules": rules, "css_decls": base.select("file", "rule_ix", "prop", "value", "important", "computed", "pos")}).run("css_cascade", css_class="c", file="f1")
    if not out.ok:
        raise ValueError(out.failure.message)
    return out.df


@register("position_index", """
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), 'q', '😀') AS t FROM documents),
p AS (SELECT doc_id, left(t, (doc_id * 37) % (length(t) + 1)) AS h FROM d), l AS (SELECT *, string_split(h, chr(10))[-1] AS tail FROM p)
SELECT doc_id, CAST(2 * length(h) - length(replace(h, '😀', '')) AS BIGINT) AS start, CAST(1 + length(h) - length(replace(h, chr(10), '')) AS BIGINT) AS line,
  CAST(2 * length(tail) - length(replace(tail, '😀', '')) + 1 AS BIGINT) AS col FROM l""")
def position_index(spark, sf):
    """A place in each document, whose every q is a sign of two units, and back to its offset."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.replace(F.coalesce("text", F.lit("")), F.lit("q"), F.lit("😀")).alias("text"))
    head = F.substring(F.col("text"), F.lit(1), ((F.col("file") * 37) % (F.length("text") + 1)).cast("int"))
    wide = F.length(head) * 2 - F.length(F.replace(head, F.lit("😀"), F.lit("")))
    lines = positions.line_index(docs.withColumn("file", F.col("file").cast("string")))
    asked = docs.select(F.col("file").alias("ref_id"), F.col("file").cast("string").alias("file"), wide.cast("long").alias("start"))
    back = positions.offsets_of(positions.located(asked, lines), lines)
    return back.select(F.col("ref_id").alias("doc_id"), F.col("offset").alias("start"), "line", "col")


@register("config_membership", """
WITH f AS (SELECT 'r' || (p_partkey % 5) || '/n' || (p_partkey % 25) || '/p' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END AS file,
  p_partkey % 5 AS r, p_partkey % 25 AS n, CAST(p_partkey AS VARCHAR) AS k, p_size % 3 < 2 AS code FROM part)
SELECT file, CASE WHEN NOT code THEN '(no tsconfig)' WHEN k LIKE '1%' OR file = 'r0/n0/p0.ts' THEN 'r' || r || '/n' || n || '/tsconfig.json' WHEN n <> r THEN 'r' || r || '/tsconfig.json' ELSE '(no tsconfig)' END AS config FROM f""")
def config_membership(spark, sf):
    """Parts as files in folders of 5 by 25, with a config for each region and one below for each nation."""
    k = F.col("p_partkey")
    end = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, ".tsx").otherwise(".js")
    number = lambda x: x.cast("string")
    files = _t(spark, sf, "part").select(F.concat(F.lit("r"), number(k % 5), F.lit("/n"), number(k % 25), F.lit("/p"), number(k), end).alias("path"))
    texts = lambda *xs: F.array(*xs).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    configs = _t(spark, sf, "region").select(F.concat(F.lit("r"), number(r), F.lit("/tsconfig.json")).alias("config"), none.alias("include"), texts(F.concat(F.lit("n"), number(r))).alias("exclude"), none.alias("files"))
    configs = configs.unionByName(_t(spark, sf, "nation").select(
        F.concat(F.lit("r"), number(n % 5), F.lit("/n"), number(n), F.lit("/tsconfig.json")).alias("config"), texts(F.lit("./p1*")).alias("include"), none.alias("exclude"), texts(F.lit("p0.ts")).alias("files")
    ))
    members, why = catalogue.config_members(configs, files)
    if why:
        raise ValueError(why)
    return catalogue.primary_config(files.select(F.col("path").alias("file")), members)


@register("composed_edits", """
WITH e AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT o AS file, CAST(n * 10 AS BIGINT) AS "begin", CAST(n * 10 + n % 3 AS BIGINT) AS "end", repeat('x', (q % 5)::INT) AS text FROM e
UNION ALL SELECT o, n * 10 + 5, n * 10 + 7, 'y' || n FROM e WHERE q % 2 = 0""")
def composed_edits(spark, sf):
    """Lines of an order as edits of its text, and edits between them whose places count their growth."""
    n, q = F.col("l_linenumber").cast("long"), F.col("q")
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("q"))
    first = lines.select(F.col("l_orderkey").alias("file"), (n * 10).alias("begin"), (n * 10 + n % 3).alias("end"), F.expr("repeat('x', int(q % 5))").alias("text"), n.alias("n"), "q")
    growth = first.alias("a").join(first.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.n") <= F.col("a.n"))).groupBy("a.file", "a.n", "a.q").agg(F.sum(F.length("b.text") - (F.col("b.end") - F.col("b.begin"))).alias("grown"))
    place = F.col("n") * 10 + 5 + F.col("grown")
    then = growth.where(q % 2 == 0).select("file", place.alias("begin"), (place + 2).alias("end"), F.concat(F.lit("y"), F.col("n").cast("string")).alias("text"))
    plan, conflicts = changes.composed(first.select("file", "begin", "end", "text"), then)
    if conflicts.limit(1).count():
        raise ValueError("plans of one order overlap")
    return plan.select("file", "begin", "end", "text")


_OWN = """
WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_custkey % 9 AS f, c_custkey % 5 AS k, c_custkey % 4 AS p, c_nationkey AS n FROM customer),
up AS (SELECT id, parent AS at FROM c WHERE parent IS NOT NULL UNION ALL SELECT up.id, c.parent FROM up JOIN c ON c.id = up.at WHERE c.f <> 0 AND c.parent IS NOT NULL),
own AS (SELECT up.id, up.at AS owner FROM up JOIN c ON c.id = up.at WHERE c.f = 0)"""


@register("query_registry_edges", _OWN + """
SELECT owner AS mutation_id, c.id, CASE f WHEN 3 THEN 'invalidateQueries' WHEN 4 THEN 'refetchQueries' ELSE 'removeQueries' END AS method, p IN (0, 3) AS is_all, p = 2 AS is_exact, p = 3 AS narrowed,
  CASE k WHEN 1 THEN 'todos.' || n WHEN 2 THEN 'todos.*' WHEN 3 THEN 'k' || n END AS key, CASE WHEN k = 4 THEN 'call' END AS opaque, CASE k WHEN 0 THEN 'unresolved' WHEN 4 THEN 'dynamic' WHEN 2 THEN 'partial' ELSE 'certain' END AS confidence
FROM c JOIN own USING (id) WHERE f IN (3, 4, 5)""")
def query_registry_edges(spark, sf):
    """Customers as a tree of calls: the invalidations and the mutation around each, with keys and filters of
    every kind."""
    from lodestone.operators import classify

    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    names = {0: "useMutation", 1: "useQuery", 2: "useInfiniteQuery", 3: "invalidateQueries", 4: "refetchQueries", 5: "removeQueries"}
    callee = F.element_at(F.create_map(*[F.lit(x) for i in range(9) for x in (i, names.get(i, "other"))]), (c % 9).cast("int"))
    part = lambda kind, value=None: F.struct(F.lit(kind).alias("kind"), (F.lit(value).cast("string") if value is None or isinstance(value, str) else value).alias("value"))
    shape_kind = "struct<kind:string,value:string,elements:array<struct<kind:string,value:string>>>"
    shape = lambda kind, value, elements: F.struct(F.lit(kind).alias("kind"), value.alias("value"), elements.alias("elements")).cast(shape_kind)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<struct<kind:string,value:string>>")
    key = (
        F.when(c % 5 == 1, shape("array", none, F.array(part("string", "todos"), part("number", n)))).when(c % 5 == 2, shape("array", none, F.array(part("string", "todos"), part("identifier"))))
        .when(c % 5 == 3, shape("string", F.concat(F.lit("k"), n), empty)).when(c % 5 == 4, shape("call", none, empty))
    )
    prop = lambda *xs: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("kind"), F.lit(v).alias("value")) for a, b, v in xs])
    props = F.when(c % 4 == 1, prop(("queryKey", "array", ""))).when(c % 4 == 2, prop(("queryKey", "array", ""), ("exact", "boolean", "true"))).when(c % 4 == 3, prop(("predicate", "function", "")))
    calls = _t(spark, sf, "customer").select(c.alias("id"), F.when(c > 1, F.floor(c / 2)).alias("parent"), callee.alias("callee"), F.lit("h").alias("host"), F.lit("f").alias("file"), F.lit(1).alias("line"), key.alias("key"), props.alias("props"))
    edges = classify.query_registries(calls)[2]
    shown = F.when(F.col("segments").isNotNull(), F.array_join(F.transform("segments", lambda s: F.coalesce(s["value"], F.lit("*"))), "."))
    return edges.select("mutation_id", "id", "method", "is_all", "is_exact", "narrowed", shown.alias("key"), "opaque", "confidence")


_PASSES = """SELECT 'C' || (l_partkey % 50) || '#p' || (l_suppkey % 3) AS src, 'C' || (l_orderkey % 50) || '#p' || (l_linenumber % 3) AS dst,
  min(CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = l_linenumber % 3 THEN '0explicit' WHEN l_returnflag = 'A' THEN '1explicit' WHEN l_returnflag = 'N' THEN '1renamed' WHEN l_linestatus = 'O' THEN '2spread' ELSE '3derived' END) AS w
  FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2"""


@register("prop_chain", f"""
WITH RECURSIVE e AS (SELECT src, dst, substr(w, 2) AS how FROM ({_PASSES}) WHERE src <> dst),
w AS (SELECT 'C0#p0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE how IN ('explicit', 'renamed') AND depth < 4), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT src AS "from", CASE how WHEN 'explicit' THEN 'passes' WHEN 'renamed' THEN 'renames' WHEN 'spread' THEN 'spreads' ELSE 'derives' END AS relation, dst AS "to", CASE how WHEN 'explicit' THEN 'partial' ELSE 'dynamic' END AS confidence,
  CAST(depth + 1 AS INTEGER) AS depth FROM m JOIN e ON src = node WHERE depth < 4""")
def prop_chain(spark, sf):
    """Line items as passes of three props among fifty components, four steps from one of them."""
    number = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    how = F.when(F.col("l_returnflag") == "A", "explicit").when(F.col("l_returnflag") == "N", "renamed").when(F.col("l_linestatus") == "O", "spread").otherwise("derived")
    passes = _t(spark, sf, "lineitem").where("l_quantity >= 49").select(
        number("C", F.col("l_partkey") % 50).alias("component"), number("p", F.col("l_suppkey") % 3).alias("prop"), number("C", F.col("l_orderkey") % 50).alias("child"), number("p", F.col("l_linenumber") % 3).alias("child_prop"), how.alias("how")
    )
    chain = graph.prop_trace(passes, spark.createDataFrame([("C0", "p0")], "component string, prop string"), 4, None)
    return chain.hops.select("from", "relation", "to", "confidence", "depth")


@register("type_widening", """
WITH RECURSIVE f AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'passed-to' WHEN 1 THEN 'assigned-to' ELSE 'returned-from' END AS relation,
  CASE WHEN l_tax > 0.07 THEN 'to-any' WHEN l_discount > 0.05 THEN 'narrowing-lost' END AS verdict FROM lineitem WHERE l_quantity >= 30),
w AS (SELECT (SELECT min(src) FROM f) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN f ON src = node WHERE depth < 3 AND relation <> 'returned-from' AND verdict IS DISTINCT FROM 'to-any'),
m AS (SELECT DISTINCT node FROM w)
SELECT DISTINCT src, relation, dst, verdict, CASE verdict WHEN 'to-any' THEN 'dynamic' ELSE 'certain' END AS confidence FROM f WHERE src IN (SELECT node FROM m)""")
def type_widening(spark, sf):
    """Parts and suppliers as places of values, line items as flows; those that erase a type end the walk."""
    relation = F.element_at(F.array(F.lit("passed-to"), F.lit("assigned-to"), F.lit("returned-from")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    flows = _t(spark, sf, "lineitem").where("l_quantity >= 30").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), relation.alias("relation"), (F.col("l_discount") > 0.05).alias("forward"), F.lit(False).alias("backward"), (F.col("l_tax") > 0.07).alias("sink_any")
    )
    rows, _ = graph.trace_widening(flows, flows.agg(F.min("src").alias("node")), 3, None)
    return rows.select("src", "relation", "dst", "verdict", "confidence")


@register("field_reads", """
SELECT l_partkey AS field, CASE WHEN l_linenumber % 6 < 2 THEN 'rendered-in' WHEN l_linenumber % 6 < 4 THEN 'passed-to' ELSE 'destructured-at' END AS relation, l_orderkey AS site,
  CASE WHEN l_linenumber % 6 < 2 THEN 'certain' ELSE 'partial' END AS confidence
FROM lineitem WHERE l_returnflag <> 'R' AND (l_linenumber % 6 < 4 OR l_returnflag = 'A')""")
def field_reads(spark, sf):
    """Line items as reads and writes of a field, by where they stand."""
    n = F.col("l_linenumber") % 6
    position = F.element_at(F.array(*[F.lit(x) for x in ("intrinsic-child", "intrinsic-attr", "value-child", "value-attr", "other", "other")]), (n + 1).cast("int"))
    role = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "destructure").otherwise("read")
    return graph.trace_field(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("site"), position.alias("position"), role.alias("role")))


@register("selector_specificity", """
WITH s AS (SELECT p_partkey AS k, p_partkey % 3 AS i, p_partkey % 4 AS c, p_size % 6 AS v FROM part)
SELECT k, repeat('#a', i::INT) || repeat('.b', c::INT) || ' div' || CASE v WHEN 0 THEN ':hover' WHEN 1 THEN '::before' WHEN 2 THEN ':not(.x, #y)' WHEN 3 THEN ':where(#z .w)' WHEN 4 THEN '[href="#q"]' ELSE ' > p:is(.m, li)' END AS selector,
  CAST(i + CASE WHEN v = 2 THEN 1 ELSE 0 END AS INTEGER) AS a, CAST(c + CASE WHEN v IN (0, 4, 5) THEN 1 ELSE 0 END AS INTEGER) AS b, CAST(1 + CASE WHEN v IN (1, 5) THEN 1 ELSE 0 END AS INTEGER) AS c FROM s""")
def selector_specificity(spark, sf):
    """Selectors put together from numbers of parts, and how specific they are."""
    from lodestone.operators.cascade import specificity_of

    ends = (":hover", "::before", ":not(.x, #y)", ":where(#z .w)", '[href="#q"]', " > p:is(.m, li)")
    selector = F.concat(F.expr("repeat('#a', int(p_partkey % 3))"), F.expr("repeat('.b', int(p_partkey % 4))"), F.lit(" div"), F.element_at(F.array(*[F.lit(x) for x in ends]), (F.col("p_size") % 6 + 1).cast("int")))
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), selector.alias("selector"))
    return rows.withColumn("s", specificity_of("selector")).select("k", "selector", "s.a", "s.b", "s.c")


@register("rename_edits", """
WITH r AS (SELECT 's' || l_partkey AS symbol, l_partkey AS k, CASE WHEN l_suppkey % 7 = 0 THEN 'node_modules/f' ELSE 'f' END || l_suppkey AS file, l_orderkey AS start, l_returnflag AS f, l_linestatus = 'O' AS plain FROM lineitem)
SELECT file, CAST(start AS BIGINT) AS "begin", CAST(start + length(symbol) AS BIGINT) AS "end", CASE f WHEN 'R' THEN 'fresh as ' || symbol ELSE 'fresh' END AS text FROM r WHERE k = 7 AND plain AND file NOT LIKE 'node_modules/%'""")
def rename_edits(spark, sf):
    """One part renamed: re-exports keep the old name as an alias, other spellings and packages stay."""
    symbol = F.concat(F.lit("s"), _text("l_partkey"))
    file = F.concat(F.when(F.col("l_suppkey") % 7 == 0, "node_modules/f").otherwise("f"), _text("l_suppkey"))
    refs = _t(spark, sf, "lineitem").select(
        _text("l_partkey").alias("symbol_id"), symbol.alias("symbol"), file.alias("file"), F.col("l_orderkey").alias("start"), F.when(F.col("l_returnflag") == "R", "reexport").otherwise("call").alias("role"), F.when(F.col("l_linestatus") == "O", symbol).otherwise("alias").alias("spelled")
    )
    return changes.rename_plan(refs, "7", "fresh").select("file", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "text")


@register("reference_roles", """
WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey % 8 AS v, l_returnflag = 'R' AS def, l_linestatus = 'O' AS w FROM lineitem)
SELECT o, n, p, CASE WHEN def THEN 'decl' WHEN v = 0 THEN 'reexport' WHEN v = 1 THEN 'import' WHEN v = 2 THEN 'jsx' WHEN v = 3 THEN 'jsx-closing' WHEN v = 4 THEN 'type' WHEN v = 5 THEN 'call' WHEN v = 6 THEN 'type' WHEN w THEN 'write' ELSE 'read' END AS role, count(*) AS times
FROM r GROUP BY ALL""")
def reference_roles(spark, sf):
    """Line items as references in statements of every kind, and what each of them is."""
    from lodestone.operators import classify

    step = lambda kind, named=False: F.struct(F.lit(kind).alias("kind"), F.lit(named).alias("on_name"))
    around = (
        [step("Identifier"), step("ExportSpecifier")], [step("ImportSpecifier"), step("ImportDeclaration")], [step("Identifier"), step("JsxSelfClosingElement", True), step("CallExpression")], [step("JsxClosingElement", True)],
        [step("TypeNode"), step("CallExpression", True)], [step("JsxOpeningElement"), step("NewExpression", True)], [step("PropertySignature", True)], [step("CallExpression"), step("PropertySignature")],
    )
    ancestors = F.element_at(F.array(*[F.array(*x) for x in around]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    role = classify.role(ancestors, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), role.alias("role"))
    return rows.groupBy("o", "n", "p", "role").agg(F.count(F.lit(1)).alias("times"))
