"""The operators on the driver's tables, each with the SQL that gives the same rows.

Parts stand for symbols, line items for references, orders for enclosers, return flags for roles,
line status for programs; other stand-ins are said at each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.values import key_match, severity, worst_of
from lodestone.operators import cascade, catalogue, changes, dead, graph, usages
from lodestone.plans.envelope import with_total
from lodestone.plans.registry import register
from lodestone.plans.sqlbatch import Request, run_batch


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _refs(spark, sf) -> DataFrame:
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return line.select(
        F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("encloser"), F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("role"),
        F.col("l_linestatus").alias("program"), F.col("l_quantity").alias("quantity"), "l_shipdate",
    )


_REFS = "(SELECT l_partkey AS symbol_id, l_orderkey AS encloser, l_suppkey AS file, l_returnflag AS role, l_linestatus AS program, l_quantity AS quantity, l_shipdate FROM lineitem)"


@register("usage_anti_join", f"""
WITH r AS {_REFS},
a AS (SELECT encloser, count(*) AS n FROM r JOIN part ON symbol_id = p_partkey WHERE p_brand = 'Brand#2' GROUP BY 1),
b AS (SELECT encloser FROM r WHERE role = 'R' GROUP BY 1)
SELECT encloser, CAST(n AS BIGINT) AS n FROM a WHERE encloser NOT IN (SELECT encloser FROM b)
""")
def usage_anti_join(spark, sf):
    """Two usage roll-ups joined by NOT IN through the SQL batch, as one plan."""
    refs = _refs(spark, sf)
    parts = _t(spark, sf, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("symbol_id"))
    renders = lambda: usages.by_encloser(refs.join(parts, "symbol_id", "left_semi"), ["encloser"])
    forms = lambda: usages.by_encloser(refs.where("role = 'R'"), ["encloser"])
    out = run_batch(
        spark, [Request("find_usages", renders, "renders"), Request("find_usages", forms, "forms")],
        "SELECT encloser, count AS n FROM renders WHERE encloser NOT IN (SELECT encloser FROM forms)", table_rows=None, result_rows=None,
    )
    if not out.sql.ok:
        raise ValueError(out.sql.failure.message)
    return out.sql.df


@register("usage_rollup", f"""
SELECT encloser, CAST(count(*) AS BIGINT) AS count, string_agg(DISTINCT role, ',' ORDER BY role) AS roles,
       string_agg(DISTINCT program, ',' ORDER BY program) AS programs FROM {_REFS} GROUP BY 1""")
def usage_rollup(spark, sf):
    return usages.by_encloser(_refs(spark, sf), ["encloser"])


@register("role_breakdown", """
SELECT p_brand, l_returnflag AS role, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def role_breakdown(spark, sf):
    named = _refs(spark, sf).join(_t(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), "p_brand"), "symbol_id")
    return usages.role_breakdown(named, ["p_brand"])


@register("import_collapse", f"""
WITH h AS (SELECT *, role = 'N' AND max(CASE WHEN role <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY encloser) = 1 AS hidden FROM {_REFS})
SELECT role, CAST(count(*) FILTER (WHERE hidden) AS BIGINT) AS hidden, CAST(count(*) FILTER (WHERE NOT hidden) AS BIGINT) AS shown FROM h GROUP BY 1""")
def import_collapse(spark, sf):
    rows = usages.collapse(_refs(spark, sf), "N", ["encloser"])
    return rows.groupBy("role").agg(F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden")).alias("shown"))


@register("program_dedup", f"""
SELECT symbol_id, file, program, quantity FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id, file ORDER BY program, quantity) AS n FROM {_REFS}) WHERE n = 1""")
def program_dedup(spark, sf):
    """One row a site; status F before O, then the least quantity."""
    refs = _refs(spark, sf).select("symbol_id", "file", "program", "quantity")
    return usages.first_program(refs, ["symbol_id", "file"], ["program", "quantity"]).select("symbol_id", "file", "program", "quantity")


@register("merge_declarations", f"SELECT symbol_id, file, string_agg(DISTINCT program, ',' ORDER BY program) AS decls FROM {_REFS} GROUP BY 1, 2")
def merge_declarations(spark, sf):
    return usages.merged(_refs(spark, sf), ["symbol_id", "file"], "program", "decls")


@register("path_filter", """
WITH p AS (SELECT *, regexp_matches(source, '^(?:src1[^/]*)$') AND NOT regexp_matches(source, '^(?:src1[0-4])$') AS keep FROM documents)
SELECT source, CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT keep) AS BIGINT) AS excluded FROM p GROUP BY 1""")
def path_filter(spark, sf):
    rows = _t(spark, sf, "documents").select("source", kept(F.col("source"), ["src1*"], ["src1[0-4]"]).alias("keep"))
    return rows.groupBy("source").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("excluded"))


@register("text_overlay", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])the\\b')) AS BIGINT) AS hits, 'unresolved' AS confidence FROM documents
WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def text_overlay(spark, sf):
    """Documents with the word ``the`` that no label (the semantic side) covers."""
    hits = usages.text_hits(_t(spark, sf, "documents").select("doc_id", "text"), "the").select("doc_id", "hits", "confidence")
    return usages.text_overlay(hits, _t(spark, sf, "labels").select("doc_id"), ["doc_id"]).select("doc_id", "hits", "confidence")


@register("limit_with_total", """
WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
SELECT o_custkey, spent, CAST((SELECT count(*) FROM s) AS BIGINT) AS total FROM s ORDER BY spent DESC, o_custkey LIMIT 25""")
def limit_with_total(spark, sf):
    spent = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return with_total(spent, 25, F.desc("spent"), "o_custkey")


_BIG = "l_returnflag = 'R' AND l_quantity >= 45"


@register("unused_exports", f"""
SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'partial' WHEN p_size > 40 THEN 'dynamic' ELSE 'certain' END AS confidence
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {_BIG})""")
def unused_exports(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    used = _t(spark, sf, "lineitem").where(_BIG).select(F.col("l_partkey").alias("p_partkey"))
    return dead.unused(part, used, ["p_partkey"], (F.col("p_brand").isin("Brand#1", "Brand#2"), "partial"), (F.col("p_size") > 40, "dynamic")).select("p_partkey", "confidence")


@register("unused_classes", """
WITH acc AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount >= 0.1)
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'dynamic' WHEN s_nationkey IN (1, 2, 3) OR s_suppkey % 13 = 0 THEN 'partial' WHEN s_suppkey % 7 = 0 THEN 'partial' ELSE 'certain' END AS confidence
FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM acc) AND s_suppkey % 11 <> 0""")
def unused_classes(spark, sf):
    """Suppliers as classes: a negative balance is a global sheet, some nations are linked, every seventh
    entangled; every eleventh is composed by its sheet, every thirteenth by one that is not known."""
    classes = _t(spark, sf, "supplier").select(
        F.lit("sheet").alias("file"), F.col("s_suppkey").cast("string").alias("name"), "s_suppkey", (F.col("s_acctbal") < 0).alias("global"), F.col("s_nationkey").isin(1, 2, 3).alias("linked"),
        (F.col("s_suppkey") % 7 == 0).alias("entangled"), F.lit(False).alias("interpolated"),
    )
    used = _t(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity = 50 and l_discount >= 0.1").select(F.lit("sheet").alias("file"), F.col("l_suppkey").cast("string").alias("name"))
    composed = classes.where("s_suppkey % 11 = 0").select("file", "name").unionByName(classes.where("s_suppkey % 13 = 0").select(F.lit(None).cast("string").alias("file"), "name"))
    return dead.unused_classes(classes, used, composed).select("s_suppkey", "confidence")


@register("unused_keys", f"""
WITH k AS (SELECT DISTINCT p_brand || '.' || p_type || '.' || p_name AS key FROM part),
u AS (SELECT DISTINCT p_brand || '.' || p_type || '.' || p_name AS key FROM part JOIN lineitem ON p_partkey = l_partkey WHERE {_BIG})
SELECT key, CASE WHEN key LIKE 'Brand#3.%' OR key LIKE 'Brand#7.%' THEN 'dynamic' ELSE 'certain' END AS confidence FROM k WHERE key NOT IN (SELECT key FROM u)""")
def unused_keys(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("key"))
    used = part.join(_t(spark, sf, "lineitem").where(_BIG).select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return dead.unused_keys(part.select("key").distinct(), used, spark.createDataFrame([("Brand#3",), ("Brand#7",)], "key string"))


@register("missing_keys", """
WITH n AS (SELECT DISTINCT p_name AS key FROM part), b AS (SELECT DISTINCT p_brand AS locale FROM part)
SELECT key, locale FROM n CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_name = key AND p_brand = locale)""")
def missing_keys(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("locale"))
    return dead.missing_keys(part.select("key").distinct(), part, part).select("key", "locale")


@register("unused_props", """
WITH c AS (SELECT DISTINCT user_id AS component FROM events), n AS (SELECT DISTINCT event_type AS name FROM events),
o AS (SELECT DISTINCT user_id AS component FROM events WHERE value > 99)
SELECT component, name, CASE WHEN component IN (SELECT component FROM o) THEN 'partial' ELSE 'certain' END AS confidence FROM c CROSS JOIN n
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = component AND event_type = name AND value > 60)""")
def unused_props(spark, sf):
    """Event types as the props that every user declares; a value over 99 is an opaque use."""
    ev = _t(spark, sf, "events").select(F.col("user_id").alias("component"), F.col("event_type").alias("name"), "value")
    kinds = [r[0] for r in ev.select("name").distinct().orderBy("name").collect()]
    declared = ev.select("component").distinct().withColumn("name", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return dead.unused_props(declared, ev.where("value > 60"), ev.where("value > 99"))


@register("phantom_deps", """
WITH s AS (SELECT c_nationkey AS package, s_nationkey AS spec FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_quantity >= 49),
d AS (SELECT a.n_nationkey AS package, b.n_nationkey AS dep FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT CAST(package AS VARCHAR) AS package_dir, '@n/' || spec AS spec, CAST(count(*) AS BIGINT) AS sites FROM s
WHERE package <> spec AND NOT EXISTS (SELECT 1 FROM d WHERE d.package = s.package AND d.dep = s.spec) GROUP BY 1, 2""")
def phantom_deps(spark, sf):
    """Customer nations import subpaths of supplier nations; the packages of their own region are declared."""
    line = _t(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_suppkey")
    s = line.join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = s.join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    text = lambda c: F.col(c).cast("string")
    imports = s.select(text("c_nationkey").alias("package_dir"), F.concat(F.lit("@n/"), "c_nationkey").alias("package"), F.concat(F.lit("@n/"), "s_nationkey", F.lit("/sub/path")).alias("spec"), F.lit(False).alias("type_only"), text("l_orderkey").alias("file"), F.lit(1).alias("line"))
    a = _t(spark, sf, "nation").select("n_regionkey", text("n_nationkey").alias("package_dir"))
    b = _t(spark, sf, "nation").select("n_regionkey", F.concat(F.lit("@n/"), "n_nationkey").alias("dep"))
    return dead.phantom_deps(imports, a.join(b, "n_regionkey").select("package_dir", "dep")).select("package_dir", "spec", "sites")


@register("importers", """
SELECT 'o/' || l_orderkey AS file, CAST(count(*) AS BIGINT) AS sites FROM lineitem WHERE l_partkey = (SELECT min(p_partkey) FROM part WHERE p_size > 25) GROUP BY 1""")
def importers(spark, sf):
    """Line items as imports of parts by orders; the importers of the first large part."""
    line = _t(spark, sf, "lineitem").select(F.concat(F.lit("o/"), "l_orderkey").alias("file"), F.concat(F.lit("p/"), "l_partkey").alias("resolved"), F.lit("").alias("spec"))
    first = _t(spark, sf, "part").where("p_size > 25").agg(F.min("p_partkey")).first()[0]
    return graph.importers(line, f"p/{first}").groupBy("file").agg(F.count(F.lit(1)).alias("sites"))


@register("subtree_importers", """
WITH i AS (SELECT 'n/' || c_nationkey || '/' || o_custkey AS file, 'n/' || s_nationkey || '/' || l_suppkey AS resolved FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45)
SELECT CASE WHEN file LIKE 'n/3/%' THEN 'internal' ELSE 'external' END AS scope, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT file) AS BIGINT) AS files
FROM i WHERE resolved LIKE 'n/3/%' GROUP BY 1""")
def subtree_importers(spark, sf):
    line = _t(spark, sf, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_suppkey")
    s = line.join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = s.join(_t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    i = s.select(F.concat_ws("/", F.lit("n"), "c_nationkey", "o_custkey").alias("file"), F.concat_ws("/", F.lit("n"), "s_nationkey", "l_suppkey").alias("resolved"), F.lit("").alias("spec"))
    return graph.subtree_importers(i, "n/3").groupBy("scope").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("file").alias("files"))


_BUY = "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 49"


def _bought_together(spark, sf) -> DataFrame:
    buy = _t(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    pairs = buy.alias("a").join(buy.alias("b"), (F.col("a.o") == F.col("b.o")) & (F.col("a.p") != F.col("b.p")))
    return pairs.select(F.col("a.p").alias("src"), F.col("b.p").alias("dst")).distinct()


@register("impact_closure", f"""
WITH RECURSIVE e AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM ({_BUY}) a JOIN ({_BUY}) b ON a.o = b.o AND a.p <> b.p),
w AS (SELECT (SELECT min(src) FROM e) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT node, CAST(depth AS INTEGER) AS depth FROM m WHERE depth > 0""")
def impact_closure(spark, sf):
    """Parts bought together at 49 or more, from the least such part, three steps."""
    edges = _bought_together(spark, sf)
    return graph.closure(edges, edges.agg(F.min("src").alias("node")), 3).nodes.select("node", "depth")


@register("impact_capped", f"""
WITH RECURSIVE e AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM ({_BUY}) a JOIN ({_BUY}) b ON a.o = b.o AND a.p <> b.p),
w AS (SELECT (SELECT min(src) FROM e) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 4),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
SELECT node, CAST(depth AS INTEGER) AS depth FROM m WHERE depth > 0 ORDER BY depth, node LIMIT 3""")
def impact_capped(spark, sf):
    """The same parts as symbols and their enclosers, by the impact operation with its node cap."""
    refs = _bought_together(spark, sf).select(F.col("src").alias("symbol_id"), F.col("dst").alias("encloser_id"), F.lit("call").alias("role"))
    return graph.impact(refs, refs.agg(F.min("symbol_id").alias("node")), 4, 3).nodes.select("node", "depth")


@register("trace_hops", """
SELECT DISTINCT 'r' || n_regionkey AS "from", 'holds' AS relation, 'n' || n_nationkey AS "to", 'certain' AS confidence FROM nation
UNION SELECT 'n' || c_nationkey, 'holds', 'c' || c_custkey, 'certain' FROM customer
UNION SELECT 'c' || o_custkey, 'placed', o_orderstatus, 'partial' FROM orders JOIN customer ON o_custkey = c_custkey""")
def trace_hops(spark, sf):
    def hop(df, a, relation, b, seq, confidence="certain"):
        return df.select(a.alias("from"), F.lit(relation).alias("relation"), b.alias("to"), F.lit(confidence).alias("confidence"), F.lit(seq).alias("seq"))

    people = _t(spark, sf, "customer")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return graph.hops(
        hop(_t(spark, sf, "nation"), named("r", "n_regionkey"), "holds", named("n", "n_nationkey"), 0), hop(people, named("n", "c_nationkey"), "holds", named("c", "c_custkey"), 1),
        hop(_t(spark, sf, "orders").select("o_custkey", "o_orderstatus").join(people.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"), named("c", "o_custkey"), "placed", F.col("o_orderstatus"), 2, "partial"),
    )


@register("cascade_winner", """
WITH d AS (SELECT l_orderkey, l_suppkey, l_returnflag = 'R' AS i, l_quantity AS a, l_discount AS b, l_tax AS c, l_shipdate AS pos, l_extendedprice AS v FROM lineitem),
k AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY i DESC, a DESC, b DESC, c DESC) AS r FROM d),
t AS (SELECT l_orderkey, l_suppkey, any_value(i) AS i FROM k WHERE r = 1 GROUP BY 1, 2),
f AS (SELECT l_orderkey, CAST(min(l_suppkey) AS BIGINT) AS winner_file, CAST(any_value(i) AS BIGINT) AS important, CAST(count(*) AS BIGINT) AS tied_files FROM t GROUP BY 1),
v AS (SELECT l_orderkey, v AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, pos DESC, v DESC) AS n FROM k WHERE r = 1)
SELECT l_orderkey, value, winner_file, important, tied_files, CASE WHEN tied_files > 1 THEN 'partial' ELSE 'certain' END AS confidence FROM f JOIN v USING (l_orderkey) WHERE n = 1""")
def cascade_winner(spark, sf):
    """Line items of an order as declarations of one property, suppliers as files."""
    d = _t(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("file"), (F.col("l_returnflag") == "R").alias("important"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"),
        F.col("l_shipdate").alias("pos"), F.col("l_extendedprice").alias("value"),
    )
    return cascade.winners(d, ["l_orderkey"]).select("l_orderkey", "value", F.col("winner_file").cast("long").alias("winner_file"), "important", "tied_files", "confidence")


_CONF = "CASE o_orderstatus WHEN 'F' THEN 'certain' WHEN 'P' THEN 'partial' ELSE 'dynamic' END"


@register("worst_confidence", f"""
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) WHEN 0 THEN 'certain' WHEN 1 THEN 'partial' ELSE 'dynamic' END AS confidence,
       CAST(max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS INTEGER) AS severity FROM orders GROUP BY 1""")
def worst_confidence(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", F.expr(_CONF).alias("confidence"))
    return o.groupBy("o_custkey").agg(worst_of(F.col("confidence")).alias("confidence")).withColumn("severity", severity(F.col("confidence")))


@register("key_match", """
WITH q AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages),
e AS (SELECT DISTINCT s[1] AS host, s[2] AS seg FROM q WHERE len(s) >= 2)
SELECT host, seg, page_id, CASE WHEN regexp_matches(seg, '^[0-9]+$') OR regexp_matches(s[2], '^[0-9]+$') THEN 'partial' ELSE 'certain' END AS confidence
FROM e JOIN q ON q.s[1] = e.host AND len(s) >= 2 WHERE s[2] = seg OR regexp_matches(seg, '^[0-9]+$') OR regexp_matches(s[2], '^[0-9]+$')""")
def key_match_query(spark, sf):
    """Url segments as query keys, numbers as dynamic segments; first two segments as invalidations."""
    q = _t(spark, sf, "pages").select("page_id", F.split(F.regexp_replace("url", r"^https?://", ""), "/").alias("s"))
    seg = lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), "dynamic").otherwise("static").alias("kind"), x.alias("value"))
    queries = q.select("page_id", F.col("s")[0].alias("q_host"), F.transform("s", seg).alias("query"))
    e = q.where("size(s) >= 2").select(F.col("s")[0].alias("host"), F.col("s")[1].alias("seg")).distinct().withColumn("edge", F.transform(F.array("host", "seg"), seg))
    match = key_match(F.col("edge"), F.col("query"), F.lit(False), F.lit(False), F.lit(False))
    return e.join(queries, F.col("host") == F.col("q_host")).withColumn("confidence", match).where("confidence is not null").select("host", "seg", "page_id", "confidence")


@register("fuzzy_search", """
SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'bolt' THEN 0 WHEN lower(p_name) LIKE 'bolt%' THEN 1 ELSE 2 END AS rank FROM part WHERE lower(p_name) LIKE '%bolt%'""")
def fuzzy_search(spark, sf):
    symbols = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return catalogue.search_symbol(symbols, "bolt").select("id", "name", "rank")


@register("camel_search", """
SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank FROM part WHERE p_size % 5 < 4""")
def camel_search(spark, sf):
    """Names made of sizes: the query itself, begun with it, with it inside, by its humps, and another."""
    kind = F.col("p_size") % 5
    name = F.when(kind == 0, "uBF").when(kind == 1, "UBFirst").when(kind == 2, F.concat(F.lit("x"), "p_partkey", F.lit("ubf"))).when(kind == 3, F.concat(F.lit("getUser"), "p_partkey", F.lit("BrandForm"))).otherwise("useFormBrand")
    return catalogue.search_symbol(_t(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), "uBF").select("id", "rank")


@register("kind_histogram", "SELECT p_type AS kind, CAST(count(DISTINCT p_name) AS BIGINT) AS names FROM part GROUP BY 1")
def kind_histogram(spark, sf):
    return catalogue.kind_histogram(_t(spark, sf, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")))


@register("collisions", """
SELECT p_name AS name, CAST(count(DISTINCT p_size) AS BIGINT) AS files, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS configs FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 2""")
def collisions(spark, sf):
    return catalogue.collisions(_t(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("file"), F.col("p_brand").alias("config")))


@register("catalogue", """
WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS n, count(*) OVER (PARTITION BY p_brand) AS total FROM n)
SELECT p_brand, p_name, CAST(n AS INTEGER) AS n, CAST(total AS BIGINT) AS total FROM r WHERE n <= 12""")
def grouped_catalogue(spark, sf):
    names = _t(spark, sf, "part").select("p_brand", "p_name").distinct()
    return catalogue.capped_groups(names, ["p_brand"], 12, "p_name").select("p_brand", "p_name", "n", "total")


@register("discrimination", """
WITH d AS (SELECT DISTINCT event_type AS t FROM events), u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT DISTINCT user_id, event_type AS t FROM events WHERE value > 60)
SELECT u.user_id, coalesce(string_agg(c.t, ' ' ORDER BY c.t), '') AS covers, coalesce(string_agg(CASE WHEN c.t IS NULL THEN d.t END, ' ' ORDER BY d.t), '') AS missing
FROM u CROSS JOIN d LEFT JOIN c ON c.user_id = u.user_id AND c.t = d.t GROUP BY 1""")
def discrimination(spark, sf):
    from lodestone.operators.facts import discriminations

    ev = _t(spark, sf, "events").select("user_id", "event_type", "value")
    domain = sorted(r[0] for r in ev.select("event_type").distinct().collect())
    sites = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("covered"))
    sites = sites.withColumn("domain", F.array(*[F.lit(x) for x in domain])).withColumn("has_default", F.lit(False)).withColumn("uniform", F.lit(True))
    return discriminations(sites).select("user_id", "covers", "missing")


@register("json_flatten", """
SELECT CAST(event_id AS VARCHAR) AS event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, CAST(1 AS BIGINT) AS line FROM events""")
def json_flatten(spark, sf):
    """The properties of events as locale files."""
    from lodestone.sources.repo import locale_keys

    files = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.encode("props", "utf-8").alias("content"))
    return locale_keys(files).select(F.col("file").alias("event_id"), "key", "value", "line")


@register("snapshot_diff", """
WITH c AS (SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) AS cut FROM events),
b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < (SELECT cut FROM c) GROUP BY 1),
a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark, sf):
    """Events by user up to half of the time, and all but the errors at its end."""
    ev = _t(spark, sf, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    low, high = ev.agg(F.min("us"), F.max("us")).first()
    b = ev.where(F.col("us") < low + (high - low) // 2).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    a = ev.where("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return changes.snapshot_diff(b, a, "user_id", "n")


@register("introduced_diagnostics", """
SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL
SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'""")
def introduced_diagnostics(spark, sf):
    line = _t(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return changes.introduced(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), "l_partkey", "l_quantity")


@register("edit_conflicts", """
WITH e AS (SELECT l_suppkey AS file, CAST(l_partkey AS BIGINT) * 100 AS b, CAST(l_partkey AS BIGINT) * 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
r AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT file, CAST(count(*) AS BIGINT) AS conflicts FROM r WHERE b < reach GROUP BY 1""")
def edit_conflicts(spark, sf):
    line = _t(spark, sf, "lineitem")
    begin = F.col("l_partkey").cast("long") * 100
    edits = line.select(F.col("l_suppkey").alias("file"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long")).alias("end"))
    return changes.edit_conflicts(edits).groupBy("file").agg(F.count(F.lit(1)).alias("conflicts"))


@register("endpoints", """
SELECT page_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path FROM pages WHERE lower(url) LIKE '%/a%'""")
def endpoint_list(spark, sf):
    cards = _t(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).alias("path"))
    return catalogue.endpoints(cards.withColumnRenamed("path", "p").withColumnRenamed("url", "path"), "/a").select("page_id", F.col("p").alias("path"))


@register("lookup", """
SELECT n_name AS key, r_name AS locale, CAST(n_nationkey AS BIGINT) AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), 'n_1')""")
def lookup(spark, sf):
    defs = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("n_name").alias("value"), F.col("r_name").alias("locale"), F.col("n_nationkey").cast("long").alias("id"))
    return catalogue.lookup(defs, value="N_1").select("key", "locale", "id")


@register("enclosing_declaration", """
WITH d AS (SELECT o_orderkey AS decl_id, o_custkey AS file, o_orderkey AS b, o_orderkey + 200 AS e FROM orders),
r AS (SELECT DISTINCT o_custkey AS file, o_orderkey AS start FROM orders),
m AS (SELECT r.file, r.start, decl_id, row_number() OVER (PARTITION BY r.file, r.start ORDER BY e - b, decl_id) AS n FROM r LEFT JOIN d ON d.file = r.file AND b <= start AND start < e)
SELECT file, start, decl_id AS encloser_id FROM m WHERE n = 1""")
def enclosing_declaration(spark, sf):
    """Orders as declarations reaching over 200 keys within their customer; the innermost one wins."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    d = o.select(F.col("o_orderkey").alias("decl_id"), F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("begin"), (F.col("o_orderkey") + 200).alias("end"))
    r = o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("start")).distinct()
    return usages.enclosed(r, d).select("file", "start", "encloser_id")


@register("affected_tests", f"""
WITH RECURSIVE e AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM ({_BUY}) a JOIN ({_BUY}) b ON a.o = b.o AND a.p <> b.p),
w AS (SELECT (SELECT max(src) FROM e) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 5),
m AS (SELECT CASE WHEN node % 2 = 0 THEN 'p/' || node || '.test.ts' ELSE 'p/' || node || '.ts' END AS file, min(depth) AS depth FROM w GROUP BY 1),
c AS (SELECT * FROM (SELECT * FROM m WHERE depth > 0 ORDER BY depth, file LIMIT 3) UNION ALL SELECT * FROM m WHERE depth = 0)
SELECT file, CAST(depth AS INTEGER) AS depth FROM c WHERE file LIKE '%.test.ts'""")
def affected_tests(spark, sf):
    """Parts bought together as files that import one another; even ones are tests. Five steps, three files."""
    name = lambda c: F.concat(F.lit("p/"), F.col(c).cast("string"), F.when(F.col(c) % 2 == 0, ".test.ts").otherwise(".ts"))
    pairs = _bought_together(spark, sf)
    imports = pairs.select(name("dst").alias("file"), name("src").alias("resolved"))
    changed = pairs.agg(F.max("src").alias("x")).select(name("x").alias("file"))
    return graph.affected_tests(imports, changed, depth=5, nodes=3)[0].select("file", "depth")


@register("sql_bounds", """
WITH t AS (SELECT p_partkey, p_brand FROM part ORDER BY p_partkey, p_brand LIMIT 150)
SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(min(p_partkey) AS BIGINT) AS least FROM t GROUP BY 1 ORDER BY 1 LIMIT 3""")
def sql_bounds(spark, sf):
    """A batch whose table and result are both cut at their bounds."""
    part = _t(spark, sf, "part").select("p_partkey", "p_brand")
    out = run_batch(spark, [Request("parts", lambda: part)], "SELECT p_brand, count(*) AS n, min(p_partkey) AS least FROM t GROUP BY p_brand ORDER BY p_brand", table_rows=150, result_rows=3)
    assert out.sql.bounded_tables == ["t"] and out.sql.truncated.total > 3
    return out.sql.df


@register("trace_invalidation", """
WITH e AS (SELECT r_name AS m, n_name AS k, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 0),
q AS (SELECT n_name AS k, 'c' || c_custkey AS q, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT k FROM e)),
h AS (SELECT DISTINCT q, o_orderpriority AS h, o_orderpriority < '3' AS component FROM q JOIN orders ON o_custkey = c_custkey),
s AS (SELECT DISTINCT h, component, h || ' at ' || event_type AS s FROM (SELECT DISTINCT h, component FROM h) CROSS JOIN (SELECT DISTINCT event_type FROM events))
SELECT m AS "from", 'invalidates' AS relation, k AS "to", 'certain' AS confidence FROM e UNION SELECT k, 'affects', q, 'partial' FROM q
UNION SELECT q, 'in', h, 'certain' FROM h UNION SELECT h, CASE WHEN component THEN 'mounted-at' ELSE 'used-by' END, s, 'certain' FROM s""")
def trace_invalidation(spark, sf):
    """Regions as mutations, nations as keys, customers as queries, priorities as hosts, event types as sites."""
    nation = _t(spark, sf, "nation")
    edges = _t(spark, sf, "region").where("r_regionkey = 0").join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("mutation"), F.col("n_name").alias("key"), F.lit("certain").alias("confidence"))
    query = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    affects = _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), query.alias("query"), F.lit("partial").alias("confidence"))
    hosts = _t(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("query"), F.col("o_orderpriority").alias("host"), F.when(F.col("o_orderpriority") < "3", "component").otherwise("hook").alias("kind")).distinct()
    kinds = [r[0] for r in _t(spark, sf, "events").select("event_type").distinct().collect()]
    mounts = hosts.select("host").distinct().select("host", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("k")).select("host", F.concat("host", F.lit(" at "), "k").alias("site"))
    return graph.trace_invalidation(edges, affects, hosts, mounts).select("from", "relation", "to", "confidence")


@register("widening_verdicts", """
WITH f AS (SELECT l_quantity > 25 AS fw, l_discount > 0.05 AS bw, l_tax > 0.07 AS any_, l_returnflag = 'R' AS lit, l_linestatus = 'O' AS uni FROM lineitem),
v AS (SELECT CASE WHEN any_ THEN 'to-any' WHEN fw AND NOT bw AND lit THEN 'literal-widening' WHEN fw AND NOT bw AND uni THEN 'union-widened' WHEN fw AND NOT bw THEN 'narrowing-lost' END AS verdict FROM f)
SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1""")
def widening_verdicts(spark, sf):
    """Line items as value flows, their figures as what the types allow."""
    line = _t(spark, sf, "lineitem")
    flows = line.select((F.col("l_quantity") > 25).alias("forward"), (F.col("l_discount") > 0.05).alias("backward"), (F.col("l_tax") > 0.07).alias("sink_any"), (F.col("l_returnflag") == "R").alias("src_literal"), (F.col("l_linestatus") == "O").alias("sink_union"))
    return graph.widening_verdict(flows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
