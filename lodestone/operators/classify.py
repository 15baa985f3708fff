"""What syntax says about references, query calls and their keys, by rules over fact columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import owner

# Syntax kinds of ancestors, and the role that the nearest of them gives a reference.
REEXPORTS = ("ExportSpecifier",)
IMPORTS = ("ImportDeclaration", "ImportSpecifier", "ImportClause", "ImportEqualsDeclaration")
TAGS = ("JsxOpeningElement", "JsxSelfClosingElement")
TYPES = ("TypeNode", "HeritageClause", "TypeQuery")
SIGNATURES = ("MethodSignature", "PropertySignature", "TypeGetAccessor", "TypeSetAccessor")
CALLS = ("CallExpression", "NewExpression")


def role(ancestors: Column, is_definition: Column, is_write: Column, destructure: Column | None = None, names_declaration: Column | None = None) -> Column:
    """The role of a reference.

    ancestors: array of struct(kind, on_name), nearest first, the node itself included and no further
    than the statement around it; on_name says whether the reference lies in the part of the ancestor
    that names it (the tag, the callee, the name of a signature). A definition is ``decl``, as is
    the name of a top-level declaration; else the nearest ancestor with a role decides; else a token
    that only reads a member out of a destructured value is ``read``; else the write flag decides.
    """
    def one(a: Column) -> Column:
        named = F.coalesce(a["on_name"], F.lit(False))
        return (
            F.when(a["kind"].isin(*REEXPORTS), "reexport").when(a["kind"].isin(*IMPORTS), "import").when(a["kind"].isin(*TAGS) & named, "jsx").when((a["kind"] == "JsxClosingElement") & named, "jsx-closing")
            .when(a["kind"].isin(*TYPES), "type").when(a["kind"].isin(*SIGNATURES) & named, "type").when(a["kind"].isin(*CALLS) & named, "call")
        )

    nearest = F.get(F.filter(F.transform(ancestors, one), lambda r: r.isNotNull()), F.lit(0))
    given = is_definition if names_declaration is None else is_definition | F.coalesce(names_declaration, F.lit(False))
    out = F.when(given, "decl").when(nearest.isNotNull(), nearest)
    if destructure is not None:
        out = out.when(destructure == "member-read", "read")
    return out.when(is_write, "write").otherwise("read")


def query_key(shape: Column) -> Column:
    """struct(segments, opaque, confidence) of a key's value. shape: struct(kind, value, elements), with
    elements an array of struct(kind, value). An array of literals is certain, one with any other
    element partial; a literal alone is a key of one segment; any other value is opaque and
    dynamic; an absent key is unresolved."""
    literal = lambda kind: kind.isin("string", "number", "boolean", "null")
    segment = lambda v: F.struct(F.when(literal(v["kind"]), "static").otherwise("dynamic").alias("kind"), F.when(v["kind"] == "null", "null").when(literal(v["kind"]), v["value"]).alias("value"))
    segments = F.when(shape["kind"] == "array", F.transform(shape["elements"], segment)).when(literal(shape["kind"]), F.array(segment(shape)))
    confidence = (
        F.when(shape.isNull(), "unresolved").when(segments.isNull(), "dynamic")
        .when(F.exists(segments, lambda s: s["kind"] == "dynamic"), "partial").otherwise("certain")
    )
    return F.struct(segments.alias("segments"), F.when(shape.isNotNull() & segments.isNull(), shape["kind"]).alias("opaque"), confidence.alias("confidence"))


def edge_flags(props: Column) -> Column:
    """struct(is_all, is_exact, narrowed) of an invalidation's filter. props: array of struct(name,
    kind, value), null where the call has no argument. Without a key it meets all queries; a literal
    ``exact: true`` asks for equal length; any other property narrows what it meets, unevaluably."""
    has = lambda name: F.exists(props, lambda p: p["name"] == name)
    exact = F.exists(props, lambda p: (p["name"] == "exact") & (p["kind"] == "boolean") & (p["value"] == "true"))
    plain = lambda p: (p["name"] == "queryKey") | ((p["name"] == "exact") & (p["kind"] == "boolean"))
    no = F.lit(False)
    return F.struct(
        F.when(props.isNull(), True).otherwise(~has("queryKey")).alias("is_all"), F.coalesce(exact, no).alias("is_exact"), F.coalesce(F.exists(props, lambda p: ~plain(p)), no).alias("narrowed"),
    )


# Calls that make registry rows.
QUERY_CALLS, MUTATION_CALLS = ("useQuery", "useInfiniteQuery"), ("useMutation",)
EDGE_CALLS = ("invalidateQueries", "refetchQueries", "removeQueries")


def query_registries(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, mutations, edges) of calls (id, parent, callee, host, file, line, key: a shape as in
    query_key, props as in edge_flags). An edge belongs to the nearest mutation around it; calls of
    the client outside of any mutation are none."""
    head = ["id", "host", "file", "line"]
    keyed = calls.withColumn("k", query_key(F.col("key")))
    shown = [F.col("k.segments").alias("segments"), F.col("k.opaque").alias("opaque"), F.col("k.confidence").alias("confidence")]
    queries = keyed.where(F.col("callee").isin(*QUERY_CALLS)).select(*head, F.col("callee").alias("kind"), *shown)
    mutations = calls.where(F.col("callee").isin(*MUTATION_CALLS)).select(*head)
    owned = owner(calls.select("id", "parent", F.col("callee").isin(*MUTATION_CALLS).alias("marked"))).withColumnRenamed("owner", "mutation_id")
    edges = keyed.where(F.col("callee").isin(*EDGE_CALLS)).join(owned.where("mutation_id is not null"), "id")
    return queries, mutations, edges.withColumn("f", edge_flags(F.col("props"))).select("mutation_id", *head, F.col("callee").alias("method"), "f.is_all", "f.is_exact", "f.narrowed", *shown)
