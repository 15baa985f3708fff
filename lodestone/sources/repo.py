"""Files of a repository and facts that plain text gives: imports, manifests, locale keys, styles, endpoints."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import kept
from lodestone.functions.storage import materialised
from lodestone.operators.cascade import specificity_of
from lodestone.plans.intake import Config
from lodestone.sources.program_text import code as without_comments
from lodestone.sources.program_text import exports, imports, literal_calls
from lodestone.sources.walk import IGNORED, bounded_walk, walk_notes

MAX_BYTES = 1 << 20


def walk(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime_ms, content) of files under a root, ignored directories and files over 1 MiB left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = ~F.col("path").rlike("/(?:" + "|".join(re.escape(x) for x in IGNORED) + ")/")
    return files.where(inside & (F.col("length") <= MAX_BYTES)).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime_ms"), "content")


def walked(spark: SparkSession, root: str, **bounds) -> tuple[DataFrame, list[str]]:
    """``walk`` within bounds of depth, entries and time (options of ``WalkSource``), and what it left out. The tree
    is read once, into the shared folder."""
    found = materialised(bounded_walk(spark, root, content=True, **bounds))
    head = root.removeprefix("file://").rstrip("/")
    return found.where("kind = 'file'").select(F.concat(F.lit(f"file:{head}/"), F.col("path")).alias("path"), "size", "mtime_ms", "content"), walk_notes(found)


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", "size", "mtime_ms", F.sha2("content", 256).alias("hash"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text), lines from 1."""
    text = F.split(F.decode("content", "UTF-8"), "\r?\n", -1)
    return files.select(F.col("path").alias("file"), F.posexplode(text).alias("line", "text")).withColumn("line", F.col("line") + 1)


def manifests(files: DataFrame) -> DataFrame:
    """(package_dir, package, dep, section) of package.json files."""
    kind = "struct<name:string,dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>,optionalDependencies:map<string,string>>"
    parsed = files.where(F.col("path").endswith("package.json")).select(F.regexp_replace("path", "/?package.json$", "").alias("package_dir"), F.from_json(F.decode("content", "UTF-8"), kind).alias("m"))
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")

    def named(section):
        keys = F.coalesce(F.map_keys(f"m.{section}"), F.array().cast("array<string>"))
        return F.transform(keys, lambda k: F.struct(k.alias("dep"), F.lit(section).alias("section")))

    pairs = F.concat(*[named(s) for s in sections])
    return parsed.select("package_dir", F.col("m.name").alias("package"), F.explode(pairs).alias("p")).select("package_dir", "package", "p.dep", "p.section")


_WHITE = re.compile(r"[ \t\r\n]*")


def flattened(text: str) -> tuple[list[tuple[str, str, int]], str | None]:
    """(dotted key, value, line) of each leaf of a JSON text, in its order; of a broken text those
    before the first error, and its message. Arrays are leaves, written compactly."""
    out: list[tuple[str, str, int]] = []
    decoder, breaks = json.JSONDecoder(), [i for i, c in enumerate(text) if c == "\n"]
    skip = lambda at: _WHITE.match(text, at).end()

    def expect(what: str, at: int) -> int:
        if text[at : at + 1] not in tuple(what):
            raise json.JSONDecodeError(f"Expecting {' or '.join(what)}", text, at)
        return at + 1

    def value(head: str, at: int, line: int) -> int:
        if text[at : at + 1] != "{":
            found, end = decoder.raw_decode(text, at)
            out.append((head, found if isinstance(found, str) else json.dumps(found, separators=(",", ":"), ensure_ascii=False), line))
            return end
        at = skip(at + 1)
        while text[at : at + 1] != "}":
            expect('"', at)
            key, end = decoder.raw_decode(text, at)
            line = bisect.bisect_left(breaks, at) + 1
            at = skip(expect(":", skip(end)))
            at = skip(value(f"{head}.{key}" if head else key, at, line))
            if text[at : at + 1] == ",":
                at = skip(at + 1)
                expect('"', at)
            else:
                expect("}", at)
        return at + 1

    try:
        end = skip(value("", skip(0), 1))
        return out, None if end == len(text) else f"Extra data at {end}"
    except (json.JSONDecodeError, RecursionError) as e:
        return out, getattr(e, "msg", "nested too deeply")


def locale_keys(files: DataFrame) -> DataFrame:
    """(file, locale, key, value, line, error) of locale files named by their locale."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                keys, error = flattened(bytes(content).decode(errors="replace"))
                locale = re.sub(r"\.json$", "", path.rsplit("/", 1)[-1])
                rows += [(path, locale, k, v, n, None) for k, v, n in keys]
                rows += [(path, locale, None, None, None, error)] if error else []
            yield pd.DataFrame(rows, columns=["file", "locale", "key", "value", "line", "error"]).astype({"line": "Int64"})

    return files.select("path", "content").mapInPandas(run, "file string, locale string, key string, value string, line long, error string")


def style_rules(text: str) -> list[tuple[int, str, str, str, bool, int, int, tuple[str, ...], bool]]:
    """(rule, selector, property, value, important, position, line, at-rules around it, whether its
    rule stands alone at the root) of a style sheet; nested rules are written out, ``&`` standing for
    each selector of the parent. A rule without declarations of its own has one row with a null
    property for each selector."""
    text = re.sub(r"/\*.*?\*/|(?<![:\w])//[^\n]*", lambda m: " " * len(m[0]), text, flags=re.S)
    out, stack, held, rule, interpolated = [], [[""]], "", 0, 0
    rules = [(0, (), 1, True)]  # number, at-rules, line, whether at the root
    own, nested = {0}, set()
    for pos, c in enumerate(text):
        if c == "{" and held.endswith("#"):
            interpolated += 1
            held += c
        elif c == "}" and interpolated:
            interpolated -= 1
            held += c
        elif interpolated:
            held += c
        elif c == "{":
            head, line = held.strip(), text.count("\n", 0, pos) + 1
            held = ""
            number, around, _, _ = rules[-1]
            rule += 1
            if head.startswith("@"):
                stack.append(stack[-1])
                rules.append((rule, (*around, head), line, rules[-1][3]))
                own.add(rule)
            else:
                parents = stack[-1]
                nested.add(number)
                full = [(x.strip().replace("&", p) if "&" in x else f"{p} {x.strip()}".strip()) for p in parents for x in head.split(",") if x.strip()]
                stack.append(full[:512])
                rules.append((rule, around, line, parents == [""]))
        elif c in ";}":
            number, around, line, root = rules[-1]
            if ":" in held and not held.strip().startswith("@") and stack[-1] != [""]:
                prop, value = (x.strip() for x in held.split(":", 1))
                important = value.lower().endswith("!important")
                value = re.sub(r"\s*!important$", "", value, flags=re.I)
                out += [(number, x, prop, value, important, pos, line, around, root) for x in stack[-1]]
                own.add(number)
            elif held.strip().startswith("@extend") and stack[-1] != [""]:
                out += [(number, x, "@extend", held.strip()[7:].strip(), False, pos, line, around, root) for x in stack[-1]]
                own.add(number)
            held = ""
            if c == "}" and len(stack) > 1:
                if number not in own:
                    out += [(number, x, None, None, False, pos, line, around, root) for x in stack[-1] if x]
                stack.pop()
                rules.pop()
        else:
            held += c
    return [(*r[:8], r[8] and r[0] not in nested) for r in out]


def styles(files: DataFrame) -> DataFrame:
    """(file, rule_ix, selector, prop, value, important, pos, line, at_context, alone) of style sheets."""
    names = ["file", "rule_ix", "selector", "prop", "value", "important", "pos", "line", "at_context", "alone"]

    def run(batches):
        for b in batches:
            rows = [(path, *r[:7], list(r[7]), r[8]) for path, content in zip(b["path"], b["content"]) for r in style_rules(bytes(content).decode(errors="replace"))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "file string, rule_ix int, selector string, prop string, value string, important boolean, pos int, line int, at_context array<string>, alone boolean")


_CLASS = r"\.(-?[A-Za-z_][\w-]*)"
# ``:global(..)``, and what stands behind a bare ``:global`` (also by nesting).
_NO_GLOBAL = r":global\([^)]*\)|:global(?![\w(-]).*$"


def css_rules(sheets: DataFrame) -> DataFrame:
    """(file, rule_ix, selector, a, b, c, subject_classes, conditions, at_context, global, interpolated)
    of the rows of ``styles``: one for each rule and selector. The subject is the last compound; what
    stands before it, its states and attributes are conditions."""
    plain = F.trim(F.regexp_replace("selector", r"\s*([>+~])\s*", " "))
    subject = F.element_at(F.split(plain, r"\s+(?![^(\[]*[)\]])"), -1)
    rows = sheets.select("file", "rule_ix", "selector", "at_context").distinct().withColumn("_s", specificity_of("selector"))
    before = F.filter(F.slice(F.split(plain, r"\s+(?![^(\[]*[)\]])"), F.lit(1), F.size(F.split(plain, r"\s+(?![^(\[]*[)\]])")) - 1), lambda x: x != "")
    return rows.select(
        "file", "rule_ix", "selector", "_s.a", "_s.b", "_s.c", F.regexp_extract_all(F.regexp_replace(subject, _NO_GLOBAL, ""), F.lit(_CLASS), F.lit(1)).alias("subject_classes"),
        F.concat(before, F.regexp_extract_all(subject, F.lit(r"(::?[A-Za-z-]+(?:\([^)]*\))?|\[[^\]]*\])"), F.lit(1))).alias("conditions"), "at_context",
        F.contains("selector", F.lit(":global")).alias("global"), F.contains("selector", F.lit("#{")).alias("interpolated"),
    )


def css_decls(sheets: DataFrame) -> DataFrame:
    """(file, rule_ix, prop, value, important, computed, pos) of the rows of ``styles``."""
    rows = sheets.where("prop is not null and prop not like '@%' and prop <> 'composes'").select("file", "rule_ix", "prop", "value", "important", "pos").distinct()
    return rows.withColumn("computed", F.col("value").rlike(r"var\(|#\{|\$|calc\(|@"))


def css_classes(sheets: DataFrame) -> DataFrame:
    """(file, name, line, col, confidence, global, linked, entangled, interpolated) of the classes that
    sheets define. linked: another class of the sheet composes or extends it; entangled: it never is
    the sole class of a root rule that has no rules inside; interpolated: its name is computed in part."""
    bare = F.regexp_replace("selector", _NO_GLOBAL, "")
    of = sheets.select("file", "selector", "line", "alone", F.explode(F.array_distinct(F.concat(
        F.transform(F.regexp_extract_all(bare, F.lit(_CLASS), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(False).alias("global"))),
        F.transform(F.regexp_extract_all("selector", F.lit(r":global\(\s*\.(-?[A-Za-z_][\w-]*)"), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(True).alias("global"))),
    ))).alias("x"))
    sole = F.col("alone") & (F.col("selector") == F.concat(F.lit("."), F.col("x.name")))
    own = of.groupBy("file", "x.name").agg(
        F.min("line").alias("line"), F.lit(1).alias("col"), F.lit("certain").alias("confidence"), F.bool_and("x.global").alias("global"),
        (~F.bool_or(sole)).alias("entangled"), F.bool_or(F.contains("selector", F.lit("#{"))).alias("interpolated"),
    )
    extended = sheets.where("prop = '@extend'").select("file", F.explode(F.regexp_extract_all("value", F.lit(_CLASS), F.lit(1))).alias("name"))
    links = css_composes(sheets).where("local").select("file", "name").unionByName(extended).distinct().withColumn("linked", F.lit(True))
    return own.join(links, ["file", "name"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def css_composes(sheets: DataFrame) -> DataFrame:
    """(file, name, local) of classes that others compose: file is the sheet they come from, null where
    it is not among the sheets."""
    of = sheets.where("prop = 'composes'").select("file", "value").distinct()
    source = F.regexp_extract("value", r"\sfrom\s+['\"]([^'\"]+)['\"]", 1)
    named = of.select("file", source.alias("source"), F.explode(F.split(F.trim(F.regexp_replace("value", r"\sfrom\s.*$", "")), r"\s+")).alias("name")).where("name <> ''")
    target = _joined_path(F.regexp_replace("file", r"/[^/]*$", ""), F.col("source"))
    known = sheets.select(F.col("file").alias("_f")).distinct()
    out = named.withColumn("_t", F.when(F.col("source") != "", target).otherwise(F.col("file"))).join(known, F.col("_t") == F.col("_f"), "left")
    return out.select(F.col("_f").alias("file"), "name", (F.col("source") == "").alias("local")).distinct()


def css_accesses(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, name, site): classes that program files take from the sheets they import as modules; name
    is null where it is computed. found: rows of ``resolved_imports``."""
    text = F.decode("content", "UTF-8")
    modules = found.where(F.col("resolved").rlike(r"\.(?:css|scss|sass|less)$")).select(F.col("file").alias("path"), F.col("resolved").alias("sheet"), F.regexp_replace("imports", r"^\* as ", "").alias("local")).where(F.col("local").rlike(r"^[A-Za-z_$][\w$]*$"))
    rows = files.select("path", text.alias("text")).join(modules, "path")
    head = F.concat(F.lit(r"(?<![\w$.])"), F.regexp_replace("local", r"\$", r"\\\$"))
    pick = lambda tail, group=1: F.regexp_extract_all("text", F.concat(head, F.lit(tail)), F.lit(group))
    named = F.concat(pick(r"\??\.([A-Za-z_$][\w$]*)"), pick(r"(?:\?\.)?\[\s*['\"`]([^'\"`$]+)['\"`]\s*\]"))
    computed = F.size(pick(r"(?:\?\.)?\[\s*([^'\"\s\]][^\]]*)\]")) > 0
    all_of = F.concat(F.array_distinct(named), F.when(computed, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.col("sheet").alias("file"), F.explode(all_of).alias("name"), F.col("path").alias("site"))


def class_names(rules: DataFrame) -> DataFrame:
    """(file, name): classes that selectors name outside ``:global(..)``."""
    bare = F.regexp_replace("selector", _NO_GLOBAL, "")
    return rules.select("file", F.explode(F.regexp_extract_all(bare, F.lit(r"\.(-?[A-Za-z_][\w-]*)"), F.lit(1))).alias("name")).distinct()


# HTTP methods of a path.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_MEMBER = re.compile(r"""\s*(?:readonly\s+)?(?:'([^']*)'|"([^"]*)"|([\w$]+))\s*\??\s*:\s*(.*)\Z""", re.S)


def type_members(body: str) -> dict[str, str]:
    """Members of a type literal (the text between its braces) with the text of their types."""
    out, depth, begin, quote = {}, 0, 0, ""
    for i, c in enumerate(body + ";"):
        if quote:
            quote = "" if c == quote and body[i - 1 : i] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "{[(<":
            depth += 1
        elif c in "}])" or c == ">" and body[i - 1 : i] != "=":
            depth -= 1
        elif c in ";," and depth == 0:
            if m := _MEMBER.match(body[begin:i]):
                out[m[1] or m[2] or m[3] or ""] = m[4].strip()
            begin = i + 1
    return out


def _literal(kind: str | None) -> dict[str, str]:
    return type_members(kind[1:-1]) if kind and kind.startswith("{") and kind.endswith("}") else {}


def _interface(text: str, name: str) -> dict[str, str]:
    m = re.search(rf"\b(?:interface\s+{name}|type\s+{name}\s*=)\s*\{{", text)
    if not m:
        return {}
    depth, at = 1, m.end()
    while at < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        at += 1
    return type_members(text[m.end() : at - 1])


def _content(kind: str | None) -> str | None:
    """The schema of the first content type of a body, named ones by their name."""
    content = _literal(_literal(kind).get("content"))
    first = next(iter(content.values()), None)
    return re.sub(r"""components\s*\[\s*['"]schemas['"]\s*\]\s*\[\s*['"]([^'"]+)['"]\s*\]""", r"\1", re.sub(r"\s+", " ", first)) if first else None


def cards(text: str) -> list[tuple]:
    """(path, method, path_params, query, body, response, status, confidence, note) of each operation
    that a generated ``paths`` interface declares."""
    text = re.sub(r"/\*.*?\*/|(?<![:\w'\"/])//[^\n]*", " ", text, flags=re.S)
    operations, out = _interface(text, "operations"), []
    for path, kind in _interface(text, "paths").items():
        for method, what in _literal(kind).items():
            if method not in METHODS or what in ("never", "undefined"):
                continue
            named = re.fullmatch(r"""operations\s*\[\s*['"]([^'"]+)['"]\s*\]""", what)
            details = operations.get(named[1]) if named else what
            params = re.findall(r"\{([^}]+)\}", path)
            if details is None:
                out.append((path, method.upper(), params, None, None, None, None, "unresolved", f"no operation {named[1]}"))
                continue
            parts = _literal(details)
            query = _literal(parts.get("parameters")).get("query")
            answers = {k: v for k, v in _literal(parts.get("responses")).items() if k.isdigit()}
            status = next((k for k in sorted(answers) if k.startswith("2")), None)
            shown = re.sub(r"\s+", " ", query) if query and query != "never" else None
            out.append((path, method.upper(), params, shown, _content(parts.get("requestBody")), _content(answers.get(status)), int(status) if status else None, "certain" if parts else "partial", None))
    return out


def endpoint_cards(files: DataFrame) -> DataFrame:
    """(file, path, method, path_params, query, body, response, status, confidence, note) of generated
    API declarations; an operation that is not declared is unresolved."""

    def run(batches):
        for b in batches:
            rows = [(path, *c) for path, content in zip(b["path"], b["content"]) if b"interface paths" in bytes(content) or b"type paths" in bytes(content) for c in cards(bytes(content).decode(errors="replace"))]
            yield pd.DataFrame(rows, columns=["file", "path", "method", "path_params", "query", "body", "response", "status", "confidence", "note"]).astype({"status": "Int64"})

    return files.select("path", "content").mapInPandas(run, "file string, path string, method string, path_params array<string>, query string, body string, response string, status long, confidence string, note string")


_BALANCED = r"(?:[^(){}]|\{(?:[^{}]|\{[^{}]*\})*\}|\((?:[^()]|\([^()]*\))*\))*"


def class_tokens(files: DataFrame) -> DataFrame:
    """(file, token): class names in className attributes and in calls of clsx and the like: string
    literals wherever they stand (branches, arrays), and keys of objects."""
    text = F.decode("content", "UTF-8")
    plain = F.regexp_extract_all(text, F.lit(r"\b(?:className|class)\s*=\s*['\"]([^'\"]*)['\"]"), F.lit(1))
    inner = F.concat(F.regexp_extract_all(text, F.lit(r"\b(?:className|class)\s*=\s*\{(" + _BALANCED + r")\}"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b(?:clsx|classnames|classNames|cn|cx)\((" + _BALANCED + r")\)"), F.lit(1)))
    strings = F.flatten(F.transform(inner, lambda x: F.regexp_extract_all(x, F.lit(r"['\"`]([^'\"`$]*)['\"`]"), F.lit(1))))
    keys = F.flatten(F.transform(inner, lambda x: F.regexp_extract_all(x, F.lit(r"[{,]\s*([A-Za-z_][\w-]*)\s*:"), F.lit(1))))
    return files.select(F.col("path").alias("file"), F.explode(F.concat(plain, strings, keys)).alias("s")).select("file", F.explode(F.split(F.trim("s"), r"\s+")).alias("token")).where("token <> ''").distinct()


def _joined_path(base: Column, relative: Column) -> Column:
    """A relative path from a directory, with ``.`` and ``..`` resolved."""
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(relative, "/"), F.split(base, "/"), step), "/")


# What a specifier without an extension may stand for, in order.
ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolved_imports(found: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Rows of ``imports`` with resolved (the file that a relative specifier stands for, null where
    there is none), and package_dir and package of the nearest manifest above the file."""
    relative = F.col("spec").rlike(r"^\.{1,2}(?:/|$)")
    rows = found.withColumn("_i", F.xxhash64("file", "line", "spec"))
    base = _joined_path(F.regexp_replace("file", r"/[^/]*$", ""), F.col("spec"))
    may = rows.where(relative).select("file", "line", "spec", base.alias("_b")).distinct().select("file", "line", "spec", "_b", F.posexplode(F.array(*[F.lit(x) for x in ENDINGS])).alias("_n", "_e"))
    may = may.withColumn("path", F.concat("_b", "_e")).join(files.select("path").distinct(), "path")
    first = may.groupBy("file", "line", "spec").agg(F.min(F.struct("_n", "path")).alias("_r")).select("file", "line", "spec", F.col("_r.path").alias("resolved"))
    out = rows.drop("_i").join(first, ["file", "line", "spec"], "left")
    if packages is None:
        return out.withColumn("package_dir", F.lit(None).cast("string")).withColumn("package", F.lit(None).cast("string"))
    parts = F.split("file", "/")
    above = out.select("file").distinct().select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("package_dir"))
    nearest = above.join(packages.select("package_dir", "package").distinct(), "package_dir").groupBy("file").agg(F.max(F.struct(F.length("package_dir").alias("n"), "package_dir", "package")).alias("_p"))
    return out.join(nearest, "file", "left").select(*out.columns, F.col("_p.package_dir").alias("package_dir"), F.col("_p.package").alias("package"))


def packages(files: DataFrame) -> DataFrame:
    """(package_dir, package) of package.json files, those without dependencies too."""
    parsed = files.where(F.col("path").rlike("(?:^|/)package.json$"))
    return parsed.select(F.regexp_replace("path", "/?package.json$", "").alias("package_dir"), F.get_json_object(F.decode("content", "UTF-8"), "$.name").alias("package"))


def facts(spark: SparkSession, root: str, locales: str = Config.locales, translate: Sequence[str] = Config.translate, settings: Config | None = None, bounds: dict | None = None) -> dict[str, DataFrame]:
    """What the text of a tree gives to the engine's operations: imports, exports, manifests, locale keys and
    failures, translation calls, style rules, declarations, classes, composes and accesses, endpoints,
    text lines. ``locales`` says which files hold translations, ``translate`` how their calls are named;
    ``settings`` say both, and which files count at all. With ``bounds`` (of ``walked``) the walk is
    bounded, and the fact ``walk_notes`` (note) has what it left out."""
    notes: list[str] = []
    if bounds is None:
        files = walk(spark, root)
    else:
        files, notes = walked(spark, root, **bounds)
    if settings is not None:
        locales, translate = settings.locales, settings.translate
        head = F.regexp_replace("path", "^file:/*", "/")
        below = F.substring(head, F.lit(len(root.removeprefix("file://").rstrip("/")) + 2), F.length(head))
        files = files.where(kept(below, settings.include, settings.exclude))
    code = files.where(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)$"))
    sheets = styles(files.where(F.col("path").rlike(r"\.(?:css|scss|sass|less)$")))
    keys = locale_keys(files.where(F.col("path").rlike(locales)))
    edges = resolved_imports(imports(code), files, packages(files))
    plain = without_comments(code)
    return {
        "imports": edges, "exports": exports(code), "manifests": manifests(files), "locale_keys": keys.where("key is not null").drop("error"), "locale_failures": keys.where("error is not null").select("file", "locale", F.col("error").alias("message")),
        "literal_calls": literal_calls(code, list(translate)), "css_rules": css_rules(sheets), "css_decls": css_decls(sheets), "css_classes": css_classes(sheets), "css_composes": css_composes(sheets),
        "css_accesses": css_accesses(plain, edges), "class_tokens": class_tokens(plain), "endpoints": endpoint_cards(code), "text_lines": lines(code),
    } | ({"walk_notes": spark.createDataFrame([(x,) for x in notes], "note string")} if bounds is not None else {})
