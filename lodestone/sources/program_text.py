"""What program text says outside of its comments, strings, templates and regular expressions.

One pass from left to right over a file finds those spans and blanks them in place, so every place
in the masked text is the same place in the file; imports, exports and calls are then read off the
masked text, with the contents of their strings taken from the file. Each file is scanned once.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the inside of a string, template or regular expression becomes; no program text has it.
FILL = "\x01"

_NEXT = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>(?:(?<![\w$])|(?<=\bfrom)|(?<=\bimport)|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof)|(?<=\bin)|(?<=\bof))(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"))|(?P<template>`)|(?P<open>\{)|(?P<close>\})|(?P<slash>/)""", re.S
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
# Words after which an expression begins, so that a slash opens a regular expression.
BEFORE_EXPRESSION = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _ends_operand(code: str) -> bool:
    """Whether a slash behind this code divides (or closes a tag) and opens no regular expression."""
    word = _WORD_BEFORE.search(code)
    return word[0] not in BEFORE_EXPRESSION if word else code[-1] in ")]}<"


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of comments, and of the insides of strings, templates and regular
    expressions. The expressions in a template are code. A quote right behind a word (but for a few
    that may stand before one) or without its partner on the line is a character of JSX text."""
    at, depth, holes, operand = 0, 0, [], False
    while m := _NEXT.search(text, at):
        kind = m.lastgroup
        if code := text[at : m.start()].rstrip():
            operand = _ends_operand(code)
        at = m.end()
        if kind == "comment":
            yield "comment", *m.span()
        elif kind == "string":
            yield "string", m.start() + 1, m.end() - 1
            operand = True
        elif kind == "slash":
            found = None if operand else _REGEX.match(text, m.start())
            if found:
                at = found.end()
                yield "regex", m.start() + 1, text.rindex("/", 0, at)
            operand = bool(found)
        elif kind == "open":
            depth += 1
            operand = False
        elif kind == "close" and not (holes and holes[-1] == depth):
            depth -= 1
            operand = True
        else:
            # A template's text, from its start or from behind one of its expressions.
            if kind == "close":
                holes.pop()
            end = _TEMPLATE.match(text, at).end()
            yield "template", at, end
            inside = text.startswith("${", end)
            if inside:
                holes.append(depth)
            at = min(len(text), end + 1 + inside)
            operand = not inside


def masked(text: str, strings: bool = True) -> str:
    """The text with its comments as blanks and, with ``strings``, the insides of strings, templates and
    regular expressions as ``FILL``. Line breaks stay, and so does every other place."""
    out, at = [], 0
    for kind, begin, end in spans(text):
        if kind == "comment" or strings or kind == "regex":
            fill = " " if kind == "comment" else FILL
            out += [text[at:begin], re.sub(r"[^\n]", fill, text[begin:end])]
            at = end
    return "".join([*out, text[at:]])


_STR = rf"""(?P<q>['"])(?P<spec>{FILL}*)(?P=q)"""
_CLAUSE = r"(?P<clause>[\w$\s{},*]+?)"
_STATEMENTS = re.compile(
    rf"""(?<![\w$.])(?:import\s+(?P<type>type\s+(?!from\b|,))?{_CLAUSE}\s*\bfrom\s*{_STR}"""
    rf"""|export\s+(?P<xtype>type\s+)?(?P<xclause>\*(?:\s*as\s+[\w$]+)?|\{{[^}}]*\}})\s*from\s*{_STR.replace("<q>", "<xq>").replace("=q", "=xq").replace("<spec>", "<xspec>")}"""
    rf"""|import\s+(?P<rname>[\w$]+)\s*=\s*require\s*\(\s*{_STR.replace("<q>", "<rq>").replace("=q", "=rq").replace("<spec>", "<rspec>")}\s*\)"""
    rf"""|import\s*{_STR.replace("<q>", "<bq>").replace("=q", "=bq").replace("<spec>", "<bspec>")}"""
    rf"""|(?P<call>import|require)\s*\(\s*(?:{_STR.replace("<q>", "<cq>").replace("=q", "=cq").replace("<spec>", "<cspec>")}\s*(?=[,)]))?)"""
)
_BINDING = re.compile(r"(?:type\s+)?([\w$]+|\*)(?:\s+as\s+([\w$]+))?\Z")


def _bindings(clause: str) -> list[tuple[str, str]]:
    """(name in the module, name here) of an import or export clause."""
    out, braces = [], re.search(r"\{([^}]*)\}", clause)
    for x in (braces[1] if braces else "").split(","):
        if m := _BINDING.match(x.strip()):
            out.append((m[1], m[2] or m[1]))
    for x in re.sub(r"\{[^}]*\}", "", clause).split(","):
        if m := _BINDING.match(x.strip()):
            out.append(("*", m[2] or "*") if m[1] == "*" else ("default", m[1]))
    return out


def _shown(clause: str) -> str:
    return ",".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in re.sub(r"[{}]", " ", clause).split(",")) if x)


def import_statements(text: str) -> list[tuple]:
    """(begin, spec, shown clause, type_only, kind, bindings) of static imports, re-exports, side-effect
    imports, ``require`` and ``import()``; the spec of a computed one is None."""
    code, out = masked(text), []
    for m in _STATEMENTS.finditer(code):
        g = m.groupdict()
        inside = lambda name: text[m.start(name) : m.end(name)]  # noqa: E731, B023
        if g["clause"] is not None:
            out.append((m.start(), inside("spec"), _shown(g["clause"]), bool(g["type"]), "import", _bindings(g["clause"])))
        elif g["xclause"] is not None:
            bound = _bindings(g["xclause"])
            out.append((m.start(), inside("xspec"), _shown(g["xclause"]), bool(g["xtype"]), "re-export", bound))
        elif g["rname"] is not None:
            out.append((m.start(), inside("rspec"), g["rname"], False, "require", [("*", g["rname"])]))
        elif g["bspec"] is not None:
            out.append((m.start(), inside("bspec"), "", False, "side-effect", []))
        elif g["cspec"] is not None:
            out.append((m.start(), inside("cspec"), "", False, "dynamic" if g["call"] == "import" else "require", [("*", "*")]))
        elif g["call"] == "import":
            out.append((m.start(), None, "", False, "computed", [("*", "*")]))
    return out


_EXPORT = re.compile(
    r"""(?<![\w$.])export\s+(?:(?P<default>default)\b\s*)?(?:declare\s+)?(?:(?:abstract\s+|async\s+)?(?P<kind>function\s*\*?|class|const\s+enum|const|let|var|interface|type|enum|namespace)\s+)?"""
    r"""(?P<name>(?!(?:as|from)\b)[\w$]+)?(?P<list>\{[^}]*\})?(?P<star>\*)?"""
)
_FROM = re.compile(r"\s*(?:as\s+[\w$]+\s*)?from\b")


def export_statements(text: str) -> list[tuple[int, str, str, str]]:
    """(begin, exported name, local name, kind) of what a file declares or lists as exports of its own.
    Re-exports from other files are ``import_statements``."""
    code, out = masked(text), []
    for m in _EXPORT.finditer(code):
        kind = re.sub(r"[\s*]+$|\s+(?=enum)", "", m["kind"] or "")
        if m["star"] or _FROM.match(code, m.end()) and m["list"]:
            continue
        if m["default"]:
            named = m["name"] if m["kind"] or m["name"] and re.match(r"\s*(?:;|\n|\Z)", code[m.end() :]) else None
            out.append((m.start(), "default", named or "default", kind or "expression"))
        elif m["list"] and m["kind"]:
            for x in m["list"][1:-1].split(","):
                if name := re.match(r"\s*(?:\.\.\.)?\s*(?:[\w$]+\s*:\s*)?([\w$]+)", x):
                    out.append((m.start(), name[1], name[1], kind))
        elif m["list"]:
            out += [(m.start(), here, there, "list") for there, here in _bindings(m["list"])]
        elif m["kind"] and m["name"]:
            out.append((m.start(), m["name"], m["name"], kind))
    return out


def _argument(code: str, at: int) -> int:
    """The end of the argument that begins at a place: a comma or bracket of its own level."""
    level = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            level += 1
        elif c in ")]}":
            if not level:
                return i
            level -= 1
        elif c == "," and not level:
            return i
    return len(code)


_LITERAL = re.compile(r"""'[^'\\]*'\Z|"[^"\\]*"\Z|`[^`$\\]*`\Z""")


def calls(text: str, named: re.Pattern) -> list[tuple]:
    """(begin, function, argument's value or None, argument as written) of calls with an argument."""
    code, out = masked(text), []
    for m in named.finditer(code):
        end = _argument(code, m.end())
        arg = text[m.end() : end].strip()
        if code[m.end() : end].strip():
            out.append((m.start(), m[1], arg[1:-1] if _LITERAL.match(arg) else None, arg))
    return out


def _by_file(files: DataFrame, rows_of, names: list[str], kinds: str) -> DataFrame:
    """What a function of a file's text gives, with the file and the line of each row's place."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                text = bytes(content).decode(errors="replace")
                breaks = [m.start() for m in re.finditer("\n", text)]
                rows += [(path, bisect.bisect_left(breaks, r[0]) + 1, *r[1:]) for r in rows_of(text)]
            yield pd.DataFrame(rows, columns=["file", "line", *names])

    return files.select("path", "content").mapInPandas(run, f"file string, line int, {kinds}")


def imports(files: DataFrame) -> DataFrame:
    """(file, line, spec, imports, type_only, dynamic, star_reexport, kind, bindings) by syntax alone.
    bindings: (name, local) of what the statement takes; ``*`` is the module as a whole. A computed
    ``import(expr)`` has no spec."""
    def rows(text):
        return [(at, spec, shown, only, kind in ("dynamic", "computed"), kind == "re-export" and ("*", "*") in bound, kind, [{"name": a, "local": b} for a, b in bound]) for at, spec, shown, only, kind, bound in import_statements(text)]

    names = ["spec", "imports", "type_only", "dynamic", "star_reexport", "kind", "bindings"]
    return _by_file(files, rows, names, "spec string, imports string, type_only boolean, dynamic boolean, star_reexport boolean, kind string, bindings array<struct<name:string,local:string>>")


def exports(files: DataFrame) -> DataFrame:
    """(file, line, name, local, kind) of the names that files export themselves."""
    return _by_file(files, export_statements, ["name", "local", "kind"], "name string, local string, kind string")


def literal_calls(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, fn, arg, dynamic, text, line, provenance): calls of the given names with their first
    argument: its value if it is a plain literal, its text as it is written."""
    named = re.compile(r"(?<![\w$.])(" + "|".join(re.escape(n) for n in names) + r")\s*(?:<[\w$\s,.\[\]|]*>)?\(\s*")
    found = _by_file(files, lambda text: [(at, fn, arg, arg is None, shown) for at, fn, arg, shown in calls(text, named)], ["fn", "arg", "dynamic", "text"], "fn string, arg string, dynamic boolean, text string")
    return found.select("file", "fn", "arg", "dynamic", "text", F.col("line").cast("long").alias("line"), F.lit("heuristic:syntax").alias("provenance"))


def code(files: DataFrame) -> DataFrame:
    """``files`` with comments (and regular expressions) blanked in their content, strings left."""

    def run(batches):
        for b in batches:
            b["content"] = [masked(bytes(x).decode(errors="replace"), strings=False).encode() for x in b["content"]]
            yield b

    return files.select("path", "content").mapInPandas(run, "path string, content binary")
