"""Targets and arguments as callers write them, in the form that operations take."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

# Other names of arguments.
ALIASES = {"symbol": "name", "path": "file", "pathInclude": "include", "pathExclude": "exclude", "groupBy": "group_by", "exportedOnly": "exported_only", "collapseImports": "collapse_imports", "mergeDeclarations": "merge_declarations", "testGlobs": "test_globs", "newName": "new_name"}

_ID = re.compile(r"^ts:(?P<name>.+)@(?P<file>.+):(?P<line>\d+):(?P<col>\d+)~(?P<tag>[0-9a-f]{8})$")
_PLACE = re.compile(r"^(?P<file>[^:\s]+\.[A-Za-z]+):(?P<line>\d+)(?::(?P<col>\d+))?$")


@dataclass
class Taken:
    args: dict
    notes: list[str] = field(default_factory=list)


def target(text: str) -> dict:
    """A symbol id, a place ``file:line[:col]`` or a name."""
    if _ID.match(text):
        return {"symbol_id": text}
    if m := _PLACE.match(text):
        return {"file": m["file"], "line": int(m["line"])} | ({"col": int(m["col"])} if m["col"] else {})
    return {"name": text}


def decoded(symbol_id: str) -> dict | None:
    """Parts of a symbol id, or None if it is none."""
    m = _ID.match(symbol_id)
    return {**m.groupdict(), "line": int(m["line"]), "col": int(m["col"])} if m else None


def normalised(args: Mapping, lists: Sequence[str] = ("symbols", "include", "exclude", "files", "targets", "members", "symbol_ids", "kinds", "programs"), own: Collection[str] = ()) -> Taken:
    """Other names replaced (but for those in ``own``, which the operation takes as they are), single
    values of list arguments wrapped, nested arrays flattened; what was changed is said."""
    out = Taken({})
    for key, value in args.items():
        name = key if key in own else ALIASES.get(key, key)
        if name != key:
            out.notes.append(f"{key} is taken as {name}")
        if name in lists:
            if isinstance(value, str):
                value = [value]
                out.notes.append(f"{name}: one value is taken as a list")
            elif any(isinstance(v, (list, tuple)) for v in value):
                value = [x for v in value for x in (v if isinstance(v, (list, tuple)) else [v])]
                out.notes.append(f"{name}: nested lists are flattened")
        out.args[name] = value
    return out


def log_call(path: str, tool: str, args: Mapping, ok: bool, began: float, cwd: str = ".") -> None:
    """Appends a call to a JSON-lines log on the driver."""
    now = time.time()
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"ts": int(now * 1000), "durationMs": int((now - began) * 1000), "tool": tool, "ok": ok, "cwd": cwd, "args": dict(args)}, ensure_ascii=False, default=str) + "\n")


@dataclass(frozen=True)
class Config:
    """Settings of a root: unknown names and wrong kinds are refused, not skipped."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    locales: str = "/locales?/[^/]+\\.json$"
    translate: tuple[str, ...] = ("t",)
    table_rows: int = 100_000
    result_rows: int = 1_000


def config(text: str) -> Config:
    """The settings of a JSON text; raises ValueError with every fault it has."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not JSON: {e}") from None
    if not isinstance(given, dict):
        raise ValueError("an object is wanted")
    faults, taken = [], {}
    for key, value in given.items():
        if key not in Config.__dataclass_fields__:
            faults.append(f"no setting {key}; there are {', '.join(Config.__dataclass_fields__)}")
            continue
        like = getattr(Config(), key)
        if isinstance(like, tuple):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                faults.append(f"{key} takes a list of texts")
            value = tuple(value) if isinstance(value, list) else value
        elif isinstance(like, int) and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
            faults.append(f"{key} takes a number from 1 on")
        elif isinstance(like, str) and not isinstance(value, str):
            faults.append(f"{key} takes a text")
        taken[key] = value
    if faults:
        raise ValueError("; ".join(faults))
    return Config(**taken)
