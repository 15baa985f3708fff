"""Text and JSON forms of an answer."""

from __future__ import annotations

import json

from lodestone.plans.envelope import Envelope

DATA_CHARS = 20_000
FRAME_BYTES = 60_000


def cell(value) -> str:
    """NULL as a sign of its own; text that could be read as something else is quoted."""
    if value is None:
        return "∅"
    text = str(value)
    if isinstance(value, str) and (text == "" or text != text.strip() or "|" in text or "\n" in text or text == "∅" or text.replace(".", "", 1).lstrip("-").isdigit()):
        return json.dumps(text, ensure_ascii=False)
    return text


def table(answer: Envelope, limit: int = 1000) -> str:
    if not answer.ok:
        return f"!! {answer.failure.code}: {answer.failure.message}"
    rows = answer.df.limit(limit).collect()
    head = [f"⚠ PARTIAL: {', '.join(answer.bounded_tables)}"] if answer.partial else []
    lines = [" | ".join(answer.df.columns), *(" | ".join(cell(v) for v in r) for r in rows)]
    if answer.truncated:
        lines.append(f"({answer.truncated.shown} of {answer.truncated.total} rows; {answer.truncated.hint})")
    else:
        lines.append(f"({len(rows)} rows)")
    return capped_text("\n".join([*head, *lines, *(f"note: {n}" for n in answer.notes)]), DATA_CHARS)


def capped_text(text: str, chars: int) -> str:
    return text if len(text) <= chars else text[:chars] + f"\n… {len(text) - chars} more characters"


def capped_bytes(text: str, size: int = FRAME_BYTES) -> str:
    """A cut that never splits a character."""
    raw = text.encode()
    return text if len(raw) <= size else raw[:size].decode(errors="ignore") + "…"


def as_json(answer: Envelope, limit: int = 1000) -> str:
    if not answer.ok:
        return json.dumps({"ok": False, "failure": vars(answer.failure)}, ensure_ascii=False)
    body = {"ok": True, "columns": answer.df.columns, "rows": [list(r) for r in answer.df.limit(limit).collect()], "notes": answer.notes, "freshness": vars(answer.freshness)}
    if answer.truncated:
        body["truncated"] = vars(answer.truncated)
    if answer.partial:
        body["partial"] = {"boundedTables": answer.bounded_tables}
    return json.dumps(body, ensure_ascii=False, default=str)
