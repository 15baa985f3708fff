"""Targets, arguments and git facts."""

import json
import subprocess
import time

from lodestone.plans import intake
from lodestone.sources import git


def test_targets():
    assert intake.target("ts:Card@src/a.tsx:3:7~0123abcd") == {"symbol_id": "ts:Card@src/a.tsx:3:7~0123abcd"}
    assert intake.decoded("ts:Card@src/a.tsx:3:7~0123abcd") == {"name": "Card", "file": "src/a.tsx", "line": 3, "col": 7, "tag": "0123abcd"} and intake.decoded("Card") is None
    assert intake.target("src/a.tsx:3") == {"file": "src/a.tsx", "line": 3} and intake.target("src/a.tsx:3:9")["col"] == 9 and intake.target("useThing") == {"name": "useThing"}


def test_arguments(tmp_path):
    got = intake.normalised({"symbols": "A", "groupBy": "enclosing", "files": [["a"], "b"]})
    assert got.args == {"symbols": ["A"], "group_by": "enclosing", "files": ["a", "b"]} and len(got.notes) == 3
    intake.log_call(str(tmp_path / "log"), "impact", {"a": 1}, True, time.time())
    assert json.loads((tmp_path / "log").read_text())["tool"] == "impact"


def test_status_text():
    assert git.parse_status(" M a.ts\0R  new.ts\0old.ts\0?? x y.ts\0") == [("M", "a.ts", None), ("R", "new.ts", "old.ts"), ("??", "x y.ts", None)]


def test_git_tables(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("x\ny\n")
    run("add", ".")
    run("commit", "-qm", "first")
    before = git.fingerprint(str(tmp_path))
    (tmp_path / "a.ts").write_text("x\nz\n")
    (tmp_path / "b.ts").write_text("")
    assert git.fingerprint(str(tmp_path)) != before
    assert [r[0] for r in git.tracked(spark, str(tmp_path)).collect()] == ["a.ts"]
    assert [r[0] for r in git.changed_since(spark, str(tmp_path), "HEAD").collect()] == ["a.ts", "b.ts"]
    assert git.log(spark, str(tmp_path)).first()["subject"] == "first"
    assert git.history(spark, str(tmp_path)).truncated is None
    assert [r["line"] for r in git.blame(spark, str(tmp_path), "a.ts").orderBy("line").collect()] == [1, 2]


def test_config_is_strict():
    import pytest

    from lodestone.plans.intake import Config, config

    assert config("{}") == Config() and config('{"include": ["src/**"], "table_rows": 5}') == Config(include=("src/**",), table_rows=5)
    for text, fault in (('{"includes": []}', "no setting includes"), ('{"include": "x"}', "list of texts"), ('{"table_rows": true}', "number"), ('{"locales": 1}', "a text"), ("[]", "object"), ("{", "not JSON")):
        with pytest.raises(ValueError, match=fault):
            config(text)
