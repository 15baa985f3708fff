"""Innermost declarations, places in UTF-16 units, config members, composed edits, bounded walks, refresh by bucket."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalogue, changes, positions, usages
from lodestone.sources import walk
from lodestone.streaming import refresh


def test_sweep_gives_what_all_pairs_give(spark):
    rng = random.Random(4)
    decls = [(i, f"f{rng.randint(0, 3)}", b := rng.randint(0, 60), b + rng.randint(0, 25)) for i in range(150)] + [(900, None, 0, 9), (901, "f0", None, 5)]
    refs = [(i, f"f{rng.randint(0, 4)}", rng.randint(-2, 90)) for i in range(300)] + [(990, None, 3), (991, "f0", None), (0, "f0", 5), (0, "f0", 5)]
    got = sorted((tuple(r) for r in usages.enclosed(spark.createDataFrame(refs, "ref_id long, file string, start int").repartition(5), spark.createDataFrame(decls, "decl_id long, file string, begin int, end int")).collect()), key=repr)
    want = []
    for i, f, s in refs:
        around = [(e - b, d) for d, g, b, e in decls if f is not None and s is not None and g == f and b is not None and b <= s < e]
        want.append((i, f, s, min(around)[1] if around else None))
    assert got == sorted(want, key=repr)


def test_sweep_of_one_long_file(spark):
    n = 100_000
    decls = spark.range(n).select(F.col("id").alias("decl_id"), F.lit("f").alias("file"), (F.col("id") * 2).alias("begin"), F.when(F.col("id") < 1000, 4 * n - F.col("id")).otherwise(F.col("id") * 2 + 2).alias("end"))
    refs = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("f").alias("file"), (F.col("id") * 2 + 1).alias("start"))
    got = usages.enclosed(refs, decls)
    assert got.count() == n and got.where("ref_id >= 1000 and encloser_id <> ref_id").count() == 0
    assert got.where("ref_id = 500").first()["encloser_id"] == 500


def units(text):
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def test_places_in_utf16_units_and_back(spark):
    rng = random.Random(7)
    texts = ["", "\n", "a\r\nb", "\U0001f600\n\U0001f600x\U0001f680\n\né漢\n"] + ["".join(rng.choice("ab\n\r\U0001f600é漢") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")
    lines = positions.line_index(files)
    asked, want = [], {}
    for i, t in enumerate(texts):
        wide = t.encode("utf-16-le")
        for at in range(-1, units(t) + 2):
            asked.append((len(asked), f"f{i}", at))
            head = wide[: 2 * at].decode("utf-16-le", "surrogatepass") if 0 <= at <= units(t) else None
            want[len(asked) - 1] = (None, None) if head is None else (head.count("\n") + 1, units(head.rsplit("\n", 1)[-1]) + 1)
    found = positions.located(spark.createDataFrame(asked, "ref_id long, file string, start long"), lines)
    got = {r["ref_id"]: (r["line"], r["col"]) for r in found.collect()}
    assert got == want
    back = positions.offsets_of(found.where("line is not null"), lines)
    assert back.where("offset <> start or offset is null").count() == 0
    places = spark.createDataFrame([("f3", 1, 3, "end"), ("f3", 1, 5, "far"), ("f3", 9, 1, "none"), ("f3", 2, 0, "zero"), ("nofile", 1, 1, "no")], "file string, line long, col long, what string")
    assert {r["what"]: r["offset"] for r in positions.offsets_of(places, lines).collect()} == {"end": 2, "far": None, "none": None, "zero": None, "no": None}


def test_members_of_nested_configs(spark):
    paths = ["src/a.ts", "src/a.test.ts", "src/deep/b.tsx", "pkg/src/c.ts", "pkg/gen/d.ts", "pkg/node_modules/x.ts", "pkg/one.mts", "pkg/src/e.js", "a+b/f.ts", "root.ts", "pkg/test/g.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kind = "config string, include array<string>, exclude array<string>, files array<string>"
    configs = spark.createDataFrame([
        ("tsconfig.json", ["src"], ["**/*.test.ts"], None), ("pkg/tsconfig.json", None, ["gen"], None), ("pkg/tsconfig.test.json", ["./test/**/*", "src/?.ts"], [], ["gen/d.ts"]), ("plus.json", ["a+b/*.ts"], None, None), ("pkg/empty.json", [], None, None),
    ], kind)
    members, why = catalogue.config_members(configs, files)
    assert why is None and {tuple(r) for r in members.collect()} == {
        ("src/a.ts", "tsconfig.json"), ("src/deep/b.tsx", "tsconfig.json"), ("pkg/src/c.ts", "pkg/tsconfig.json"), ("pkg/one.mts", "pkg/tsconfig.json"), ("pkg/test/g.ts", "pkg/tsconfig.json"),
        ("pkg/test/g.ts", "pkg/tsconfig.test.json"), ("pkg/src/c.ts", "pkg/tsconfig.test.json"), ("pkg/gen/d.ts", "pkg/tsconfig.test.json"), ("a+b/f.ts", "plus.json"),
    }
    best = {r["file"]: r["config"] for r in catalogue.primary_config(files.select(F.col("path").alias("file")), members).collect()}
    assert best["pkg/src/c.ts"] == "pkg/tsconfig.json" and best["root.ts"] == "(no tsconfig)" and best["pkg/gen/d.ts"] == "pkg/tsconfig.test.json"
    assert catalogue.config_members(configs, files, max_configs=4)[1] == "too many configs (over 4)" and catalogue.config_members(configs, files, max_members=3)[1] == "too many members (over 3)"
    assert catalogue.config_members(configs.limit(0), files)[1] == "no config found"


def test_members_have_no_bound_unless_one_is_given(spark):
    n = 400_001
    files = spark.range(n).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    configs = spark.createDataFrame([("tsconfig.json", None, None, None)], "config string, include array<string>, exclude array<string>, files array<string>")
    members, why = catalogue.config_members(configs, files)
    assert why is None and members.count() == n


def applied(text, edits):
    out, at = [], 0
    for b, e, t in edits:
        out += [text[at:b], t]
        at = e
    return "".join([*out, text[at:]])


def test_composed_plans_give_what_both_in_turn_give(spark):
    rng = random.Random(11)
    first, then, cases = [], [], {}
    for i in range(120):
        text = "".join(rng.choice("abcdef") for _ in range(40))

        def plan(n, size):
            cuts = sorted(rng.sample(range(size + 1), min(2 * n, size + 1) // 2 * 2))
            return [(b, e, rng.choice(["", "X", "YZW", "longer"])) for b, e in zip(cuts[::2], cuts[1::2])]

        a = plan(3, 40)
        middle = applied(text, a)
        b = plan(2, len(middle))
        first += [(f"f{i}", *x) for x in a]
        then += [(f"f{i}", *x) for x in b]
        cases[f"f{i}"] = (text, a, b, applied(middle, b))
    kind = "file string, begin int, end int, text string"
    p, q = spark.createDataFrame(first, kind), spark.createDataFrame(then, kind)
    _, conflicts = changes.composed(p, q)
    bad = {r["file"] for r in conflicts.collect()}
    assert 10 < len(bad) < 110
    assert changes.composed(p, q)[0].count() == 0
    good = [f for f in cases if f not in bad]
    plan, conflicts = changes.composed(p.where(F.col("file").isin(good)), q.where(F.col("file").isin(good)))
    assert conflicts.count() == 0
    rows = {}
    for r in plan.collect():
        rows.setdefault(r["file"], []).append(r)
    for f in good:
        text, a, b, want = cases[f]
        own = sorted(rows[f], key=lambda r: (r["begin"], r["end"], -r["plan"]))
        assert applied(text, [(r["begin"], r["end"], r["text"]) for r in own]) == want, f
    # What is refused does reach into text that the first plan wrote.
    for f in bad:
        _, a, b, _ = cases[f]
        spans, move = [], 0
        for s, e, t in a:
            spans.append((s + move, s + move + len(t)))
            move += len(t) - (e - s)
        assert any(s < y and x < e for x, y in spans for s, e, _ in b) or any(s <= x <= e for x, y in spans if x == y for s, e, _ in b)


def test_walks_keep_their_bounds(spark, tmp_path):
    for p in ("a/x.ts", "a/b/y.ts", "a/b/c/z.ts", "node_modules/n.ts", "w.ts", "d/big.ts", "d/t.ts~"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1" * (50 if "big" in p else 3))
    os.symlink(tmp_path, tmp_path / "a/loop")
    os.symlink(tmp_path / "w.ts", tmp_path / "d/link.ts")

    def run(**options):
        found = walk.bounded_walk(spark, str(tmp_path), **options)
        return sorted(r["path"] for r in found.where("kind = 'file'").collect()), walk.walk_notes(found)

    for split in (1, 2, 64):
        assert run(split=split) == (["a/b/c/z.ts", "a/b/y.ts", "a/x.ts", "d/big.ts", "w.ts"], ["2 links not followed"])
        assert run(split=split, maxDepth=1) == (["a/x.ts", "d/big.ts", "w.ts"], ["1 directories beyond the depth", "2 links not followed"])
        assert "the bound on entries was reached" in run(split=split, maxEntries=4)[1] and len(run(split=split, maxEntries=4)[0]) <= 4
        assert run(split=split, seconds=-1) == ([], ["the time was over"])
    assert run(maxBytes=10)[0] == ["a/b/c/z.ts", "a/b/y.ts", "a/x.ts", "w.ts"]
    missing = walk.bounded_walk(spark, str(tmp_path / "nowhere"))
    assert missing.where("kind = 'file'").count() == 0 and walk.walk_notes(missing)[0].startswith("unreadable")


def test_refresh_rewrites_the_buckets_of_a_batch(spark, tmp_path):
    src, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "path string, mtime_ms long, size long, removed boolean"
    facts = "path string, mtime_ms long, size long"
    spark.createDataFrame([(f"p{i}", 1, i, False) for i in range(200)], kind).coalesce(1).write.parquet(src)
    refresh.follow_buckets(spark, src, kind, out, str(tmp_path / "cp"), buckets=8).awaitTermination()
    assert refresh.bucketed(spark, out, facts).count() == 200
    spark.createDataFrame([("p7", 2, 70, False)], kind).coalesce(1).write.mode("append").parquet(src)
    refresh.follow_buckets(spark, src, kind, out, str(tmp_path / "cp"), buckets=8).awaitTermination()
    assert [len(list((tmp_path / f"out/data/v{v}").glob("bucket=*"))) for v in (0, 1)] == [8, 1]
    assert refresh.bucketed(spark, out, facts).where("path = 'p7'").first()["size"] == 70 and refresh.bucketed(spark, out, facts).count() == 200
    # A batch that is run again changes nothing, removals empty a bucket, old versions go.
    again = spark.createDataFrame([("p7", 2, 70, False)], kind)
    before = sorted(map(tuple, refresh.bucketed(spark, out, facts).collect()))
    assert len(refresh.apply_batch(spark, again, 1, out, buckets=8)) == 1 and sorted(map(tuple, refresh.bucketed(spark, out, facts).collect())) == before
    bucket = {r["path"] for r in refresh.bucketed(spark, out, facts).where("pmod(xxhash64(path), 8) = pmod(xxhash64('p7'), 8)").collect()}
    gone = spark.createDataFrame([(p, 3, 0, True) for p in bucket], kind)
    refresh.apply_batch(spark, gone, 2, out, buckets=8)
    assert refresh.bucketed(spark, out, facts).count() == 200 - len(bucket)
    for epoch in (3, 4):
        refresh.apply_batch(spark, spark.createDataFrame([(f"q{epoch}", epoch, 1, False)], kind), epoch, out, buckets=8)
    assert refresh.versions(spark, out) == [3, 4] and refresh.bucketed(spark, out, facts).count() == 202 - len(bucket)
    assert not (tmp_path / "out/data/v1").exists() and refresh.bucketed(spark, out, facts, 3).count() == 201 - len(bucket)


def test_every_place_of_a_word_in_a_long_line(spark):
    df = spark.createDataFrame([("f", 1, "ab " * 50_000), ("f", 2, "abc xab ab_ .ab, ab"), ("f", 3, "none")], "file string, line int, text string")
    got = usages.text_spans(df, "ab")
    assert got.where("line = 1").count() == 50_000 and got.where("line = 1 and col % 3 <> 1").count() == 0
    assert sorted((r["line"], r["col"], r["end_col"]) for r in got.where("line > 1").collect()) == [(2, 14, 16), (2, 18, 20)]
