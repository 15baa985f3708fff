"""Exact search, audio fingerprints, components, SQL twins and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import audio, common, registry, topk


def plain_top(rows, every, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.25, 0.0, 1.0, -1.0]) for i in range(30)]  # ties
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [1.0, 2.0]), (210, [3.0, 1.0]), (None, [1.0] * 5), (220, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    for bins, block in ((2048, 4096), (3, 4)):
        got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), bins=bins, query_block=block).collect())
        assert got == plain_top(rows, 10, 10), (bins, block)


def test_top_k_with_huge_components(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 3.0]), (3, [5.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 3, 2] and got[0][3] == (1 << 63) - 1 and got[1][3] == 1024 * 10**9 * 5120 + 1024 * 7168
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def tone(notes, rate=audio.RATE, n=500):
    t = np.arange(n) / rate
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (p / 12) * t) for p in notes])


def test_audio_alignment():
    rng = np.random.default_rng(5)
    x = tone(rng.integers(0, 40, 60))
    a = audio.fingerprint(x)
    noisy = audio.fingerprint(0.5 * x + 0.002 * rng.normal(size=len(x)))
    cut = audio.fingerprint(x[audio.HOP * 7 :])
    offset, votes, error, overlap = audio.align(a, noisy)
    assert offset == 0 and error < 0.1 and overlap == len(a)
    offset, votes, error, overlap = audio.align(a, cut)
    assert offset == 7 and error < 0.01 and overlap == len(cut)
    other = audio.fingerprint(tone(rng.integers(0, 40, 60)))
    assert audio.align(a, other)[1] < audio.VOTES
    assert audio.align(a, a[:0]) == (0, 0, 1.0, 0)
    plain = max(((int((a[max(0, d) : max(0, d) + min(len(a) - max(0, d), len(cut) - max(0, -d))] == cut[max(0, -d) : max(0, -d) + min(len(a) - max(0, d), len(cut) - max(0, -d))]).sum()), -d) for d in range(-len(cut) + 1, len(a))))
    assert (-plain[1], plain[0]) == audio.align(a, cut)[:2]


def test_audio_boxes_are_sums():
    rng = np.random.default_rng(6)
    c = rng.random((40, audio.CLASSES))
    image = np.zeros((41, audio.CLASSES + 1))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(20)
    for first, classes, begin, frames in ((0, 12, 0, 16), (9, 7, 3, 5), (11, 1, 0, 1), (5, 12, 2, 4)):
        want = [c[i + begin : i + begin + frames][:, [(first + k) % 12 for k in range(classes)]].sum() for i in at]
        assert np.allclose(audio._boxes(image, at, first, classes, begin, frames), want)


def test_audio_matches(spark):
    rng = np.random.default_rng(7)
    x, y = tone(rng.integers(0, 40, 60)), tone(rng.integers(0, 40, 60))
    rows = [(50, x), (51, x), (52, x[audio.HOP * 4 :]), (53, y), (54, x[:100]), (55, None), (56, np.where(np.arange(len(x)) == 9, np.nan, x)), (100, y)]
    df = spark.createDataFrame([(i, None if s is None else [float(v) for v in s]) for i, s in rows], "rec_id long, samples array<double>")
    prints = audio.fingerprints(df)
    members, pairs = audio.matches(prints, df.where("rec_id % 50 = 0"))
    assert {(r["rec_id"], r["class_id"]) for r in members.collect()} == {(50, 50), (51, 50), (52, 52), (53, 53), (100, 53), (54, 54), (55, 55), (56, 56)}
    assert [(r["query_class"], r["class_id"], r["offset"]) for r in pairs.collect()] == [(50, 52, 4)]
    assert audio.fingerprints(df.limit(0)).count() == 0


def test_audio_against_aligning_all_pairs(spark):
    """Every pair that aligns is found, from noisy copies cut anywhere, and with long silence; also in
    small blocks."""
    rng = np.random.default_rng(8)
    base = [tone(rng.integers(0, 40, 40), n=250) for _ in range(6)]
    rows = [*base, *(b[int(rng.integers(0, 2000)) :] for b in base)]
    rows += [x + rng.normal(0, noise, len(x)) for b in base for noise in (0.02, 0.1, 0.2) for x in (b[int(rng.integers(0, 2500)) :],)]
    rows += [np.concatenate([np.zeros(6000), b[:4000]]) for b in base[:3]]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "rec_id long, samples array<double>")
    prints = audio.fingerprints(df)
    ints = {r["rec_id"]: np.frombuffer(bytes(r["ints"]), "<u4") for r in prints.collect()}
    want = set()
    for q in range(0, len(rows), 2):
        for c in range(len(rows)):
            offset, votes, error, overlap = audio.align(ints[q], ints[c])
            if c != q and votes >= audio.VOTES and error <= audio.BIT_ERROR:
                want.add((q, c, offset, votes, round(error, 9), overlap))
    for block in (audio.BLOCK, 60):
        _, pairs = audio.matches(prints, df.where("rec_id % 2 = 0"), block=block)
        assert {(*tuple(r)[:4], round(r["bit_error"], 9), r["overlap"]) for r in pairs.collect()} == want
    assert len(want) > 20


def test_peaks_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    block = [(i, rng.integers(0, 5, 40).astype("<u4").tobytes()) for i in range(5)]
    x = rng.integers(0, 5, 30).astype("<u4")
    index = audio.Index(block)
    whole = [v.tolist() for v in index.peaks(x)]
    monkeypatch.setattr(audio, "MATCHES", 7)
    assert [v.tolist() for v in index.peaks(x)] == whole
    for q, offset, votes in zip(*whole):
        assert audio.align(np.frombuffer(block[q][1], "<u4"), x)[:2] == (offset, votes)


def test_wav_columns(spark, tmp_path):
    import io
    import wave

    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 440 * t)

    def wav(width, channels, rate=8000):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((channels, width, rate, 0, "NONE", ""))
            full = (x * (2 ** (8 * width - 1) - 1)).astype(np.int64) + (128 if width == 1 else 0)
            f.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) * channels for v in full))
        return out.getvalue()

    for width, most in ((1, 0.02), (2, 1e-4), (3, 1e-6), (4, 1e-7)):
        for channels in (1, 2):
            got, rate = audio.decoded(wav(width, channels))
            assert rate == 8000 and len(got) == len(x) and np.abs(got - x).max() < most
    data = x.astype("<f4").tobytes()
    head = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\3\0\1\0" + (8000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + b"\4\0\x20\0data" + len(data).to_bytes(4, "little")
    assert np.abs(audio.decoded(head + data)[0] - x).max() < 1e-6
    assert audio.decoded(b"") is None and audio.decoded(b"RIFFxxxxWAVE") is None and audio.decoded(head[:30]) is None
    assert len(audio.resampled(x, 8000, 4000)) == 4000 and len(audio.resampled(x, 2000, 4000)) == 16000
    rows = [(1, bytearray(wav(2, 1))), (2, None), (3, bytearray(b"no audio")), (4, bytearray(wav(2, 1)[:44]))]
    got = {r["rec_id"]: r["samples"] for r in audio.recordings(spark.createDataFrame(rows, "rec_id long, content binary")).collect()}
    assert len(got[1]) == 4000 and got[2] is None and got[3] is None and got[4] == []


def test_components(spark):
    import random

    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_queries_answer_every_row(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name in ("op3_simhash", "op5_licenses", "op7_surrogates", "op8_segmentation"):
        assert registry.queries()[name](spark, sf).select("doc_id").distinct().count() == n, name
    assert registry.queries()["op10_audio"](spark, sf).count() == vectors


def test_pipeline(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > 0.6 * sizes[0]
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Nulls, repeated rows, a long text, columns whose names the operators use themselves; and none at all."""
    own = ["row", "rest", "h", "id", "n", "one", "fp", "score", "_key", "_k", "_text", "row_key", "known", "spans", "kept_text", "new_text", "found", "a.b", "component", "part"]
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    words = " ".join(f"w{i}" for i in range(60))
    extra = [(None, "no id", "en", "s", 5), (900001, None, None, None, None), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "word " * 30_000, "en", "s", 150_000), (900004, words, "en", "s", 9), (900005, f"{words} end x@y.de", "en", "s", 9)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumns({c: F.lit(i) for i, c in enumerate(own)})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        last = name == "packing"
        none = stage(spark, empty, sf)
        assert none.count() == 0, name
        out = stage(spark, docs, sf)
        rows = out.collect()
        if last:
            assert {r["doc_id"] for r in rows} >= {None, 900001, 900002, 900003}
            continue
        assert out.columns == docs.columns and none.columns == docs.columns, name
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r)
            assert all(r[c] == i for i, c in enumerate(own)), name
        assert None in by and by[None][0]["text"] == "no id", name
        if name == "near_duplicates":
            assert len(by[900001]) == 1 and 900002 not in by and 900005 not in by and by[900004][0]["text"] == words
        elif name == "toxicity":
            assert len(by[900001]) == 2 and by[900003][0]["text"] == "word " * 30_000
        else:
            assert len(rows) == docs.count() and by[900001][0]["text"] is None and by[900002][0]["text"] == ""
            assert name != "pii" or "x@y.de" not in by[900005][0]["text"]
            assert name != "substrings" or (by[900003][0]["text"], by[900004][0]["text"], by[900005][0]["text"]) == ("", "", "end x@y.de")
