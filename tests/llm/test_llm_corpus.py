"""Whole-document packing, filter audit and conversation trie against plain versions."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import audit, bestfit, trie, wordids

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_are_those_of_the_library():
    enc = wordids.encoder(WORD_BPE)
    rng = np.random.default_rng(4)
    letters = list("abcdeS'sstremvld ..,!?12é漢ΣσIİJ̌́AÅßﬁ\x1c\x00\n <|>-—…жЖ  ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(4000)]
    texts += ["", "it's 'sound --'s ''s 're'll I'M", "<|endoftext|> a", "<|ENDOFTEXT|> a", "a" * 30000, "'" * 500, " " * 500, "x y " * 3000]
    want = [np.array(e.ids, np.uint32).tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert sum(enc._marked(x) is not None for x in texts) > 200


def plain_sum_of_squares(sizes, window):
    """Bins by trying every place and summing all squares."""
    bins = []
    for size in sizes:
        def total(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        gaps, ways = [window - sum(b) for b in bins], []
        for g in sorted({x for x in gaps if x >= size}):
            at = gaps.index(g)
            ways.append((total(gaps[:at] + [g - size] + gaps[at + 1 :]), g, at))
        ways.append((total([*gaps, window - size]), window + 1, None))
        at = min(ways)[2]
        if at is None:
            bins.append([size])
        else:
            bins[at].append(size)
    return sorted(sum(b) for b in bins)


def test_sum_of_squares_places_where_squares_are_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 21, 60).tolist()
        bins, full = bestfit.Bins(20), []
        for k, size in enumerate(sizes):
            got = bins.add(size, (0, 0, k, size, 0))
            full += [got] if got else []
        fills = sorted([sum(x[3] for x in b) for b in full] + [sum(x[3] for x in b) for some in bins.open for b in some])
        assert fills == plain_sum_of_squares(sizes, 20)
        before = sum(len(x) for x in bins.open)
        rest = bins.rest()
        assert len(rest) <= before and all(sum(x[3] for x in b) <= 20 for b in rest)
        assert sorted(x[2] for b in [*full, *rest] for x in b) == list(range(60))


def docs_of(spark, texts):
    rows = [(i, x, f"s{i % 3}", "clash", 7) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, sequence_id string, place long")


@pytest.mark.parametrize("per_task", [25, 10**6])
def test_whole_documents_round_trip(spark, per_task):
    rng = np.random.default_rng(8)
    texts = [" ".join(["word", "Überhaupt", "7", "x!"][k] for k in rng.integers(0, 4, n)) for n in rng.integers(0, 60, 120)]
    texts += [None, "", "a", "long " * 700, "x " * 31, "x " * 63]
    nameless = docs_of(spark, ["none"]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["again"] * 3)).unionByName(nameless)
    rows = [r.asDict() for r in bestfit.pack(docs.repartition(5), WORD_BPE, window=64, per_task=per_task).collect()]
    enc = wordids.encoder(WORD_BPE)
    want = {}
    for i, x in [*enumerate(texts), *enumerate(["again"] * 3), (None, "none")]:
        ids = enc.encode([x or ""])[0] + b"\0\0\0\0"
        for piece, start in enumerate(range(0, len(ids) // 4, 64)):
            some = ids[4 * start : 4 * start + 256]
            key = (i, piece, start, len(some) // 4, zlib.crc32(some))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in held.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    if per_task > 1000:
        assert len(held) <= -(-sum(r["length"] for r in rows) // 64) * 1.05 + 1


def test_packing_of_an_empty_table(spark):
    assert bestfit.pack(docs_of(spark, []), WORD_BPE).count() == 0


def plain_audit(docs, labels):
    least, good, toxic = {}, {}, {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i) or q == 1, toxic.get(i) or t == 1
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = []
        for i, text, p in docs:
            if (p or "") != part:
                continue
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            fails = {"A"} if len(words) < 200 else set()
            fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
            fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
            fails |= {"D"} if re.search("[#$%&*|]", text) else set()
            fails |= {"E"} if i is not None and i > least[text] else set()
            own.append((fails, i is not None and good.get(i, False), i is not None and toxic.get(i, False)))
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0]]
                gone = sum(f in x[0] for x in own) - len(here)
                left = [x for x in left if f not in x[0]]
                total[f] += len(here)
                out[part, order, step] = [len(left), len(here), gone, sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def test_audit_against_plain_version(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "Beta", "b", "c$", "d", "é", "\x1c", "X|Y"]
    texts = [None, "", "", " \t\n", "A", "é" * 300, "a\x1cb " * 150, "same " * 250, "C" * 5]
    for _ in range(60):
        n = int(rng.choice([3, 199, 200, 201, 400]))
        texts.append(" ".join(words[k] + (str(j) if rng.random() < 0.6 else "") for j, k in enumerate(rng.integers(0, rng.integers(2, 9), n))))
    texts += texts[5:30] * 2
    docs = [(int(rng.integers(0, 200)), x, [None, "", "a", "b"][int(rng.integers(0, 4))]) for x in texts] + [(None, texts[12], "a"), (3, texts[12], "b"), (3, texts[12], "b")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 150)] + [(3, None, None), (3, 1, 1), (None, 1, 1), (9, None, 0)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, part string, fails int").repartition(6)
    known = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, label string")
    want = plain_audit(docs, labels)
    for parts in (1024, 1):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(df, known, parts).collect()}
        assert got == want and len(got) == 600 * len({p or "" for _, _, p in docs})
    assert audit.audit(df.limit(0), known).count() == 0
    assert {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(df, known.limit(0)).collect()} == plain_audit(docs, [])


def test_first_failures_table():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (np.sort(table[31]) == 0).all()
    assert table[0b00101, audit.ORDERS.index("BCADE")] == 1


def plain_trie(rows):
    """(Every prefix of every rebuilt conversation in a dictionary.)"""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
            own.setdefault(c, []).append(((t is not None, t or 0, r.encode(), x[:16].encode(), digest), (r, x)))
    own = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def talks(rng, n, letters, longest):
    rows = []
    for c in rng.choice(np.arange(-250, 900), n, replace=False).tolist():
        for t in range(int(rng.integers(1, longest))):
            rows.append((c, t, ["user", "system", None][int(rng.integers(0, 3)) if t % 5 == 4 else 0], letters[int(rng.integers(0, len(letters)))]))
    return rows


def trie_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, depth string, a int").repartition(7)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **options).collect()), key=lambda r: r[:2])


@pytest.fixture
def torn(spark):
    """Many partitions, none put together again: conversations, segments, nodes and groups are cut."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, letters, longest, segment", [(1, ["a"], 40, 3), (2, ["a", "bé"], 9, 64), (3, ["a", "b", None], 30, 4), (4, ["x"] * 9 + ["y"], 70, 5)])
def test_trie_in_torn_partitions(torn, seed, letters, longest, segment):
    rng = np.random.default_rng(seed)
    rows = talks(rng, 120, letters, longest)
    rows += [(c, t, "user", "same") for c in range(1000, 1150) for t in range(3)] + [(1200, t, "u", "long" * (t % 7)) for t in range(400)]
    assert trie_of(torn, rows, segment=segment, block=7) == plain_trie(rows)


def test_trie_edges(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []
    odd = [(7, None, None, None), (7, None, "b", ""), (7, 3, "a", "é\U0001f600"), (7, 3, "a", "é\U0001f600"), (7, 3, "a", "z" * 20 + "1"), (7, 3, "a", "z" * 20 + "2")]
    rows = odd + [(100, None, "a", "q" * 50_000), (101, 5, "a", "q")] + [(c, 0, "", "") for c in (-1, -100, -150)] + [(None, 0, "a", "b")] + [(300, t, "u", "t") for t in range(65)]
    assert trie_of(spark, rows) == plain_trie(rows)
    # A conversation whose base is absent and which has no turn beyond its first h: only the root has it.
    c = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie_of(spark, [(c, 0, "u", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
