"""Removal of long passages that repeat anywhere in the corpus, on a compacted de Bruijn graph.

Edges of the graph are token k-mers, the windows of ``window`` consecutive words; nodes are the
(window - 1)-mers between them. Only edges that occur twice or more are of interest. They are found
in two joins: windows that share a minimiser (the least hash of the shorter k-mers inside) meet
under it first, and only those under a repeated minimiser are joined as edges. Then the degrees of
the nodes are counted: where all occurrences of a node come from one repeated edge and go on to one,
the path does not branch and compacts. What is left of a document's repeated edges are a few
compacted paths with source coordinates; the words there are digested and compared before anything
is removed, so that equal hashes alone remove nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import discarded, materialised, scratch, written

WINDOW = 35
#: Words of the k-mers that compete to be a window's anchor.
ANCHOR = 12
#: Words hashed at a time; longer documents are read in overlapping blocks of this many.
BLOCK = 1 << 17
#: Keys that a task gathers before it deals them out.
FLUSH = 1 << 21
#: Digests up to which they are broadcast, 1 MB of them.
BROADCAST = 1 << 16
#: Binary logarithm of the most bits of the filter of branching nodes that tasks are sent.
FILTER = 28
#: Bytes of the digest by which the words of two paths are compared.
DIGEST = 16

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int):
    if base not in _POWERS:
        n = BLOCK + 64
        _POWERS[base] = tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, x, _U))]) for x in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base]


def _rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes, the same wherever a run stands."""
    up, down = _powers(base)
    total = np.concatenate([[_U(0)], np.cumsum(words * up[: len(words)])])
    x = (total[size:] - total[:-size]) * down[: len(words) - size + 1]
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``size`` neighbours."""
    out, have = x, 1
    while 2 * have <= size:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = size - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _blocks(text: bytes, window: int):
    """(first word, word hashes) of overlapping blocks; every window lies in exactly one."""
    words = text.split()
    if len(words) < window:
        return
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(w, 1) for w in words), _U, len(words))
    step = BLOCK - window + 1
    for at in range(0, len(words) - window + 1, step):
        yield at, hashes[at : at + BLOCK]


def _anchored(words: np.ndarray, window: int, anchor: int):
    """(anchor k-mer of each window, k-mers that are the anchor of some window, as hashes)."""
    kmers = _rolled(words, anchor, _BASES[0])
    span = window - anchor + 1
    least = _sliding(kmers, span, np.minimum)
    around = np.concatenate([np.zeros(span - 1, _U), least, np.zeros(span - 1, _U)])
    return least, kmers[kmers == _sliding(around, span, np.maximum)]


def _windows(words: np.ndarray, window: int) -> np.ndarray:
    return _rolled(words, window, _BASES[1])


def _nodes(words: np.ndarray, window: int) -> np.ndarray:
    return _rolled(words, window - 1, _BASES[2])


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of an int, by which it deals rows to partitions."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def part_names(n: int) -> np.ndarray:
    """For each of n partitions an int that Spark deals to it, so that parts and tasks are the same."""
    names = np.full(n, -1)
    at = 0
    while (names < 0).any():
        some = np.arange(at, at + 8 * n)
        to = np.mod(_murmur(some).astype(np.int64), n)
        names[to[::-1]] = np.where(names[to[::-1]] < 0, some[::-1], names[to[::-1]])
        at += 8 * n
    return names


def _batch(kind: int, part: np.ndarray, keys: np.ndarray, rows: np.ndarray, twice: np.ndarray):
    """Entries as one row of packed arrays for each part. kind: 0 for answers, 1 for questions."""
    order = np.argsort(part, kind="stable") if kind else np.lexsort((rows, part))
    part, keys, rows = part[order], keys[order], rows[order]
    twice = twice[order] if kind else np.zeros(0, bool)
    cut = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0] if len(part) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(part))
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for x in (keys, rows, twice)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind, np.int32)), pa.array(part[cut].astype(np.int32)), *packed], names=_NAMES)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)


_NAMES = ["kind", "part", "keys", "rows", "twice"]
_DEALT = "kind int, part int, keys binary, rows binary, twice binary"


class _Dealer:
    """Gathers keys of rows and deals them to parts by key, one row of packed arrays for each part.

    A key met twice by this task is known to repeat: its rows here are answered at once, and one
    flagged entry tells the others. So a reducer gets a key once from each task at most.
    """

    def __init__(self, parts: np.ndarray):
        self.parts, self.keys, self.rows, self.twice, self.size = parts, [], [], [], 0

    def add(self, row: int, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.rows.append(np.full(len(keys), row, np.int64))
        self.twice.append(n > 1)
        self.size += len(keys)

    def deal(self):
        if not self.size:
            return
        keys, rows, twice = (np.concatenate(x) for x in (self.keys, self.rows, self.twice))
        self.keys, self.rows, self.twice, self.size = [], [], [], 0
        order = np.argsort(keys, kind="stable")
        keys, rows, twice = keys[order], rows[order], twice[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(new) - 1
        known = ((np.bincount(group) > 1) | (np.bincount(group, twice) > 0))[group]
        yield _answers(self.parts, rows[known], keys[known])
        yield _batch(1, _part(self.parts, keys[new]), keys[new], rows[new], known[new])


def _part(parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return parts[(_mixed(keys) % _U(len(parts))).astype(np.int64)]


def _answers(parts: np.ndarray, rows: np.ndarray, keys: np.ndarray):
    """Repeated keys, dealt by the row that has them."""
    return _batch(0, _part(parts, rows), keys, rows, None)


def _anchor_keys(window, anchor, parts):
    def run(batches):
        dealer = _Dealer(parts)
        for b in batches:
            for row, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist()):
                got = [_anchored(w, window, anchor)[1] for _, w in _blocks((text or "").encode("utf-8", "surrogatepass"), window)]
                if got:
                    dealer.add(row, np.concatenate(got))
                if dealer.size > FLUSH:
                    yield from dealer.deal()
        yield from dealer.deal()

    return run


def _edge_keys(window, anchor, parts):
    def run(batches):
        dealer = _Dealer(parts)
        for b in batches:
            for row, text, known in zip(*(b.column(x).to_pylist() for x in ("row_key", "text", "known"))):
                repeated = np.frombuffer(known, _U)
                got = []
                for _, w in _blocks((text or "").encode("utf-8", "surrogatepass"), window):
                    got.append(_windows(w, window)[np.isin(_anchored(w, window, anchor)[0], repeated)])
                if got:
                    dealer.add(row, np.concatenate(got))
                if dealer.size > FLUSH:
                    yield from dealer.deal()
        yield from dealer.deal()

    return run


def _by_part(batches, kind):
    """(part, keys, rows, twice) of the entries of a kind; rows of the input come sorted by part."""
    held, part = [], None
    for b in batches:
        for k, p, *x in zip(*(b.column(i).to_pylist() for i in range(5))):
            if k != kind:
                continue
            if p != part and held:
                yield part, *(np.concatenate([np.frombuffer(y[i], t) for y in held]) for i, t in enumerate((_U, np.int64, bool)))
                held = []
            part = p
            held.append(x)
    if held:
        yield part, *(np.concatenate([np.frombuffer(y[i], t) for y in held]) for i, t in enumerate((_U, np.int64, bool)))


def _resolved(parts):
    """Answers to the questions of each part: the keys that several entries have or one is flagged
    to repeat. Answers among the input pass."""

    def run(batches):
        passed, source = [], iter(batches)
        found_rows, found_keys, size = [], [], 0

        def questions():
            for b in source:
                kinds = np.asarray(b.column(0))
                if (kinds == 0).any():
                    passed.append(b.filter(pa.array(kinds == 0)))
                yield b

        for _, keys, rows, twice in _by_part(questions(), 1):
            while passed:
                yield passed.pop()
            order = np.argsort(keys, kind="stable")
            keys, rows, twice = keys[order], rows[order], twice[order]
            group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
            again = (np.bincount(group) > 1) | (np.bincount(group, twice) > 0)
            fine = again[group] & ~twice  # flagged entries were answered where they came from
            found_rows.append(rows[fine])
            found_keys.append(keys[fine])
            size += int(fine.sum())
            if size > FLUSH:
                yield _answers(parts, np.concatenate(found_rows), np.concatenate(found_keys))
                found_rows, found_keys, size = [], [], 0
        if size:
            yield _answers(parts, np.concatenate(found_rows), np.concatenate(found_keys))
        while passed:
            yield passed.pop()

    return run


def _gathered(batches):
    """One row for each row_key: all its repeated keys."""
    for _, keys, rows, _ in _by_part(batches, 0):
        order = np.argsort(rows, kind="stable")
        rows, keys = rows[order], keys[order]
        cut = np.nonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))[0]
        for at in range(0, len(cut), 5000):
            some = cut[at : at + 5000]
            ends = np.append(cut[at + 1 : at + 5000], cut[at + 5000] if at + 5000 < len(cut) else len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array([keys[a:b].tobytes() for a, b in zip(some, ends)], pa.binary())], names=["row_key", "known"])


def _repeated(dealt: DataFrame, parts: np.ndarray) -> DataFrame:
    """(row_key, known): for each row the packed keys that occur more than once anywhere."""
    asked = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_resolved(parts), _DEALT)
    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(_gathered, "row_key long, known binary")


def _hits(raw: bytes, n: int, known: bytes, window: int):
    """(whether each of the n - window + 1 windows is a repeated edge, its hash, the hash of the node
    at each word, the node after the last window included)."""
    repeated = np.frombuffer(known, _U)
    hit, edge, node = np.zeros(n - window + 1, bool), np.zeros(n - window + 1, _U), np.zeros(n - window + 2, _U)
    for at, w in _blocks(raw, window):
        edges = _windows(w, window)
        hit[at : at + len(edges)] = np.isin(edges, repeated)
        edge[at : at + len(edges)] = edges
        node[at : at + len(edges) + 1] = _nodes(w, window)
    return hit, edge, node


def _ways(hit: np.ndarray, edge: np.ndarray):
    """At each node on a repeated edge: its place, and one hash of the edges it is come by and left by."""
    none = np.zeros(1, _U)
    into, out = np.concatenate([none, np.where(hit, edge, _U(0))]), np.concatenate([np.where(hit, edge, _U(0)), none])
    at = np.nonzero((into != 0) | (out != 0))[0]
    way = (into[at] * _U(_BASES[0])) ^ ((out[at] + _U(1)) * _U(_BASES[1]))
    return at, way ^ (way >> _U(29))


_WAYS = "part int, nodes binary, ways binary"


def _node_ways(window, parts):
    """The distinct (node, way) of a task, dealt to parts by node: one row of packed arrays for each."""

    def dealt(nodes, ways):
        nodes, ways = np.concatenate(nodes), np.concatenate(ways)
        part = _part(parts, nodes)
        order = np.lexsort((ways, nodes, part))
        nodes, ways, part = nodes[order], ways[order], part[order]
        new = np.ones(len(nodes), bool)
        new[1:] = (nodes[1:] != nodes[:-1]) | (ways[1:] != ways[:-1])
        nodes, ways, part = nodes[new], ways[new], part[new]
        cut = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0] if len(part) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(part))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()) for x in (nodes, ways)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *packed], names=["part", "nodes", "ways"])

    def run(batches):
        nodes, ways, size = [np.zeros(0, _U)], [np.zeros(0, np.uint32)], 0
        for b in batches:
            for text, known in zip(*(b.column(x).to_pylist() for x in ("text", "known"))):
                raw = text.encode("utf-8", "surrogatepass")
                hit, edge, node = _hits(raw, len(raw.split()), known, window)
                place, way = _ways(hit, edge)
                nodes.append(node[place])
                ways.append((way >> _U(32)).astype(np.uint32))
                size += len(place)
                if size > FLUSH:
                    yield dealt(nodes, ways)
                    nodes, ways, size = [np.zeros(0, _U)], [np.zeros(0, np.uint32)], 0
        yield dealt(nodes, ways)

    return run


def _branching(batches):
    """The nodes of each part that have more than one way; rows come sorted by part."""

    def of(held):
        nodes, ways = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((0, _U), (1, np.uint32)))
        order = np.lexsort((ways, nodes))
        nodes, ways = nodes[order], ways[order]
        return np.unique(nodes[1:][(nodes[1:] == nodes[:-1]) & (ways[1:] != ways[:-1])])

    held, part = [], None
    for b in batches:
        for p, *x in zip(*(b.column(i).to_pylist() for i in range(3))):
            if p != part and held:
                yield pa.RecordBatch.from_arrays([pa.array(of(held).view(np.int64))], names=["node"])
                held = []
            part = p
            held.append(x)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(of(held).view(np.int64))], names=["node"])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:DIGEST]


def node_filter(branching: DataFrame) -> np.ndarray:
    """Bits of the nodes (column node), by their last bits: 16 or more for each node as long as that is
    within 1 << FILTER. A node without a bit does not branch; where a bit is set for another node,
    paths are cut without need, but in all rows alike. The size is bounded, whatever the input is."""
    bits = 1 << min(FILTER, max(12, int(branching.count()).bit_length() + 4))
    slot = branching.select(F.col("node").bitwiseAND(bits - 1).alias("slot"))
    words = slot.selectExpr("cast(slot div 64 as int) as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(_U)


def _compacted(window, sent):
    """The paths of each row: maximal runs of repeated edges without a branching node inside."""

    def run(batches):
        bits = sent.value
        for b in batches:
            out = []
            for row, text, known in zip(*(b.column(x).to_pylist() for x in ("row_key", "text", "known"))):
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                hit, _, node = _hits(raw, len(words), known, window)
                slot = node[: len(hit)] & _U(64 * len(bits) - 1)
                cut = (bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)) & _U(1)) > 0
                begins = hit & (cut | ~np.concatenate([[False], hit[:-1]]))
                ends = np.nonzero(hit & np.concatenate([begins[1:] | ~hit[1:], [True]]))[0]
                for i, j in zip(np.nonzero(begins)[0].tolist(), ends.tolist()):
                    out.append((row, i, j - i + window, _digest(words[i : j + window])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["row_key", "start", "n", "digest"])

    return run


def _kept(batches):
    for b in batches:
        texts, counts, removed, digests = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = 0
            if spans:
                keep = np.ones(len(words), bool)
                for x in spans:
                    # The words at the coordinates are those that were compared.
                    if keep[x["start"] : x["start"] + x["n"]].any() and _digest(words[x["start"] : x["start"] + x["n"]]) == x["digest"]:
                        keep[x["start"] : x["start"] + x["n"]] = False
                gone = int(len(words) - keep.sum())
            if gone:
                words = [w for w, k in zip(words, keep.tolist()) if k]
            joined = b" ".join(words)
            texts.append(joined.decode("utf-8", "surrogatepass") if gone else text)
            counts.append(len(words) + gone)
            removed.append(gone)
            digests.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["row", "kept_text", "n_words", "n_removed", "kept_sha256"],
        )


def _on_edges(texts: DataFrame, window: int, anchor: int, parts: np.ndarray) -> DataFrame:
    """(row_key, text, known) of the rows with repeated edges; known: their hashes, packed. All three
    joins with the texts read one exchange."""
    anchors = _repeated(texts.mapInArrow(_anchor_keys(window, anchor, parts), _DEALT), parts)
    hung = texts.join(anchors, "row_key").select("row_key", "text", "known")
    return texts.join(_repeated(hung.mapInArrow(_edge_keys(window, anchor, parts), _DEALT), parts), "row_key")


def paths(on: DataFrame, window: int, parts: np.ndarray) -> DataFrame:
    """(row_key, start, n, digest): the compacted paths of rows (row_key, text, known), in words from 0.

    A node branches if its occurrences on repeated edges differ in the edge they come by or the edge
    they leave by; the end of a repeated stretch counts as a difference. Ways are compared by 32 bits of
    their hash, so one branching node in 4 billion is missed. Ways are combined in each
    task, so a passage that very many documents share is one entry of each. Where paths are cut
    reaches the tasks as a filter of bounded size; see node_filter.
    """
    dealt = on.mapInArrow(_node_ways(window, parts), _WAYS).repartition("part").sortWithinPartitions("part")
    sent = on.sparkSession.sparkContext.broadcast(node_filter(materialised(dealt.mapInArrow(_branching, "node long"))))
    return on.mapInArrow(_compacted(window, sent), "row_key long, start long, n long, digest binary")


def verified_spans(on: DataFrame, window: int, parts: np.ndarray) -> DataFrame:
    """(row_key, spans): the paths of each row whose words stand at other coordinates too."""
    found = materialised(paths(on, window, parts))
    # Kept apart from the join, so that a digest with very many paths can be split there.
    again = materialised(found.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest"))
    again = F.broadcast(again) if again.count() <= BROADCAST else again
    return found.join(again, "digest").groupBy("row_key").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Marks and removes the words of ``docs`` (doc_id, text, and any others) that lie in a repeated window.

    Words are runs of characters other than blank and \\x09-\\x0D, unchanged. A window of
    ``window`` words repeats if the same words start anywhere else, in the same document or in
    another row. Result: (row, kept_text, n_words, n_removed, kept_sha256), ``row`` being the
    untouched input row as a struct, so that no column name can clash; kept_text is the text
    itself where nothing is removed, else the kept words joined by one blank, and kept_sha256 the
    digest of the kept words joined so. A null text has no words and stays null; texts of any length
    are read whole, in overlapping blocks. A repeated row repeats all its windows. An empty table
    gives an empty result.

    Edges are found by 64-bit hashes; a path is removed only where the words of another occurrence
    have the same SHA-256 (its first DIGEST bytes). The keys of a task are combined before they are
    dealt, so a passage that very many documents share reaches a reducer once for each task.
    """
    spark = docs.sparkSession
    parts = part_names(int(spark.conf.get("spark.sql.shuffle.partitions")))
    row_key = F.xxhash64(F.col("doc_id"), F.col("text"))
    texts = docs.select(row_key.alias("row_key"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    base = scratch(spark, "substrings")
    on = written(_on_edges(texts.select("row_key", "text"), window, anchor, parts), base)
    spans = materialised(verified_spans(on, window, parts))
    discarded(spark, base)
    kind = T.StructType([
        T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name != "text"])), T.StructField("kept_text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ])
    return texts.join(spans, "row_key", "left").select(F.col("rest").alias("row"), "text", "spans").mapInArrow(_kept, kind)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in repeated windows of 35 words, removed."""
    from lodestone.llm.common import spread, table

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM starts),
rep AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM rep)),
cov AS (SELECT DISTINCT doc_id, i + o AS p FROM hit, range(0, 35) AS t(o)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
