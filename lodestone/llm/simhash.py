"""SimHash fingerprints linked within a Hamming radius by BK-trees over fingerprint shards."""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import _tidy, components, materialised, spread, table

SEED = 42
#: Members of a shard tree; what is done about larger shards is said in ``links`` and ``alike``.
TREE = 2048
#: Rows of whole shards that a task holds at a time, and (probe, node) pairs of a search.
SLAB, PAIRS = 1 << 15, 1 << 20
#: A side is broadcast if it has at most so many rows of two longs.
BROADCAST = 1 << 16

# Near duplicates of whole texts: words of 64 bits of the wide fingerprint, the radius in bits, the
# bits at which pairs of similarity 0.8 differ on average, the share of such pairs that no table may
# bring together, and the least number of tables.
WIDE, WIDE_RADIUS, WIDE_MEAN, MISSED, LEAST_TABLES = 4, 64, 40, 0.01, 24
#: Members of an oversized shard that the others are measured against, in expectation, and how often
#: new ones are taken from those that no pivot was near to.
PIVOTS, PEELS = 256, 4
#: Distinct shingles of a piece of a component that failed pairs leave open, and of the members that ask it at a time.
PIECE, ASKING = 1 << 21, 1 << 19
#: Up to so many partners of a member are compared one by one, more by counting along the postings of its shingles.
FEW = 32

_LANES = np.uint64(0x0101010101010101)
_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:, None]


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included: A-Z lower-cased, words cut at ASCII white
    space, shingles of ``words`` words (all words if fewer, none without a word)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([h(b" ".join(found), SEED)] if found else [], np.uint64)
    return np.array([h(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(words)))], np.uint64)


def _majority(a: np.ndarray) -> np.ndarray:
    """One word for each row of hashes: the bits that are set in over half of them."""
    n = a.shape[1]
    if not n:
        return np.zeros(len(a), np.uint64)
    cuts = np.arange(0, n, 255)
    counts = np.zeros((len(a), 64), np.int64)
    for shift in range(8):  # eight one-byte counters in each word, emptied every 255 hashes
        lanes = np.add.reduceat((a >> np.uint64(shift)) & _LANES, cuts, axis=1)
        counts[:, shift::8] = lanes.view(np.uint8).reshape(len(a), -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text; a text without words has fingerprint 0."""
    return int(_majority(_hashes(text, words)[None, :])[0])


def wide_fingerprint(distinct: np.ndarray) -> np.ndarray:
    """SimHash of WIDE words of a set of shingle hashes, each mixed anew for every word."""
    x = distinct[None, :] * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return _majority(x ^ (x >> np.uint64(29)))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


class BKTrees:
    """A BK-tree for each group of fingerprints, as arrays: children of a node are keyed by their
    Hamming distance to it. All trees are grown, and searched, a level at a time.

    ``values`` is (members, words), ``group`` the group of each member. A member that equals a
    node is not inserted; ``same`` has it and that node.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray, groups: int):
        n, far = len(values), 64 * values.shape[1] + 1
        self.values, self.edge = values, np.zeros(n, np.int64)
        self.root = np.full(groups, -1)
        parent, same = np.full(n, -1), []
        self.root[group[::-1]] = np.arange(n)[::-1]
        todo = np.nonzero(self.root[group] != np.arange(n))[0]
        at = self.root[group[todo]]
        while len(todo):
            d = _distance(values[todo], values[at])
            if (equal := d == 0).any():
                same.append((todo[equal], at[equal]))
                todo, at, d = todo[~equal], at[~equal], d[~equal]
            order = np.argsort(at * far + d, kind="stable")
            todo, at, d = todo[order], at[order], d[order]
            new = np.ones(len(todo), bool)
            new[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
            child = todo[new]
            parent[child], self.edge[child] = at[new], d[new]
            at, todo = child[np.cumsum(new) - 1][~new], todo[~new]
        self.same = tuple(np.concatenate([np.zeros(0, np.int64), *(s[i] for s in same)]) for i in (0, 1))
        born = np.nonzero(parent >= 0)[0]
        self.children = born[np.argsort(parent[born], kind="stable")]
        self.count = np.bincount(parent[born], minlength=n)
        self.begin = np.cumsum(self.count) - self.count

    def within(self, probes: np.ndarray, group: np.ndarray, radius: int):
        """(probe, node, distance) of all pairs of a group at ``radius`` or fewer bits: from a node
        only edges within the radius of the measured distance are followed."""
        found = [(np.zeros(0, np.int64),) * 3]
        probe = np.nonzero(self.root[group] >= 0)[0]
        node = self.root[group[probe]]
        while len(probe):
            d = _distance(probes[probe], self.values[node])
            hit = d <= radius
            found.append((probe[hit], node[hit], d[hit]))
            n = self.count[node]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            probe, node, d = np.repeat(probe, n), self.children[np.repeat(self.begin[node], n) + nth], np.repeat(d, n)
            go = np.abs(self.edge[node] - d) <= radius
            probe, node = probe[go], node[go]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is connected with by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a minimum spanning forest by d: at every distance it connects
    what all links up to that distance connect."""
    order = np.argsort(d, kind="stable")
    a, b = a[order], b[order]
    label, live, keep = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return order[np.sort(np.concatenate(keep))]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        pick = np.unique(best[best < len(a)])
        keep.append(pick)
        label = _labels(n, label[a[pick]], label[b[pick]])[label]


def _tree_links(group, values, in_tree, asks, radius):
    """(row, row, distance) of the links between rows that ask and rows in the tree of a group."""
    trees, askers = np.nonzero(in_tree)[0], np.nonzero(asks)[0]
    grown = BKTrees(values[trees], group[trees], int(group[-1]) + 1 if len(group) else 0)
    found = [(trees[grown.same[0]], trees[grown.same[1]], np.zeros(len(grown.same[0]), np.int64))]
    sizes = np.bincount(group[trees], minlength=int(group[-1]) + 1 if len(group) else 0)[group[askers]]
    part = np.cumsum(sizes) // PAIRS
    for p in np.unique(part):
        some = askers[part == p]
        probe, node, d = grown.within(values[some], group[some], radius)
        probe, node = some[probe], trees[node]
        once = (probe < node) | ((probe != node) & ~(asks[node] & in_tree[probe]))
        found.append((probe[once], node[once], d[once]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _arrays(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _slabs(batches, names):
    """Columns of a sorted input as arrays, whole groups (of the first column) at a time."""
    held, size = [], 0
    for b in batches:
        held.append(_arrays(b, names))
        size += b.num_rows
        if size >= SLAB:
            all_of = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(all_of[0], all_of[0][-1]))
            if cut:
                yield [c[:cut] for c in all_of]
            held, size = [[c[cut:] for c in all_of]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))


def _words(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _row_kind(n: int) -> str:
    return "id long, " + ", ".join(f"{w} long" for w in _words(n))


def _edges(ids, a, b, d) -> pa.RecordBatch:
    x, y = ids[a], ids[b]
    real = x != y
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[real]), pa.array(np.maximum(x, y)[real])], names=["a", "b"])


def _linked(n_words: int, radius: int):
    """Rows (g, role, id, words) sorted by g: role 1 is in the tree of its group, 2 asks, 3 both."""

    def run(batches):
        for g, role, ids, *w in _slabs(batches, ["g", "role", "id", *_words(n_words)]):
            group, values = _numbered(g), np.stack(w, axis=1).view(np.uint64)
            a, b, d = _tree_links(group, values, (role & 1) > 0, (role & 2) > 0, radius)
            some = spanning_forest(len(ids), a, b, d)
            yield _edges(ids, a[some], b[some], d[some])

    return run


def _in_trees(rows: DataFrame, n_words: int, radius: int) -> DataFrame:
    dealt = rows.select("g", "role", "id", *_words(n_words)).repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(_linked(n_words, radius), "a long, b long")


def _keyed(masks: list[list[int]], n_words: int, below: int = 0):
    """Rows (g, t, id, words) for each mask t of a row, or for those under its present mask t, which
    are ``below`` in number: g is a hash of t and the masked words."""
    table = np.array(masks, np.uint64).reshape(len(masks), n_words)

    def run(batches):
        for b in batches:
            ids, *w = _arrays(b, ["id", *_words(n_words)])
            values, n = np.stack(w, axis=1).view(np.uint64), below or len(masks)
            t = np.tile(np.arange(n), len(ids))
            if below:
                t += np.repeat(_arrays(b, ["t"])[0].astype(np.int64) * below, n)
            row = np.repeat(np.arange(len(ids)), n)
            g = t.astype(np.uint64)
            for i in range(n_words):
                g = (g ^ (values[row, i] & table[t, i])) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(t.astype(np.int32)), *(pa.array(x[row]) for x in (ids, *w))], names=["g", "t", "id", *_words(n_words)]
            )

    return run


def _dealt(rows: DataFrame, masks: list[list[int]], n_words: int, below: int = 0) -> DataFrame:
    return rows.mapInArrow(_keyed(masks, n_words, below), f"g long, t int, {_row_kind(n_words)}")


def _oversized(keyed: DataFrame, tree: int) -> DataFrame | None:
    """(g, n) of the shards with more than ``tree`` members, or None."""
    big = materialised(keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree))
    n = big.count()
    return (F.broadcast(big) if n <= BROADCAST else big) if n else None


def block_masks(blocks: int, agree: int, under: list[int] | None = None) -> list[int]:
    """Masks of every choice of ``agree`` of ``blocks`` equal parts of 64 bits; below given masks, of
    the bits that are not in them. Two fingerprints that differ in at most blocks - agree bits
    agree under one of the masks, and below it under one again."""
    out = []
    for mask in under or [0]:
        free = [i for i in range(64) if not mask >> i & 1]
        cuts = [round(len(free) * i / blocks) for i in range(blocks + 1)]
        parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
        out += [mask | sum(c) for c in combinations(parts, agree)]
    return out


def links(fps: DataFrame, radius: int = 2, blocks: int = 4, tree: int = TREE) -> DataFrame:
    """Edges (a, b) that connect all pairs of distinct fingerprints (column fp) within the radius.

    Fingerprints are dealt to shards by each choice of blocks - radius of their ``blocks``, on
    which a pair within the radius agrees at least once. A shard of more than ``tree`` members
    is dealt anew by the bits that its members need not share, until it is small: so neither a
    popular block nor a group of copies is gathered in one task, and rows grow by a constant
    factor at most. The tree of a shard travels with the shuffle to its probes. A tree's part of
    the answer is a spanning forest of true links, so there are fewer edges than members.
    """
    masks = block_masks(blocks, blocks - radius)
    each = len(masks)
    keyed = _dealt(fps.select(F.col("fp").alias("id"), F.col("fp").alias("w0")), [[m] for m in masks], 1)
    found = None
    while True:
        big = _oversized(keyed, tree) if min(64 - m.bit_count() for m in masks) >= blocks else None
        fit = keyed if big is None else keyed.join(big, "g", "left_anti")
        part = _in_trees(fit.withColumn("role", F.lit(3)), 1, radius)
        found = part if found is None else found.unionAll(part)
        if big is None:
            return found.distinct()
        masks = block_masks(blocks, blocks - radius, masks)
        keyed = _dealt(keyed.join(big, "g", "left_semi"), [[m] for m in masks], 1, each)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, tree: int = TREE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows link at ``radius`` or fewer differing fingerprint bits, directly or through others;
    component_id is the smallest doc_id of the linked rows. Texts of any length are read whole. Null
    and empty texts have fingerprint 0 and link like any other; rows without a doc_id link but do
    not name a component; repeated rows appear as often as they are there; an empty table gives an
    empty result.
    """
    marked = materialised(fingerprints(docs, words))
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(groups.select("fp"), radius, blocks, tree))
    labelled = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _fingerprints(words):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def wide_tables(n: int) -> list[list[int]]:
    """Masks for n wide fingerprints: as many bits as leave a few hundred unlike members in a shard, in
    as many tables as bring all but MISSED of the pairs together that differ in WIDE_MEAN bits. The
    bits of neighbouring tables are disjoint, being cut from random orders of all bits."""
    total = 64 * WIDE
    bits = min(48, max(6, math.ceil(math.log2(max(2, n))) - 8))
    meet = math.prod((total - WIDE_MEAN - i) / (total - i) for i in range(bits))
    deal, out = np.random.default_rng(SEED), []
    for i in range(max(LEAST_TABLES, math.ceil(math.log(MISSED) / math.log(1 - meet)))):
        at = i % (total // bits)
        order = deal.permutation(total) if at == 0 else order
        mask = [0] * WIDE
        for bit in order[at * bits : (at + 1) * bits].tolist():
            mask[bit // 64] |= 1 << bit % 64
        out.append(mask)
    return out


def _around(near: int):
    """Rows (g, shard, role, id, words) sorted by g: pivots of a shard (role 1) and a piece of its
    members (role 2). Gives the members again (b null), ``core`` if they are within ``near`` bits of a
    pivot; and edges, from those to the nearest pivot and along a spanning forest of the pivots."""
    names = ["g", "shard", "role", "id", *_words(WIDE)]
    out = ["shard", "a", "b", "core", *_words(WIDE)]

    def run(batches):
        for g, shard, role, ids, *w in _slabs(batches, names):
            group, values = _numbered(g), np.stack(w, axis=1).view(np.uint64)
            pivot = role == 1
            a, b, d = _tree_links(group, values, pivot, pivot, WIDE_RADIUS)
            some = spanning_forest(len(ids), a, b, d)
            x, y, e = _tree_links(group, values, pivot, ~pivot, near)
            asks, to = np.where(pivot[x], y, x), np.where(pivot[x], x, y)
            order = np.lexsort((ids[to], e, asks))
            asks, to = asks[order], to[order]
            one = np.concatenate([[True], asks[1:] != asks[:-1]]) if len(asks) else np.zeros(0, bool)
            best = np.full(len(ids), -1)
            best[asks[one]] = to[one]
            members = np.nonzero(~pivot)[0]
            core = best[members] >= 0
            target = pa.array(np.where(core, ids[best[members]], 0), mask=~core)
            yield pa.RecordBatch.from_arrays([pa.array(shard[members]), pa.array(ids[members]), target, pa.array(core), *(pa.array(c[members]) for c in w)], names=out)
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(ids[a[some]]), pa.array(ids[b[some]]), pa.array(np.ones(n, bool)), *(pa.nulls(n, pa.int64()) for _ in w)], names=out)

    return run


def _piece(key, n, salt: int):
    return F.pmod(F.xxhash64("id", key, F.lit(salt)), n)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _rest_links(of: DataFrame, rest: DataFrame, tree: int) -> DataFrame:
    """Edges between ``rest`` (g, id, words) and all members ``of`` (g, n, id, words) of their shards: the
    rest, in trees of ``tree``, is asked by every piece of the members. Rows grow as the product of both
    only where a shard has more than ``tree`` in the rest."""
    chunks = rest.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("chunks"))
    sizes = of.select("g", F.ceil(F.col("n") / tree).cast("int").alias("pieces")).distinct().join(chunks, "g")
    words = _words(WIDE)
    mine = rest.join(sizes, "g").withColumn("c", _piece(F.col("g"), F.col("chunks"), 3).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    all_of = of.select("g", "id", *words).join(sizes, "g").withColumn("p", _piece(F.col("g"), F.col("pieces"), 2).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = lambda x, role: x.select(F.xxhash64("g", "p", "c").alias("g"), F.lit(role).alias("role"), "id", *words)
    return _in_trees(side(mine, 1).unionAll(side(all_of, 2)), WIDE, WIDE_RADIUS)


def _oversized_links(of: DataFrame, tree: int) -> DataFrame:
    """Edges in shards of more than ``tree`` members ``of`` (g, n, id, words), which are groups of near copies.

    All members of a shard are measured against its pivots, a random sample: each gets an edge to the
    nearest one and need not meet the others. From those that have none near new pivots are taken, for
    all members again, until few are left; these meet every member. A round makes a row for each
    member and PIVOTS rows for ``tree`` members.
    """
    words = _words(WIDE)
    rest, found = of, None
    kind = "shard long, a long, b long, core boolean, " + ", ".join(f"{w} long" for w in words)
    for peel in range(PEELS):
        left = rest.groupBy("g").agg(F.count(F.lit(1)).alias("left"))
        # The members of shards of which few are left have met their pivots already.
        large = materialised(left.where(F.col("left") > tree))
        if large.isEmpty():
            break
        pivots = rest.join(large, "g").where(_piece(F.col("g"), F.ceil(F.col("left") / PIVOTS), 11 + peel) == 0).select("g", F.ceil(F.col("n") / tree).cast("int").alias("pieces"), "id", *words)
        pivots = pivots.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("role", F.lit(1))
        members = of.join(large, "g", "left_semi").withColumn("p", _piece(F.col("g"), F.ceil(F.col("n") / tree), 2).cast("int")).withColumn("role", F.lit(2))
        side = lambda x: x.select(F.xxhash64("g", "p").alias("piece"), F.col("g").alias("shard"), "role", "id", *words)
        dealt = side(pivots).unionByName(side(members)).withColumnRenamed("piece", "g").repartition("g").sortWithinPartitions("g")
        told = materialised(dealt.mapInArrow(_around(WIDE_MEAN), kind))
        straight = _ordered(told)
        found = straight if found is None else found.unionAll(straight)
        alone = told.where("not core").select(F.col("shard").alias("g"), F.col("a").alias("id")).join(rest.join(large, "g", "left_semi"), ["g", "id"]).select(rest.columns)
        rest = materialised(rest.join(large, "g", "left_anti").unionByName(alone))
    met = _rest_links(of, rest.select("g", "id", *words), tree)
    return met if found is None else found.unionAll(met)


def candidates(sets: DataFrame, tree: int = TREE) -> DataFrame:
    """Pairs (a, b) of rows (id, w0 and on; distinct ids) that stand for those within WIDE_RADIUS bits of
    each other that meet in a shard: each pair at WIDE_MEAN bits does but for a share of MISSED (see
    wide_tables), closer ones sooner. They are the spanning forests of the shards; what a pair that fails the
    comparison stood for, ``_reopened`` brings back.
    """
    keyed = _dealt(sets.select("id", *_words(WIDE)), wide_tables(sets.count()), WIDE)
    big = _oversized(keyed, tree)
    found = _in_trees((keyed if big is None else keyed.join(big, "g", "left_anti")).withColumn("role", F.lit(3)), WIDE, WIDE_RADIUS)
    if big is not None:
        of = materialised(keyed.join(big, "g").select("g", "n", "id", *_words(WIDE)))
        found = found.unionAll(_oversized_links(of, tree))
    return found.distinct()


def _groups(batches, names):
    """Columns of a sorted input as arrays, one group (of the first column) at a time."""
    held = None
    for b in batches:
        got = _arrays(b, names)
        held = got if held is None else [np.concatenate(c) for c in zip(held, got)]
        ends = [0, *(np.nonzero(held[0][1:] != held[0][:-1])[0] + 1).tolist()]
        for x, y in zip(ends, ends[1:]):
            yield [c[x:y] for c in held]
        held = [c[ends[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield held


def crossing(sets: list[np.ndarray], label: np.ndarray, home: np.ndarray, index: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of a Jaccard similarity of 4/5 or more that connect the components ``label`` as all such links do
    from members that ask to members of the index: fewer than there are components.

    ``sets``: distinct shingles, none empty. A member joined to a component at ``home`` asks no more: what
    crosses from there to elsewhere is found from the other side. A partner has one of any n - ceil(4n/5) + 1
    shingles of a set of n, so only members with one of the rarest so many are compared; none is left out.
    """
    size = np.array([len(x) for x in sets])
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner, at = np.repeat(np.arange(len(sets)), size), np.cumsum(size) - size
    inside = index[owner]
    count = np.bincount(token[inside], minlength=len(names))
    posting, begin = owner[inside][np.argsort(token[inside], kind="stable")], np.cumsum(count) - count
    postings = lambda tokens: np.concatenate([posting[begin[t] : begin[t] + count[t]] for t in tokens.tolist()])
    of = np.unique(label, return_inverse=True)[1]
    root, left, found = np.arange(of.max() + 1), int(of.max()) + 1, []
    settled = np.zeros(left, bool)
    settled[of[home]] = True
    for i in np.nonzero(asks)[0].tolist():
        if left == 1:
            break
        if settled[root[of[i]]]:
            continue
        own = token[at[i] : at[i] + size[i]]
        others = count[own] - int(index[i])
        rare = np.argsort(others, kind="stable")[: size[i] - (4 * size[i] + 4) // 5 + 1]
        if not others[rare].any():
            continue
        met = np.unique(postings(own[rare]))
        met = met[(root[of[met]] != root[of[i]]) & (5 * size[met] >= 4 * size[i]) & (5 * size[i] >= 4 * size[met])]
        if len(met) > FEW:
            both = np.bincount(postings(own), minlength=len(sets))[met]
        else:
            both = np.array([len(np.intersect1d(own, token[at[j] : at[j] + size[j]], assume_unique=True)) for j in met.tolist()], np.int64)
        for j in met[9 * both >= 4 * (size[i] + size[met])].tolist():
            x, y = root[of[i]], root[of[j]]
            if x != y:
                found.append((i, j))
                settled[x] |= settled[y]
                root[root == y] = x
                left -= 1
    return found


def _crossing(words):
    """Rows (g, role, home, id, component, z) sorted by g: role 1 is in the index of its group, 2 asks, 3 both."""

    def run(batches):
        for _, role, home, ids, label, z in _groups(batches, ["g", "role", "home", "id", "component", "z"]):
            links = np.array(crossing([_shingles(x, words) for x in z], label, home.astype(bool), (role & 1) > 0, (role & 2) > 0), np.int64).reshape(-1, 2)
            yield _edges(ids, links[:, 0], links[:, 1], None)

    return run


def _reopened(tested: DataFrame, joined: DataFrame, sizes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of similar texts that connect whatever failed pairs kept apart. ``tested``: all pairs compared so far;
    ``joined``: (node, component) by the good ones; ``sizes``: id, n; ``texts``: id, z of all that were in a pair.

    A pair that the search passed over for others lies in one component of the tested pairs, and only in one that
    the good pairs don't connect. In it, every member outside its largest good component is compared with every
    member, exactly and whatever their fingerprints, as one end of each missing link lies there. Texts go to the
    comparison, not pairs out of it: a task gives fewer rows than it has members. A component is one
    group up to PIECE shingles, and ASKING of those that ask; a larger one is cut into pieces, and each piece meets each cut of those.
    """
    near = components(tested).select(F.col("node").alias("id"), F.col("component").alias("near"))
    sides = near.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = sides.groupBy("near", "component").agg(F.count(F.lit(1)).alias("k"))
    most = parts.groupBy("near").agg(F.max(F.struct("k", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = materialised(sides.join(most.select("near", F.col("most.component").alias("largest")), "near").join(sizes, "id").withColumn("home", F.col("component") == F.col("largest")))
    cuts = rows.groupBy("near").agg(F.ceil(F.sum("n") / PIECE).cast("int").alias("pieces"), F.ceil(F.sum(F.when(~F.col("home"), F.col("n"))) / ASKING).cast("int").alias("chunks"))
    p, c = (_piece(F.col("near"), F.col(x), salt).cast("int") for x, salt in (("pieces", 2), ("chunks", 3)))
    rows = rows.join(cuts, "near").withColumns({"p": p, "c": F.when(F.col("home"), F.lit(-1)).otherwise(c)})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = F.transform(every("chunks"), lambda x: F.struct(F.col("p").alias("p"), x.alias("c")))
    asking = F.when(F.col("home"), F.slice(asked, 1, 0)).otherwise(F.transform(every("pieces"), lambda x: F.struct(x.alias("p"), F.col("c").alias("c"))))
    role = F.when(F.col("cell.p") == F.col("p"), 1).otherwise(0) + F.when(F.col("cell.c") == F.col("c"), 2).otherwise(0)
    dealt = rows.join(texts, "id").withColumn("cell", F.explode(F.array_union(asked, asking))).select(F.xxhash64("near", "cell.p", "cell.c").alias("g"), role.alias("role"), "home", "id", "component", "z")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_crossing(words), "a long, b long")


def _sets(words):
    def run(batches):
        for b in batches:
            ids, sizes, prints = [], [], []
            for text in b.column(2).to_pylist():
                x = np.unique(_hashes(text, words))
                ids.append(xxhash.xxh3_64_intdigest(x.tobytes()))
                sizes.append(len(x))
                prints.append(wide_fingerprint(x))
            w = np.array(prints, np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(w[:, i]) for i in range(WIDE))],
                names=["doc_id", "h", "id", "n", *_words(WIDE)],
            )

    return run


def _zipped(batches):
    for b in batches:
        z = [zlib.compress((x or "").encode("utf-8", "surrogatepass"), 1) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["id", "z"])


def _shingles(z: bytes, words: int) -> np.ndarray:
    return np.unique(_hashes(zlib.decompress(z).decode("utf-8", "surrogatepass"), words))


def _compared(words):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = _shingles(x.as_py(), words), _shingles(y.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, z): the compressed text of one row for each set in ``pairs`` (sets: id, one: doc_id and h of a row)."""
    nodes = materialised(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "one.*"), "id"))
    n = nodes.count()
    texts = rows.join(F.broadcast(nodes) if n <= BROADCAST else nodes, ["doc_id", "h"]).select("id", "text").mapInArrow(_zipped, "id long, z binary").dropDuplicates(["id"])
    return materialised(texts)


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose ``texts`` have an exact Jaccard similarity of 4/5 or more of their distinct
    shingles."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("z").alias(f"{c}_z"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_z", "b_z").mapInArrow(_compared(words), "a long, b long")


def _alike(sets: DataFrame, texts: DataFrame, words: int, tree: int) -> DataFrame:
    """(node, component) of the sets that link by their exact similarity."""
    tested = materialised(candidates(sets.where("n > 0"), tree))
    own = _texts_of(tested, sets, texts)
    good = materialised(verified(tested, own, words))
    joined = components(good)
    if good.count() == tested.count():
        return joined
    found = materialised(_reopened(tested, joined, sets.select("id", "n"), own, words))
    return joined if found.isEmpty() else components(good.unionAll(found))


def keep_one(docs: DataFrame, words: int = 5, tree: int = TREE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, and any others) without near duplicates, unchanged.

    Two texts link if the Jaccard similarity of their distinct shingles of ``words`` words is 4/5
    or more, directly or through others; of linked rows one stays: that with the smallest doc_id, of
    several such rows the one with the smallest hash of the whole row, once if it is repeated.
    Links are looked for with SimHash: of each distinct shingle set one fingerprint of 256 bits is
    searched in BK-trees for others within 64 bits, and the pairs found are compared exactly, those that
    a failed pair stood for too; see ``candidates`` for the share that may be lost. Texts of any length are read whole. Null and
    empty texts are alike. Rows without a doc_id stay; an empty table gives an empty result; columns
    may have any names, as they travel in a struct.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*columns).alias("h"), F.struct(*columns).alias("row"))
    texts = rows.select("doc_id", "h", F.col("row.text").cast("string").alias("text"))
    found = materialised(texts.mapInArrow(_sets(words), f"doc_id long, h long, id long, n long, {_row_kind(WIDE).split(', ', 1)[1]}"))
    whole = F.struct("n", *_words(WIDE))
    sets = materialised(found.groupBy("id").agg(F.first(whole).alias("x"), F.min(F.struct("doc_id", "h")).alias("one")).select("id", "x.*", "one"))
    with _tidy(docs.sparkSession):  # many small actions, whose shuffle files would add up
        joined = _alike(sets, texts, words, tree).withColumnRenamed("node", "id")
    times = found.groupBy("id", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")).join(joined, "id", "left")
    first = times.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min(F.struct("doc_id", "h", "n")).alias("one"))
    first = materialised(first.select("one.*"))
    kept = rows.join(first.select("doc_id", "h"), ["doc_id", "h"], "left_semi")
    if first.where("n > 1").limit(1).count():
        again = first.where("n > 1").select("doc_id", "h")
        kept = kept.join(again, ["doc_id", "h"], "left_anti").unionByName(kept.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]))
    kept = kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null")).select(*columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 2 bits."""
    found = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
