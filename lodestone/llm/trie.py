"""Prefix trie of conversations that share first turns, built as a compressed (Patricia) tree.

Turns are sorted into their conversations and each rebuilt conversation is written as segments of
at most 64 turns below the fingerprint of all that precedes. Sorted segments give, from the common
prefixes of neighbours, the tree's branch and end points; only these (and the ends of full segments,
so an edge has 64 turns at most) become rows. Sums over subtrees are made on that compressed tree
in a logarithmic number of joins, and the nodes on an edge follow from its sums of text lengths.

A prefix is known by the sum, modulo 2^64 twice, of 128-bit hashes of its turns and their places, so
the parts of a conversation can be summed up apart. No conversation, group of equal ones or node
has to fit into a task: what passes through the driver is a few numbers for each partition.
"""

from __future__ import annotations

import hashlib
import zlib
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, scratch, written

#: Conversations of a family start with turns of the one whose id is divisible by this.
FAMILY = 100
#: At most one less than this many turns are taken over.
SHARED = 6
#: Turns of a segment.
SEGMENT = 64
#: Conversation ids that are joined into one block of text before they are hashed.
BLOCK = 4096

_EMPTY = hashlib.sha256().hexdigest()
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return (x & _MASK) - (x & 1 << 63) * 2


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(schema.types)], schema=schema)


def _flushing(rows_of, schema: pa.Schema):
    """Batches of what a generator of rows gives."""

    def run(batches):
        rows = []
        for row in rows_of(batches):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(pid, family, conv_id, turn_key, chars) sorted by family, its first conversation before the others,
    conversation and turn, in partitions that may cut a conversation anywhere."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("family"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, 16).alias("start"), F.unhex(F.substring(digest, 1, 32)).alias("turn_key"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("place"),
    )
    narrow = written(narrow, scratch(conversations.sparkSession, "turns"))
    keys = [F.col("family"), F.col("conv_id") != F.col("family"), F.col("conv_id"), F.col("turn").asc_nulls_first(), *(F.col(x) for x in ("role", "start", "turn_key", "place"))]
    return materialised(narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("pid"), "family", "conv_id", "turn_key", "chars"))


_SUMMARY = "pid int, first_conv long, family long, conv_id long, run long, alone boolean, head_keys binary, head_chars array<long>"


def _summary(batches):
    """Of a partition: first and last conversation, turns of the last one, its family's first turns."""
    first = pid = family = conv = None
    run, heads = 0, []
    for pid, own_family, own, key, chars in _rows(batches):
        if own_family != family:
            family, heads = own_family, []
        if own != conv:
            conv, run = own, 0
            first = own if first is None else first
        run += 1
        if own == family and len(heads) < SHARED - 1:
            heads.append((key, chars))
    if pid is not None:
        yield pid, first, family, conv, run, first == conv, b"".join(k for k, _ in heads), [c for _, c in heads]


def _carried(sorted_turns: DataFrame) -> tuple[dict, dict]:
    """By partition: what the partitions before it leave open (conversation, its turns so far, family, its
    first turns), and the conversation that follows."""
    carry, follows, state, before = {}, {}, (None, 0, None, []), None
    for r in sorted(sorted_turns.mapInArrow(_flushing(_summary, _schema(_SUMMARY)), _SUMMARY).collect()):
        carry[r.pid] = state
        if before is not None:
            follows[before] = r.first_conv
        before = r.pid
        heads = [(bytes(r.head_keys[16 * i : 16 * i + 16]), c) for i, c in enumerate(r.head_chars)]
        if r.family == state[2]:
            heads = (state[3] + heads)[: SHARED - 1]
        state = (r.conv_id, r.run + (state[1] if r.alone and r.conv_id == state[0] else 0), r.family, heads)
    return carry, follows


_PART, _END, _TAIL = range(3)
_PARTS = "pid int, kind int, conv_id long, depth long, a long, b long, c long, items binary, sizes binary, whole boolean"


def _rebuilt(carry: dict, follows: dict, segment: int):
    """Segments and ends of the rebuilt conversations; sums count from the partition's start."""

    def run(batches):
        conv = family = pid = None
        a = b = c = depth = count = taken = skip = at = 0
        heads, items, sizes = [], [], []

        def part(whole):
            held = pid, _PART, conv, depth - len(items), at[0], at[1], at[2], b"".join(items), np.array(sizes, "<i8").tobytes(), whole and (depth - len(items)) % segment == 0
            items.clear(), sizes.clear()
            return held

        def turn(key, chars):
            """A turn joins the segment at hand."""
            nonlocal a, b, c, depth, at
            if not items:
                at = _signed(a), _signed(b), c
            depth += 1
            item = hashlib.blake2b(key + pack(">q", depth), digest_size=16).digest()
            x, y = unpack(">QQ", item)
            a, b, c = a + x, b + y, c + chars
            items.append(item), sizes.append(chars)
            return depth % segment == 0

        for pid, own_family, own, key, chars in _rows(batches):
            if conv is None:
                conv, count, family, heads = carry[pid]
                heads = list(heads)
                if conv is not None and conv == own:
                    skip = 0 if conv == family else zlib.crc32(str(conv).encode()) % SHARED
                    taken = min(skip, len(heads)) if conv != family else 0
                    depth = taken + max(0, count - skip)
                else:
                    conv = None
            if own_family != family:
                family, heads = own_family, []
            if own != conv:
                if conv is not None:
                    if items:
                        yield part(True)
                    yield pid, _END, conv, depth, _signed(a), _signed(b), c, None, None, None
                conv, a, b, c, depth, count, skip, taken = own, 0, 0, 0, 0, 0, 0, 0
                if conv != family:
                    skip = zlib.crc32(str(conv).encode()) % SHARED
                    for x in heads[:skip]:
                        turn(*x)
            count += 1
            if conv == family and len(heads) < SHARED - 1:
                heads.append((key, chars))
            if count > skip and turn(key, chars):
                yield part(True)
        if conv is None:
            return
        open_still = follows.get(pid) == conv
        if items:
            yield part(not open_still)
        yield pid, _TAIL if open_still else _END, conv, depth, _signed(a), _signed(b), c, None, None, None

    return run


def _absolute(carry: dict):
    """Adds to the sums of a conversation that an earlier partition began what they were there."""

    def run(batches):
        for batch in batches:
            pids, convs = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            columns = {n: batch.column(n) for n in batch.schema.names}
            for pid in set(pids):
                conv, sums = carry.get(pid) or (None, None)
                if conv is not None:
                    own = (np.array(pids) == pid) & (convs == conv)
                    for n, x in zip("abc", sums):
                        columns[n] = pa.array(columns[n].to_numpy() + np.where(own, np.int64(_signed(x)), np.int64(0)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def segments_and_ends(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Distinct segments (a, b, c, depth, items, sizes) of the rebuilt conversations, where a and b are the
    fingerprint of what precedes them, c its code points and depth its turns; and each conversation's
    end (a, b, c, depth, conv_id)."""
    turns = ordered_turns(conversations)
    carried, follows = _carried(turns)
    parts = materialised(turns.mapInArrow(_flushing(_rebuilt(carried, follows, segment), _schema(_PARTS)), _PARTS))
    tails = {r.pid: r for r in parts.where(F.col("kind") == _TAIL).collect()}
    carry, state = {}, None
    for pid in sorted(carried):
        carry[pid], tail = state, tails.get(pid)
        before = state[1] if state and tail and state[0] == tail.conv_id else (0, 0, 0)
        state = (tail.conv_id, tuple(x + y for x, y in zip(before, (tail.a, tail.b, tail.c)))) if tail else None
    parts = parts.mapInArrow(_absolute(carry), _PARTS)
    ends = parts.where(F.col("kind") == _END).select("a", "b", "c", "depth", "conv_id")
    parts = parts.where(F.col("kind") == _PART)
    # Segments that partitions cut: two parts for each partition at most.
    cut = parts.where("not whole").groupBy("conv_id", F.expr(f"depth div {int(segment)}").alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "a", "b", "c", "items", "sizes"))).alias("p")
    )
    joined = cut.select(*(F.col("p")[0][x].alias(x) for x in ("a", "b", "c", "depth")), F.concat_ws("", F.transform("p", lambda x: F.hex(x["items"]))).alias("i"), F.concat_ws("", F.transform("p", lambda x: F.hex(x["sizes"]))).alias("s"))
    some = parts.where("whole").select("a", "b", "c", "depth", "items", "sizes").unionByName(joined.select("a", "b", "c", "depth", F.unhex("i").alias("items"), F.unhex("s").alias("sizes")))
    # Groups of equal conversations become one row here, combined before the shuffle.
    return some.groupBy("a", "b", "items").agg(*(F.min(x).alias(x) for x in ("c", "depth", "sizes"))), ends


_EDGES = "pid int, first_a long, first_b long, first_items binary, last_a long, last_b long, last_items binary"


def _edges(batches):
    first = last = None
    for last in _rows(batches):
        first = first or last
    if last is not None:
        yield last[0], *first[1:4], *last[1:4]


def _common(x: tuple, y: tuple) -> int:
    """Turns that two segments (a, b, items) have in common; -1 if other turns precede them."""
    if x[:2] != y[:2]:
        return -1
    u, v = x[2], y[2]
    low, high = 0, min(len(u), len(v)) // 16
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if u[: 16 * mid] == v[: 16 * mid] else (low, mid - 1)
    return low


_POINTS = "a long, b long, depth long, up long, up_a long, up_b long, top long, sums array<long>, real boolean"


class _Path:
    """A segment's prefixes: their fingerprints and sums of code points."""

    def __init__(self, row):
        _, self.a, self.b, self.items, self.c, self.depth, sizes = row
        self.key, self.size = (self.a, self.b, self.items), len(self.items) // 16
        self.sizes, self.sums = sizes, None

    def point(self, depth: int, up: int, real: bool) -> tuple:
        if self.sums is None:
            turns = np.frombuffer(self.items, ">u8").reshape(-1, 2).astype(np.uint64)
            top = np.array([[self.a, self.b]], np.int64).astype(np.uint64)
            self.marks = np.cumsum(np.vstack([top, turns]), axis=0, dtype=np.uint64).astype(np.int64).tolist()
            self.sums = [self.c, *(self.c + np.cumsum(np.frombuffer(self.sizes, "<i8"))).tolist()]
        return *self.marks[depth], self.depth + depth, self.depth + up, *self.marks[up], self.depth, self.sums[: depth + 1], real


def _points(common: dict):
    """Branch and end points of a partition's sorted segments, each with its next point above.

    ``common`` has, by partition, what its first segment shares with the one before and its last
    with the one after. A prefix that reaches into other partitions may be a point there only, or
    have its next point above in one of them: what this one knows of such prefixes is told, not
    ``real``, and the deepest answer holds.
    """

    def run(batches):
        stack, last, head, minima, low = [0], None, None, [], 0
        left = right = -1

        def shrink(to):
            while stack[-1] > to:
                depth = stack.pop()
                yield last.point(depth, max(stack[-1], to), True)

        for row in _rows(batches):
            here = _Path(row)
            if last is None:
                left, right = common[row[0]]
                shared, head, low = left, here if left > 0 else None, left
            else:
                shared = _common(last.key, here.key)
                yield from shrink(max(shared, 0))
                if head and low > 0 and shared < low:
                    low = shared
                    minima.append(shared)
            if shared < 0:
                stack = [0]
            elif stack[-1] < shared:
                stack.append(shared)
            if here.size > stack[-1]:
                stack.append(here.size)
            last = here
        if last is None:
            return
        yield from shrink(max(right, 0))
        if right > stack[-1]:
            stack.append(right)
        known = list(stack)
        yield from shrink(0)
        for depth in range(1, right + 1):
            if depth not in known:
                yield last.point(depth, max(x for x in known if x < depth), False)
        if head:
            if 0 < right < low:
                minima.append(right)
            for depth in range(1, left + 1):
                yield head.point(depth, max((x for x in minima if 0 < x < depth), default=0), False)

    return run


_HASHED = "a long, b long, first long, n long, ids string, ends_sha256 string"


def _hashed(size: int):
    """Of groups of conversation ids, which follow one another: count, smallest and hash. Ids of the
    first and last group, and of those of more than a block, go on as blocks."""

    def run(batches):
        group, ids, first, whole = None, [], 0, False

        def block():
            return *group, first, len(ids), ",".join(map(str, ids)), None

        for a, b, conv in _rows(batches):
            if (a, b) != group:
                if group is not None:
                    yield (*group, first, len(ids), None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) if whole else block()
                whole, group, ids, first = group is not None, (a, b), [], conv
            if len(ids) == size:
                yield block()
                whole, ids, first = False, [], conv
            ids.append(conv)
        if group is not None:
            yield block()

    return run


def _joined(batches):
    """The hash of each group from its blocks, which follow one another; only its state is held."""
    group, n, first, digest = None, 0, 0, None
    for a, b, low, some, ids in _rows(batches):
        if (a, b) != group:
            if group is not None:
                yield *group, first, n, None, digest.hexdigest()
            group, n, first, digest = (a, b), 0, low, hashlib.sha256()
        digest.update((("," if n else "") + ids).encode())
        n += some
    if group is not None:
        yield *group, first, n, None, digest.hexdigest()


def end_groups(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, first, n, ends_sha256) of the conversations that end at the same prefix."""
    keys = ["a", "b", "conv_id"]
    some = materialised(ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_flushing(_hashed(block), _schema(_HASHED)), _HASHED))
    blocks = some.where("ends_sha256 is null").select("a", "b", "first", "n", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return some.where("ends_sha256 is not null").unionByName(blocks.mapInArrow(_flushing(_joined, _schema(_HASHED)), _HASHED)).drop("ids")


def compressed(segments: DataFrame) -> DataFrame:
    """Points (a, b, depth, up, up_a, up_b, top, sums) of the tree but for its root: ``up`` is the depth of
    the next point above, ``sums`` the code points of the prefixes from depth ``top`` to the point's."""
    keys = ["a", "b", "items"]
    rows = materialised(segments.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("pid"), *keys, "c", "depth", "sizes"))
    edges = sorted(tuple(r) for r in rows.mapInArrow(_flushing(_edges, _schema(_EDGES)), _EDGES).collect())
    shared = [_common((*x[4:6], bytes(x[6])), (*y[1:3], bytes(y[3]))) for x, y in zip(edges, edges[1:])]
    common = {e[0]: sides for e, sides in zip(edges, zip([-1, *shared], [*shared, -1]))}
    told = rows.mapInArrow(_flushing(_points(common), _schema(_POINTS)), _POINTS)
    up = F.max(F.struct("up", "up_a", "up_b")).alias("p")
    merged = told.groupBy("a", "b").agg(up, F.max("real").alias("real"), *(F.min(x).alias(x) for x in ("depth", "top", "sums")))
    return merged.where("real").select("a", "b", "depth", F.col("p.up").alias("up"), F.col("p.up_a").alias("up_a"), F.col("p.up_b").alias("up_b"), "top", "sums")


def _subtree_sums(points: DataFrame, values: dict) -> DataFrame:
    """(a, b, values) summed over each point's subtree by doubling: after k rounds a point has the sum of
    those less than 2^k points below and knows the point 2^k above. ``values`` maps columns to
    aggregates; the root's ``up_a`` is null."""
    names = list(values)
    rows = materialised(points.select("a", "b", "up_a", "up_b", *names))
    while rows.where("up_a is not null").limit(1).count():
        below = rows.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*(f(n).alias(f"{n}_") for n, f in values.items()))
        above = rows.where("up_a is not null").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        both = {n: F.least(n, f"{n}_") if f is F.min else F.col(n) + F.coalesce(f"{n}_", F.lit(0)) for n, f in values.items()}
        # Points right below the root go no further up and don't take part in the join with it.
        climbing = (F.col("up_a") != 0) | (F.col("up_b") != 0)
        rows = rows.join(below, ["a", "b"], "left").select("a", "b", F.when(climbing, F.col("up_a")).alias("up_a"), F.when(climbing, F.col("up_b")).alias("up_b"), *(both[n].cast(rows.schema[n].dataType).alias(n) for n in names))
        rows = materialised(rows.join(above, ["up_a", "up_b"], "left").select("a", "b", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), *names))
    return rows.select("a", "b", *names)


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of rebuilt conversations; ``conversations`` has conv_id, turn, role, text.

    A conversation c takes over the first h turns of c - c % 100 (h the crc32 of its id, modulo 6) in
    place of its own first h. Turns are ordered by turn, null first; ties by role, the text's first
    16 characters and then its digest, so repeated rows are turns one after another. Null roles and
    texts are empty; rows without conv_id belong to no conversation; ids may be negative (c % 100
    then has c's sign). Texts of any length count whole. An empty table has no nodes, else there is a root.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, one less than members times code points of the last text),
    ends_sha256 (of the members that end there; the state of that hash passes from one block of ids to
    the next, so one task streams the ids of a node). Other columns of the input are ignored.
    """
    spark = conversations.sparkSession
    segments, ends = segments_and_ends(conversations, segment)
    ends = materialised(ends)
    groups = end_groups(ends, block)
    root = ends.limit(1).select(*(F.lit(0).cast("long").alias(x) for x in ("a", "b", "depth", "up")), *(F.lit(None).cast("long").alias(x) for x in ("up_a", "up_b")), F.lit(0).cast("long").alias("top"), F.array(F.lit(0).cast("long")).alias("sums"))
    points = compressed(segments).unionByName(root)
    children = points.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    total = lambda depth: F.element_at("sums", (F.col(depth) - F.col("top") + 1).cast("int"))
    points = points.join(children, ["a", "b"], "left").join(groups, ["a", "b"], "left").select(
        *points.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("first").alias("conv"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        (F.coalesce("n", F.lit(0)).cast("decimal(19,0)") * total("depth")).cast("decimal(38,0)").alias("paths"), (total("depth") - total("up")).cast("decimal(38,0)").alias("edges"),
    )
    points = written(points, scratch(spark, "points"))
    sums = _subtree_sums(points, {"conv": F.min, "n": F.sum, "leaves": F.sum, "paths": F.sum, "edges": F.sum})
    whole = points.drop("conv", "n", "leaves", "paths").withColumnRenamed("edges", "own").join(sums, ["a", "b"])
    owners = sums.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("up_conv"))
    whole = whole.join(owners, ["up_a", "up_b"], "left")
    # Below the point: all members' texts but for those that a node's first member brings.
    below = F.col("paths") - F.col("n") * total("depth") - (F.col("edges") - F.col("own"))
    whole = whole.withColumn("below", below).withColumn("top_depth", F.when(F.col("depth") == 0, 0).otherwise(F.col("up") + 1).cast("long"))
    nodes = whole.withColumn("at", F.explode(F.sequence("top_depth", "depth")))
    point = F.col("at") == F.col("depth")
    # On an edge the texts from the node down to the point are added: a suffix of the edge's sums.
    suffix = F.when(F.col("at") == 0, 0).otherwise((F.col("n") - 1) * (total("depth") - F.element_at("sums", F.greatest(F.col("at") - F.col("top"), F.lit(1)).cast("int"))))
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("top_depth"), F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(point, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + suffix).cast("long").alias("saved_tokens"), F.when(point, F.col("ends_sha256")).otherwise(_EMPTY).alias("ends_sha256"),
    )


SQL = """
with recursive turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null
), crc(c, s, k, v) as (
  -- CRC-32 of the decimal id, a bit a step.
  select distinct c, c::varchar, 0, 4294967295::bigint from turns
  union all
  select c, s, k + 1, case when u % 2 = 1 then xor(u // 2, 3988292384) else u // 2 end
  from (select c, s, k, case when k % 8 = 0 then xor(v, ascii(substr(s, k // 8 + 1, 1))::bigint) else v end as u from crc where k < 8 * length(s))
), heads as (select c, c - c % 100 as base, xor(v, 4294967295) % 6 as h from crc where k = 8 * length(s)),
built as (
  select heads.c, 0 as own, i, r, x from heads join turns on turns.c = base where i <= h
  union all
  select heads.c, 1, i, r, x from heads join turns using (c) where i > h
), placed as (select c, r, x, row_number() over (partition by c order by own, i) as d from built),
nodes(c, d, id, up, n_text) as (
  select c, 0, sha256(''), null::varchar, 0 from heads
  union all
  select nodes.c, nodes.d + 1, sha256(nodes.id || length(r) || ':' || r || x), nodes.id, length(x)
  from nodes join placed on placed.c = nodes.c and placed.d = nodes.d + 1
), known as (
  select id, any_value(up) as up, any_value(d) as d, any_value(n_text) as n_text, min(c) as conv, count(*) as n from nodes group by id
), lasts as (select c, max_by(id, d) as id from nodes group by c),
ends as (select id, string_agg(c::varchar, ',' order by c) as ids from lasts group by id),
kids as (select up, count(*) as n_children from known where up is not null group by up),
above(id, top) as (select id, id from known union all select above.id, known.up from above join known on known.id = above.top where known.up is not null),
sums as (
  select top, sum(case when n_children is null then 1 else 0 end) as n_leaves, sum((n - 1) * n_text) as saved
  from above join known using (id) left join kids on kids.up = known.id group by top
)
select k.conv as conv_id, k.d::bigint as depth, p.conv as parent_conv_id, k.n as n_convs, coalesce(n_children, 0) as n_children,
  n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from known k left join known p on p.id = k.up left join kids on kids.up = k.id join sums on sums.top = k.id left join ends on ends.id = k.id
"""


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    from lodestone.llm.common import table

    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
