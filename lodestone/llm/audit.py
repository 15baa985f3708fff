"""How five document filters interact: what each removes, in every order of applying them.

A document's failures are five bits. In a given order it is removed by the first filter that it
fails, so one table of 32 failure sets by 120 orders holds the answer for every document.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, written

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
#: Parts that a task counts before it hands over what it has; 23 KB each.
PARTS = 1024

_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_MARKED = "doc_id long, part string, fails int, text_key binary"


def first_failures() -> np.ndarray:
    """By failure set and order: the step (0 to 4) that removes a document, 5 if none does."""
    table = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for fails in range(1 << len(FILTERS)):
        for k, order in enumerate(ORDERS):
            table[fails, k] = next((step for step, f in enumerate(order) if fails >> FILTERS.index(f) & 1), len(FILTERS))
    return table


def _failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, from its UTF-8 bytes."""
    words = text.split()  # of bytes: at blanks and U+0009 to U+000D
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2
        | (len(text.translate(None, _SIGNS)) < len(text)) << 3
    )


def _marked(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            some = b.slice(at, 1024)
            texts = some.column(2).cast(pa.large_binary()).to_pylist()
            fails = [_failures(x or b"") for x in texts]
            keys = [hashlib.sha256(x or b"").digest() for x in texts]
            columns = [some.column(0), some.column(1), pa.array(fails, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "fails", "text_key"])


def _counted(most: int):
    """Partial arrays: for each part met, documents by label class, order and removing step."""
    table, wide = first_failures(), len(FILTERS) + 1
    size = 4 * len(ORDERS) * wide
    cells = np.arange(len(ORDERS)) * wide + table  # by failure set and order

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

        for b in batches:
            parts = b.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            fails, label = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            # Equal documents first: those of one part, label class and failure set count as one, weighted.
            met, times = np.unique((codes * 4 + label) * 32 + fails, return_counts=True)
            owner, label, fails = met // 128, met // 32 % 4, met % 32
            at = label[:, None] * (len(ORDERS) * wide) + cells[fails]
            bounds = np.searchsorted(owner, np.arange(len(parts.dictionary) + 1))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                own = slice(bounds[k], bounds[k + 1])
                weights = np.repeat(times[own], len(ORDERS))
                counts = np.bincount(at[own].ravel(), weights, size).astype(np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
            if len(sums) >= most:
                yield batch()
                sums.clear()
        if sums:
            yield batch()

    return run


_ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(part: str, counts: np.ndarray) -> pa.RecordBatch:
    """The rows of one part; label classes are 2 * good + toxic."""
    by = counts.reshape(4, len(ORDERS), len(FILTERS) + 1)
    removed = by.sum(axis=0)[:, :-1]
    good, toxic = by[2:].sum(axis=0)[:, :-1], by[1::2].sum(axis=0)[:, :-1]
    letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.bincount(letters.ravel(), removed.ravel(), len(FILTERS)).astype(np.int64)
    # Where a filter comes first it removes all that fail it, where it comes last those that fail it alone.
    fails, alone = np.zeros(len(FILTERS), np.int64), np.zeros(len(FILTERS), np.int64)
    fails[letters[:, 0]], alone[letters[:, -1]] = removed[:, 0], removed[:, -1]
    kept = by[:, 0].sum() - np.cumsum(removed, axis=1)
    columns = [kept, removed, fails[letters] - removed, alone[letters], good, toxic, shapley[letters]]
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
    arrays = [pa.array([part] * len(orders)), pa.array(orders.tolist()), pa.array(steps, pa.int32()), *(pa.array(x.ravel(), pa.int64()) for x in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ROWS.split(", ")])


def _reported(batches):
    """Sums the partial arrays of each part, which follow one another, and reports it."""
    part, counts = None, None
    for b in batches:
        for name, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            some = np.frombuffer(some, np.int64)
            if part is not None and name != part:
                yield _report(part, counts)
                counts = None
            part, counts = name, some if counts is None else counts + some
    if part is not None:
        yield _report(part, counts)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails) of every row of ``docs`` (doc_id, text, source; other columns are ignored).

    Bit k of ``fails`` stands for the k-th letter: A under 200 words, B under half of the words
    distinct, C over 2 % capitals A to Z, D one of the signs, E the same text as any smaller doc_id.
    Null texts are empty, null sources the empty string. Rows of one doc_id don't make each other
    fail E, nor does a row without a doc_id fail it or make another fail it.
    """
    columns = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")
    marked = written(docs.select(*columns).mapInArrow(_marked, _MARKED), scratch(docs.sparkSession, "marked"))
    # Only texts that several doc_ids have go into the join. They are written first: a join of two plain
    # exchanges is one whose hot text adaptive execution splits.
    least = marked.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = written(least.select("text_key", "least"), scratch(docs.sparkSession, "copied"))
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return marked.join(least, "text_key", "left").select("doc_id", "part", F.col("fails").bitwiseOR(copied * 16).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, parts: int = PARTS) -> DataFrame:
    """What each of the filters of ``failures`` removes at each step of each of their 120 orders, by part.

    One row per part, order and step, zeros included; see _ROWS. ``labels`` (doc_id, quality, toxic):
    a document is good (toxic) if any label row of its doc_id says 1; repeated document rows count
    each. An empty table of documents gives an empty result. Texts are read whole, once; then rows
    of 60 bytes move, and one partial array for each part and task.
    """
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality") * 2 + flag("toxic")).alias("label")).where("label > 0")
    labels = written(labels, scratch(docs.sparkSession, "labels"))
    known = failures(docs).join(labels, "doc_id", "left").select("part", "fails", F.coalesce("label", F.lit(0)).alias("label"))
    sums = known.mapInArrow(_counted(parts), "part string, counts binary")
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(_reported, _ROWS)


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    from lodestone.llm.common import spread, table

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
with recursive words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), first_of as (select body, min(doc_id) as least from words group by body),
marks as (
  select part, words.doc_id,
    case when len(w) < 200 then 'A' else '' end
      || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
      || case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) then 'C' else '' end
      || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
      || case when words.doc_id > least then 'E' else '' end as fails
  from words join first_of using (body)
), flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
sets as (
  select part, fails, coalesce(good, 0) as good, coalesce(bad, 0) as bad, count(*) as n
  from marks left join flags using (doc_id) group by all
), orders(o) as (
  select '' union all
  select o || l from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) x(l) where not contains(o, l)
), steps as (select o, step, substr(o, step::int, 1) as f from orders, range(1, 6) r(step) where length(o) = 5),
hits as (
  select part, o, step, f, n, good, bad, contains(fails, f) as failing, length(fails) as n_fails,
    length(translate(substr(o, 1, step::int - 1), fails, '')) < step - 1 as exists_before
  from sets, steps
), counted as (
  select part, o, step, f,
    sum(case when not failing and not exists_before then n else 0 end) as kept,
    sum(case when failing and not exists_before then n else 0 end) as removed,
    sum(case when failing and exists_before then n else 0 end) as redundant,
    sum(case when failing and n_fails = 1 then n else 0 end) as unique_fails,
    sum(case when failing and not exists_before and good = 1 then n else 0 end) as good_lost,
    sum(case when failing and not exists_before and bad = 1 then n else 0 end) as toxic_lost
  from hits group by all
)
select part, o as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""
