"""Exact top-k inner-product search by distributed histogram selection.

Everything is scored. A global histogram of each query's scores locates the bin that holds its
k-th best score; the bin is cut into finer bins, again over all rows, until it is one integer
wide. That integer is the exact k-th score, and a last pass keeps the rows at or above it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import scratch

#: Queries scored at a time: the broadcast block holds at most this many vectors.
QUERY_BLOCK = 4096
#: Bins of a histogram pass.
BINS = 2048
#: Elements of a score matrix held at once in a task.
CELLS = 1 << 21
LONG = (1 << 63) - 1


def _vectors(batch: pa.RecordBatch, scale: int):
    """(ids, integer matrix as float64) of a batch's valid vectors, by their length."""
    ids = batch.column(0).to_pylist() if batch.column(0).null_count else batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    known = np.array([x is not None for x in ids], bool) if isinstance(ids, list) else np.ones(len(ids), bool)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.nonzero((sizes == size) & known)[0]
        m = values[starts[rows][:, None] + np.arange(size)[None, :]]
        fine = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore"):
            m = np.floor(scale * m[fine])
        keep = np.array([ids[r] for r in rows[fine]], np.int64)
        yield int(size), keep, np.clip(m, -1.7e308, 1.7e308)


def _scores(q: np.ndarray, c: np.ndarray, exact: bool):
    """All inner products; ``exact`` says that float64 holds them and all partial sums."""
    if exact:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    s = whole(q).dot(whole(c).T) if q.size and c.size else np.zeros((len(q), len(c)), object)
    return np.clip(s, -LONG - 1, LONG)


def _norms(scale):
    def run(batches):
        for b in batches:
            for size, ids, m in _vectors(b, scale):
                if len(ids):
                    with np.errstate(over="ignore"):
                        yield pa.RecordBatch.from_pydict({"norm": [float(np.sqrt((m * m).sum(axis=1)).max(initial=0.0))]}, pa.schema([("norm", pa.float64())]))

    return run


def _chunks(batches, scale, block):
    """Pairs of a query group and a block of candidates of the same length."""
    for b in batches:
        for size, ids, m in _vectors(b, scale):
            if size in block and len(ids):
                qi, qids, q = block[size]
                step = max(1, CELLS // max(1, len(qids)))
                for at in range(0, len(ids), step):
                    yield qi, qids, q, ids[at : at + step], m[at : at + step]


def _histogram(scale, sent, bins):
    def run(batches):
        block, lo, hi, width, need, exact = sent.value
        counts = np.zeros((len(need), bins), np.int64)
        for qi, qids, q, ids, m in _chunks(batches, scale, block):
            s = _scores(q, m, exact)
            at = (s - lo[qi][:, None]) // width[qi][:, None]
            ok = (at >= 0) & (s < hi[qi][:, None]) & (ids[None, :] != qids[:, None])
            row, col = np.nonzero(ok)
            counts += np.bincount(qi[row] * bins + at[row, col].astype(np.int64), minlength=counts.size).reshape(counts.shape)
        # The k-th best of all rows is at or above the k-th best of these: lower bins cannot matter.
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        row, col = np.nonzero((counts > 0) & (above - counts < need[:, None]))
        yield pa.RecordBatch.from_pydict({"q": row.astype(np.int32), "bin": col.astype(np.int32), "n": counts[row, col]})

    return run


def _filter(scale, sent, k):
    def run(batches):
        block, least, exact = sent.value
        kept = {}
        for qi, qids, q, ids, m in _chunks(batches, scale, block):
            s = _scores(q, m, exact)
            row, col = np.nonzero((s >= least[qi][:, None]) & (ids[None, :] != qids[:, None]))
            for r in np.unique(row):
                c = col[row == r]
                old = kept.get(qi[r], ([], []))
                score = np.concatenate([np.asarray(old[0], object), s[r, c].astype(object)])
                vec = np.concatenate([np.asarray(old[1], np.int64), ids[c]])
                order = sorted(range(len(vec)), key=lambda i: (-score[i], vec[i]))[:k]
                kept[qi[r]] = ([int(score[i]) for i in order], [int(vec[i]) for i in order], int(qids[r]))
        rows = [(key, x[2], v, s) for key, x in kept.items() for s, v in zip(x[0], x[1])]
        names = ("q", "query_id", "vec_id", "score")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64()) for i in range(4)], names=names)

    return run


def _blocks(rows, size):
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _grouped(block, scale):
    """A block of query rows as {vector length: (indices, ids, matrix)}, by the rules of _vectors."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array([list(r[1]) for r in block], pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    out, at = {}, 0
    for size, ids, m in _vectors(batch, scale):
        if len(ids):
            out[size] = (np.arange(at, at + len(ids)), ids, m)
            at += len(ids)
    return out, at


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, bins: int = BINS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best candidates of each query by the integer inner product of floor(scale * x).

    ``vectors`` and ``queries`` have vec_id and embedding; further columns are ignored. Result:
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A candidate with the
    query's id is its own row and takes no part. Defined for edge cases: vectors that are null or
    hold a null or non-finite component, and rows without an id, take no part; vectors of
    different lengths are not compared; repeated query rows are answered once, repeated candidate
    rows each count; a query without candidates has no rows; scores beyond a long are clamped.

    Queries are taken in blocks of ``query_block`` vectors, which bounds what is broadcast. Each
    task sends, for a query, no more than its own best bins, and at last its own k best rows at
    or above the global k-th score, so a vector that is repeated very often is never gathered.
    """
    spark = vectors.sparkSession
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) for x in (vectors, queries))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = vectors.mapInArrow(_norms(scale), "norm double").agg(F.max("norm")).first()[0]
    if norm is None:
        return empty
    base, blocks, kept = scratch(spark, "topk"), 0, "q int, query_id long, vec_id long, score long"
    asked = queries.where("vec_id is not null and embedding is not null").distinct()
    for rows in _blocks(asked.toLocalIterator(), query_block):
        block, n = _grouped(rows, scale)
        if not n:
            continue
        largest = max(float(np.sqrt((x[2] * x[2]).sum(axis=1)).max()) for x in block.values())
        exact = largest * norm < 2.0**52
        reach = int(largest * norm * (1 + 1e-9)) + 2 if exact else LONG + 1
        kind = np.float64 if exact else object
        lo = np.array([-reach] * n, kind)
        width = np.array([max(1, -(-(2 * reach + 1) // bins))] * n, kind)
        hi, need, open_ = lo + width * bins, np.full(n, k, np.int64), np.ones(n, bool)
        while open_.any():
            sent = spark.sparkContext.broadcast((block, lo, hi, width, np.where(open_, need, 0), exact))
            counts = vectors.mapInArrow(_histogram(scale, sent, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cum = counts.withColumn("cum", F.sum("n").over(down)).withColumn("above", F.col("cum") - F.col("n"))
            wanted = spark.createDataFrame(pd.DataFrame({"q": np.arange(n, dtype=np.int32), "need": need}))
            found = cum.join(F.broadcast(wanted), "q").where("cum >= need and above < need").select("q", "bin", "above").collect()
            reached = ~open_
            for q, at, above in found:
                reached[q] = True
                lo[q] = lo[q] + at * width[q]
                need[q] -= above
            if not reached.all():  # fewer than k candidates: all of them are wanted
                lo[~reached] = -reach
            open_ &= reached & (width > 1)
            sent.unpersist()
            hi = np.where(open_, lo + width, lo)  # a query that is done counts no more
            width = np.array([max(1, -(-int(w) // bins)) for w in width], kind)
        sent = spark.sparkContext.broadcast((block, lo, exact))
        # What a block finds is written out, so that neither broadcasts nor the plan grow with the blocks.
        vectors.mapInArrow(_filter(scale, sent, k), kept).write.parquet(f"{base}/part={blocks}")
        sent.unpersist()
        blocks += 1
    if not blocks:
        return empty
    best = Window.partitionBy("part", "q").orderBy(F.desc("score"), "vec_id")
    out = spark.read.schema(f"{kept}, part int").parquet(base)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose vec_id is divisible by 100, against all embeddings."""
    from lodestone.llm.common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
           FROM embeddings, range(1, 65) AS t(i)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
