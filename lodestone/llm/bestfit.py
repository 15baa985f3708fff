"""Packing of whole documents into fixed windows by the sum of squared counts of open bins per gap."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, written

WINDOW = 2048
#: Pieces that one task packs; more pieces make more tasks.
PER_TASK = 65_536

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _batch(rows: list[tuple], last: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * (len(rows[0]) - 2 if rows else 4 + (last == "offset"))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["sequence_id"] if last == "offset" else []), last]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _cut(path: str, window: int):
    def run(batches):
        from lodestone.llm.wordids import encoder

        enc, place = encoder(path), TaskContext.get().partitionId() << 36
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                ids, texts = (b.column(i).slice(at, 256).to_pylist() for i in range(2))
                for doc_id, got in zip(ids, enc.encode([x or "" for x in texts])):
                    got += b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(got) // 4, window)):
                        some = got[4 * start : 4 * (start + window)]
                        rows.append((doc_id, piece, start, len(some) // 4, zlib.crc32(some), place))
                        place += 1
                yield _batch(rows, "place")

    return run


class Bins:
    """Sum-of-squares packing of sizes up to ``window``, one after the other.

    ``gaps[g]`` counts the open bins with a gap of g. A size goes where the sum of the squared counts
    afterwards is least: into an open bin, whose gap shrinks, or into a new one; a bin that becomes
    full is no longer counted. Ties take the smallest gap, a new bin last.
    """

    def __init__(self, window: int):
        self.window = window
        self.gaps = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def add(self, size: int, item) -> list | None:
        """Places an item; the items of its bin if that is full now."""
        n, rest = self.gaps, self.window - size
        if not rest:
            return [item]
        # Change of the sum if a bin leaves gap k + size (1 - 2n) and enters gap k (1 + 2n).
        change = 2 * (n[: rest + 1] - n[size:]) + 2
        change[0] -= 1
        change[n[size:] == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(change))
        if change[k] <= 2 * n[rest] + 1:
            held = self.open[k + size].pop()
            n[k + size] -= 1
        else:
            held, k = [], rest
        held.append(item)
        if not k:
            return held
        self.open[k].append(held)
        n[k] += 1
        return None

    def rest(self) -> list[list]:
        """The open bins at the end: as they are, or with their items packed anew, largest first into the
        tightest gap, whichever makes fewer."""
        bins = [held for some in self.open for held in some]
        gaps, anew = np.zeros(self.window + 1, np.int64), [[] for _ in range(self.window + 1)]
        for item in sorted((x for held in bins for x in held), key=lambda x: -x[3]):
            size = item[3]
            k = int(np.argmax(gaps[size:] > 0)) + size
            held = anew[k].pop() if gaps[k] and k >= size else []
            gaps[k] -= bool(held)
            k = (k if held else self.window) - size
            held.append(item)
            anew[k].append(held)
            gaps[k] += 1
        anew = [held for some in anew for held in some]
        return anew if len(anew) < len(bins) else bins


def _pack(window: int):
    def run(batches):
        bins, number, rows = Bins(window), TaskContext.get().partitionId() << 36, []
        for b in batches:
            for item in zip(*(b.column(i).to_pylist() for i in range(5))):
                full = bins.add(item[3], item)
                if full:
                    rows += _numbered(full, number)
                    number += 1
                if len(rows) > 20_000:
                    yield _batch(rows, "offset")
                    rows = []
        for held in bins.rest():
            rows += _numbered(held, number)
            number += 1
        yield _batch(rows, "offset")

    return run


def _numbered(held: list, number: int) -> list[tuple]:
    out, offset = [], 0
    for item in held:
        out.append((*item, number, offset))
        offset += item[3]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, per_task: int = PER_TASK) -> DataFrame:
    """Packs every document (doc_id, text; other columns are ignored) whole into windows of ``window`` ids.

    A document's ids are those of the tokenizer file ``tokenizer`` without special tokens added,
    then id 0; a null or empty text is id 0 alone. Only a document longer than a window is cut,
    into full windows and a rest. Texts of any length are read whole; after that only lengths and
    check sums move. They are dealt to tasks at random, ``per_task`` on average, and each task places its pieces
    one after the other by the sum-of-squares rule. The bins that are open at its end (a few hundred,
    however many it has packed) have their pieces packed anew, largest first, if that saves one.
    Repeated rows and those without a doc_id are packed each; an empty table gives an empty result.
    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer, window), _PIECES)
    found = written(found, scratch(spark, "pieces"))
    some = found.where(F.col("length") < window)
    tasks = max(1, -(-some.count() // per_task))
    dealt = some.withColumn("deal", F.xxhash64("place")).repartition(tasks, "deal").sortWithinPartitions("deal", "place")
    packed = dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(_pack(window), _PACKED)
    # A full window is a sequence of its own, numbered beyond those of the tasks.
    full = found.where(F.col("length") == window).withColumns({"sequence_id": F.col("place") + F.lit(1 << 62), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full.drop("place"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in windows of 2048 ids of the 49k word vocabulary."""
    import public_tokenizers

    from lodestone.llm.common import spread, table

    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
