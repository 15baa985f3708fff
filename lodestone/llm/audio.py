"""Chroma fingerprints of audio columns, and alignment of recordings by them.

A recording becomes frames of pitch-class energies; box filters over an integral image of those
frames, each quantised to two bits, give one packed 32-bit integer a frame. Two recordings align
at the offset that most of their common integers agree on (the peak of the offset histogram), and
the share of differing bits over the overlap says how well.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, scratch, spread

RATE = 4000
FRAME, HOP = 1024, 256
CLASSES = 12
#: Frames that a filter looks at.
SPAN = 16
#: Integers of queries that are searched for at a time, and matches that a task holds.
BLOCK, MATCHES = 1 << 18, 1 << 22
#: Aligned recordings: least votes at the peak, and most bit errors of the overlap.
VOTES, BIT_ERROR = 4, 0.15
#: Quantiser steps of the log ratios of the filters.
STEPS = (-0.25, 0.0, 0.25)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first class, classes, frames), by rule: six layouts of light and dark boxes
    over windows of growing height and width."""
    return [(i % 6, (5 * i) % CLASSES, 2 + (i * 3) % (CLASSES - 1), 4 * (1 + i % 4)) for i in range(16)]


_FILTERS = filters()


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the twelve pitch classes in every frame, each frame scaled to length 1."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n <= 0:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (pitch > 80) & (pitch < 0.48 * rate)
    of = np.round(12 * np.log2(pitch[use] / 440.0)).astype(np.int64) % CLASSES
    energy = power[:, use] @ np.eye(CLASSES)[of]
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, energy / np.maximum(size, 1e-9), 0.0)


def _boxes(image: np.ndarray, at: np.ndarray, first: int, classes: int, begin: int, frames: int) -> np.ndarray:
    """Sum of a box of the integral image, for every place; classes wrap around the octave."""
    a, b = at + begin, at + begin + frames
    total = np.zeros(len(at))
    while classes > 0:
        take = min(classes, CLASSES - first % CLASSES)
        y = first % CLASSES
        total += image[b, y + take] - image[a, y + take] - image[b, y] + image[a, y]
        first, classes = first + take, classes - take
    return total


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The packed integers (uint32) of a recording, one for each place that SPAN frames fit."""
    c = chroma(np.asarray(samples, np.float64), rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, CLASSES + 1))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at, out = np.arange(n), np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(_FILTERS):
        box = lambda dy, hh, dx, ww: _boxes(image, at, y + dy, hh, dx, ww)
        if kind == 0:
            light, dark = box(0, h, 0, w), 0.5 * h * w / CLASSES
        elif kind == 1:
            light, dark = box(0, h // 2 or 1, 0, w), box(h // 2, h - h // 2, 0, w)
        elif kind == 2:
            light, dark = box(0, h, 0, w // 2), box(0, h, w // 2, w - w // 2)
        elif kind == 3:
            light = box(0, h // 2, 0, w // 2) + box(h // 2, h - h // 2, w // 2, w - w // 2)
            dark = box(0, h // 2, w // 2, w - w // 2) + box(h // 2, h - h // 2, 0, w // 2)
        elif kind == 4:
            light, dark = box(h // 3, h // 3 or 1, 0, w), box(0, h // 3 or 1, 0, w) + box(2 * (h // 3), h - 2 * (h // 3), 0, w)
        else:
            light, dark = box(0, h, w // 3, w // 3 or 1), box(0, h, 0, w // 3 or 1) + box(0, h, 2 * (w // 3), w - 2 * (w // 3))
        value = np.log((1 + light) / (1 + dark))
        level = np.searchsorted(STEPS, value, side="right")
        out |= ((level ^ (level >> 1)).astype(np.uint32)) << np.uint32(2 * i)  # Gray code
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float, int]:
    """(offset of b in a, votes, bit error, overlap) at the peak of the offset histogram; the
    smallest offset of several peaks. Without a common integer: offset 0, no votes, error 1."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    which = np.repeat(np.arange(len(a)), right - left)
    if not len(which):
        return 0, 0, 1.0, 0
    nth = np.arange(len(which)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
    offsets = which - order[np.repeat(left, right - left) + nth]
    kinds, votes = np.unique(offsets, return_counts=True)
    best = int(votes.argmax())
    offset = int(kinds[best])
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    wrong = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
    return offset, int(votes[best]), wrong / (32 * n), n


def _arrays(lists: pa.ListArray):
    """The rows of a column of lists as arrays, null values as NaN; None for a null row."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    at = 0
    for n in sizes.tolist():
        yield flat[at : at + n] if n >= 0 else None
        at += max(n, 0)


def _printed(rate):
    def run(batches):
        for b in batches:
            out = [fingerprint(x, rate).astype("<u4").tobytes() if x is not None and np.isfinite(x).all() else None for x in _arrays(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["rec_id", "ints"])

    return run


def fingerprints(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """(rec_id, ints) of recordings (rec_id, samples array): ints are packed little-endian; null if
    samples are null or hold a null or non-finite value, empty if the recording is too short."""
    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("samples").cast("array<double>")).mapInArrow(_printed(rate), "rec_id long, ints binary")


class Index:
    """The integers of a block of recordings, sorted, with the recording and place of each."""

    def __init__(self, block: list[tuple[int, bytes]]):
        self.ids = np.array([c for c, _ in block], np.int64)
        self.prints = [np.frombuffer(x, "<u4") for _, x in block]
        ints = np.concatenate([np.zeros(0, np.uint32), *self.prints])
        order = np.argsort(ints, kind="stable")
        self.ints = ints[order]
        self.owner = np.repeat(np.arange(len(block)), [len(x) for x in self.prints])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in self.prints)])[order]
        self.reach = max((len(x) for x in self.prints), default=0)

    def peaks(self, x: np.ndarray):
        """(recording of the block, offset, votes) at the peak of each offset histogram with ``x``, the
        smallest offset of several; matches are counted in parts, so few are held at a time."""
        left, right = np.searchsorted(self.ints, x, "left"), np.searchsorted(self.ints, x, "right")
        many = right - left
        width, kinds, votes = len(x) + self.reach + 1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = np.cumsum(many) // MATCHES
        for p in np.unique(part[many > 0]):
            at = np.nonzero((part == p) & (many > 0))[0]
            which = np.repeat(at, many[at])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            hit = np.repeat(left[at], many[at]) + nth
            kinds = np.concatenate([kinds, key := self.owner[hit] * width + (self.place[hit] - which + len(x))])
            votes = np.concatenate([votes, np.ones(len(key), np.int64)])
            kinds, back = np.unique(kinds, return_inverse=True)
            votes = np.bincount(back, votes, len(kinds)).astype(np.int64)
        owner, offset = kinds // width, kinds % width - len(x)
        order = np.lexsort((offset, -votes, owner))
        first = np.ones(len(order), bool)
        first[1:] = owner[order[1:]] != owner[order[:-1]]
        best = order[first]
        return owner[best], offset[best], votes[best]


def _searched(sent, votes, bit_error):
    def run(batches):
        index = sent.value
        for b in batches:
            out = []
            for c, ints in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(ints, "<u4")
                for q, offset, n in zip(*(v.tolist() for v in index.peaks(x))):
                    if n < votes or index.ids[q] == c:
                        continue
                    a, y = index.prints[q][max(0, offset) :], x[max(0, -offset) :]
                    overlap = min(len(a), len(y))
                    error = int(np.bitwise_count(a[:overlap] ^ y[:overlap]).sum()) / (32 * overlap)
                    if error <= bit_error:
                        out.append((int(index.ids[q]), c, offset, n, error, overlap))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _PAIR.split(", ")])

    return run


_PAIR = "query_class long, class_id long, offset int, votes int, bit_error double, overlap int"


def _blocks(rows, size: int):
    block, held = [], 0
    for r in rows:
        block.append((r["class_id"], bytes(r["ints"])))
        held += len(r["ints"]) // 4
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(prints: DataFrame, queries: DataFrame, votes: int = VOTES, bit_error: float = BIT_ERROR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Aligns the recordings ``queries`` (rec_id) with all of ``prints`` (rec_id, ints).

    Returns (members, pairs). members: (rec_id, class_id), recordings with the same fingerprint
    being one class named by its smallest rec_id. pairs: between a class with a query and another
    class: (query_class, class_id, offset, votes, bit_error, overlap), at the peak of the offset
    histogram, where it has ``votes`` or more and the bit error is ``bit_error`` or less. Nothing is
    left out: queries are sent in blocks of about ``block`` integers, and every recording is looked
    up in each, so that work is the product of queries and recordings, without a shuffle, and an
    integer that very many recordings have (silence) gathers them nowhere. Recordings of any length
    are used whole. Those without a fingerprint, or with an empty one, are classes of their own
    without pairs; rows without rec_id take no part; repeated rows are members of one class each.
    """
    spark = prints.sparkSession
    prints = materialised(prints.where("rec_id is not null").withColumn("h", F.xxhash64(F.coalesce("ints", F.lit(b"")), F.when(F.coalesce(F.length("ints"), F.lit(0)) == 0, F.col("rec_id")))))
    classes = materialised(prints.groupBy("h").agg(F.min("rec_id").alias("class_id"), F.first("ints").alias("ints")))
    members = prints.join(classes.select("h", "class_id"), "h").select("rec_id", "class_id", "ints")
    full = classes.where("length(ints) > 0").select("class_id", "ints")
    asked = members.join(queries.select(F.col("rec_id").cast("long").alias("rec_id")).distinct(), "rec_id").select("class_id").distinct()
    base = scratch(spark, "audio")
    written = 0
    for some in _blocks(full.join(asked, "class_id").toLocalIterator(), block):
        sent = spark.sparkContext.broadcast(Index(some))
        spread(full).mapInArrow(_searched(sent, votes, bit_error), _PAIR).write.parquet(f"{base}/part={written}")
        sent.unpersist()
        written += 1
    return members, spark.read.schema(_PAIR).parquet(base) if written else spark.createDataFrame([], _PAIR)


def decoded(wav: bytes) -> tuple[np.ndarray, int] | None:
    """(samples from -1 to 1, one channel; rate) of a WAV file of integer or float PCM, or None."""
    if len(wav) < 12 or wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(wav):
        size = int.from_bytes(wav[at + 4 : at + 8], "little")
        if wav[at : at + 4] == b"fmt " and size >= 16 and at + 24 <= len(wav):
            kind, channels, rate, _, _, bits = np.frombuffer(wav[at + 8 : at + 24], np.dtype("<u2,<u2,<u4,<u4,<u2,<u2"))[0].tolist()
            kind = int.from_bytes(wav[at + 32 : at + 34], "little") if kind == 0xFFFE and size >= 26 else kind
            form = (kind, channels, rate, bits)
        elif wav[at : at + 4] == b"data":
            data = wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not form or data is None or not form[1] or not form[2]:
        return None
    kind, channels, rate, bits = form
    width = bits // 8
    if not width or (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
        return None
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if kind == 3:
        x = raw.reshape(-1).view(f"<f{width}").astype(np.float64)
    elif bits == 8:
        x = raw[:, 0].astype(np.float64) / 128 - 1
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.reshape(-1).view("<i4").astype(np.float64) / 2**31
    return x.reshape(-1, channels).mean(axis=1), rate


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate: averaged over the new step where that is the longer one, else between
    neighbours."""
    n = int(len(x) * to / rate)
    if rate <= to:
        return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x) if n else np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(x)])
    edge = np.interp(np.arange(n + 1) * rate / to, np.arange(len(total)), total)
    return np.diff(edge) * to / rate


def recordings(media: DataFrame, rate: int = RATE) -> DataFrame:
    """(rec_id, samples) of a media column (rec_id, content: a WAV file in each row) at ``rate``; samples
    are null where the content is null or no PCM in WAV, empty where it has no sample."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some, out = b.slice(at, 64), []
                for x in some.column(1).to_pylist():
                    got = decoded(x) if x is not None else None
                    out.append(None if got is None else resampled(*got, rate))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.float64()))], names=["rec_id", "samples"])

    return media.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("content").cast("binary")).mapInArrow(run, "rec_id long, samples array<double>")


def rendered(vectors: DataFrame, note: float = 0.0625, rate: int = RATE) -> DataFrame:
    """(rec_id, samples): a melody for each embedding, as the tables have no recordings. Each
    component is a note whose pitch is its value in steps of 1/24, on four octaves from 110 Hz."""

    def run(batches):
        per = int(note * rate)
        t = np.arange(per) / rate
        tones = np.stack([np.sin(2 * np.pi * 110.0 * 2 ** (p / 12) * t) for p in range(48)]).astype(np.float32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                out = []
                for x in _arrays(some.column(1)):
                    bad = x is None or not np.isfinite(x).all()
                    out.append(None if bad else tones[np.floor(x * 24).astype(np.int64) % 48].reshape(-1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.float32()))], names=["rec_id", "samples"])

    return vectors.select(F.col("vec_id").cast("long").alias("rec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "rec_id long, samples array<float>")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint classes of the melodies of all embeddings; for the classes of those whose id is
    divisible by 50, how many other classes align with them and which aligns best."""
    from lodestone.llm.common import table

    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    members, pairs = matches(fingerprints(rendered(vectors)), vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("rec_id")))
    best = Window.partitionBy("query_class").orderBy("bit_error", F.desc("votes"), "class_id")
    links = pairs.withColumn("n", F.row_number().over(best)).groupBy("query_class").agg(
        F.count(F.lit(1)).alias("n_links"), *[F.max(F.when(F.col("n") == 1, F.col(c))).alias(f"best_{c}") for c in ("class_id", "offset", "votes", "bit_error")]
    )
    of = members.join(links, members["class_id"] == links["query_class"], "left")
    return of.select(
        F.col("rec_id").alias("vec_id"), "class_id", F.floor(F.length("ints") / 4).cast("long").alias("n_ints"), F.crc32("ints").alias("ints_crc32"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_class_id", "best_offset", "best_votes", F.round("best_bit_error", 6).alias("best_bit_error"),
    )
