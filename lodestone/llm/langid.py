"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts. A byte costs its code length in the
longest context that the language knows; a byte new to a context pays that context's escape
probability (method C) and is coded in the next shorter one. The statistics are frozen after
training, so the cost of a byte depends on the few bytes before it alone, and is tabulated for
all languages at once over one forward trie of byte sequences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest sequence: an order-3 context and the byte that follows it.
DEPTH = 4
#: Bytes of training text taken of a language, and of all languages together (both in expectation).
LANGUAGE_BYTES = 4 << 20
SAMPLE_BYTES = 64 << 20
#: Cells of the largest table of the model; rare sequences leave the trees until it fits.
MODEL_CELLS = 1 << 24
#: Bytes of text scored at a time.
BLOCK = 1 << 21

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters become blanks.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PAD = b" " * (DEPTH - 1)


def cleaned(text: str) -> bytes:
    """The bytes that are modelled: lower-cased, runs of ASCII non-letters as one blank."""
    return _PAD + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split())


def _packed(data: np.ndarray) -> np.ndarray:
    """The DEPTH bytes from each place on, as one integer."""
    n = len(data) - DEPTH + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(DEPTH):
        out = (out << 8) | data[i : i + len(out)].astype(np.int64)
    return out


def _counted(batches):
    totals: dict[str, dict] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            grams, n = np.unique(_packed(np.frombuffer(cleaned(text), np.uint8)), return_counts=True)
            totals.setdefault(lang, []).append((grams, n))
    for lang, some in totals.items():
        grams, at = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in some]), len(grams)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


class Model:
    """Cost tables: ``tables[k]`` leads from a sequence of k bytes and a byte to that of k + 1;
    ``costs[k][id]`` is the code length in bits of the last byte of sequence ``id`` of k bytes for
    every language; ``escapes[k][id]`` that of leaving the context ``id`` of k bytes.

    ``cells`` bounds the largest table, so what is broadcast: sequences of two bytes and more that were
    seen fewer times than ``least`` (over all languages) leave the trees, and ``least`` doubles from 1
    until the tables fit. Their contexts then escape to shorter ones, as for unseen sequences."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, cells: int = MODEL_CELLS):
        self.languages = languages
        self.least = 1
        while not self._build(lang, gram, n.astype(np.float64), self.least, cells):
            self.least *= 2

    def _build(self, lang, gram, n, least, cells) -> bool:
        size, L = DEPTH, len(self.languages)
        levels = {}
        keys = np.zeros(0, np.int64)
        for k in range(size, 0, -1):  # a shorter sequence's counts are those of the ways it ends
            ends, at = np.unique(gram & ((1 << 8 * k) - 1), return_inverse=True)
            table = np.zeros((len(ends), L))
            np.add.at(table, (at, lang), n)
            kept = table.sum(axis=1) >= (least if k > 1 else 0)
            # Beginnings and ends of the longer ones belong to the trie, even if nothing was counted.
            keys = np.unique(np.concatenate([ends[kept], keys >> 8, keys & ((1 << 8 * k) - 1)]))
            counts = np.zeros((len(keys), L))
            there = np.isin(ends, keys)
            counts[np.searchsorted(keys, ends[there])] = table[there]
            levels[k] = (keys, counts)
        seen = levels[1][0]
        width = len(seen) + 1
        if max(len(levels[size][0]) * L, (len(levels[size - 1][0]) + 1) * width) > cells and least < 1 << 40:
            return False
        self.classes = np.zeros(256, np.int64)
        self.classes[seen] = np.arange(1, width)
        self.width = width
        self.tables, self.costs, self.escapes = {}, {}, {}
        prefix = {1: (seen, np.arange(1, width))}
        for k in range(2, size + 1):
            keys = levels[k][0]
            before, ids = prefix[k - 1]
            at = np.searchsorted(before, keys >> 8)
            table = np.zeros((len(before) + 1) * width, np.int32)
            fine = (at < len(before)) & (before[np.minimum(at, len(before) - 1)] == keys >> 8)
            table[ids[np.minimum(at, len(before) - 1)][fine] * width + self.classes[keys[fine] & 255]] = np.nonzero(fine)[0] + 1
            self.tables[k] = table
            prefix[k] = (keys, np.arange(1, len(keys) + 1))
        # Context of k bytes: how often it was followed, and by how many different bytes.
        for k in range(0, size):
            keys, table = levels[k + 1]
            own = prefix[k][0] if k else np.zeros(1, np.int64)
            at = np.searchsorted(own, keys >> 8) if k else np.zeros(len(keys), np.int64)
            total, kinds = np.zeros((len(own) + 1, L)), np.zeros((len(own) + 1, L))
            np.add.at(total, at + 1, table)
            np.add.at(kinds, at + 1, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escapes[k] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own_cost = np.where(table > 0, -np.log2(table / (total + kinds)[at + 1]), 0.0)
            if k:
                down_keys = levels[k][0]
                down = self.costs[k][np.searchsorted(down_keys, keys & ((1 << 8 * k) - 1)) + 1]
            else:
                down = np.full((len(keys), L), 8.0)
            cost = np.where(table > 0, own_cost, self.escapes[k][at + 1] + down)
            self.costs[k + 1] = np.concatenate([np.zeros((1, L)), cost]).astype(np.float32)
        self.costs[1][0] = self.escapes[0][1] + 8.0
        for k in self.escapes:
            self.escapes[k] = self.escapes[k].astype(np.float32)
        return True

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each cleaned text for every language."""
        out = np.zeros((len(texts), len(self.languages)))
        held, where = [], []
        size = 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - len(_PAD)), BLOCK):  # long texts in overlapping parts
                part = t[at : at + BLOCK + len(_PAD)]
                held.append(part)
                where.append(i)
                size += len(part)
                if size >= BLOCK:
                    self._add(out, held, where)
                    held, where, size = [], [], 0
        if held:
            self._add(out, held, where)
        return out

    def _add(self, out, held, where) -> None:
        data = self.classes[np.frombuffer(b"".join(held), np.uint8)]
        ids = {1: data}
        for k in range(2, DEPTH + 1):
            ids[k] = self.tables[k][ids[k - 1][:-1] * self.width + data[k - 1 :]].astype(np.int64)
        cost = self.costs[DEPTH][ids[DEPTH]]
        left = np.nonzero(ids[DEPTH] == 0)[0]
        at = 0
        for k in range(DEPTH - 1, 0, -1):  # not known in full: leave the context, code in the next
            if not len(left):
                break
            cost[left] += self.escapes[k][ids[k][left + at]]
            at += 1
            known = ids[k][left + at]
            cost[left] += self.costs[k][known]
            left = left[known == 0]
        lengths = np.array([len(x) for x in held])
        begin = np.cumsum(lengths) - lengths
        fine = lengths > len(_PAD)
        cuts = np.stack([begin[fine], begin[fine] + lengths[fine] - len(_PAD)], axis=1).ravel()
        if len(cuts):
            cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
            np.add.at(out, np.array(where)[fine], np.add.reduceat(cost, np.minimum(cuts, len(cost) - 1), axis=0, dtype=np.float64)[::2])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not told or not self.languages:
            return found
        bits = self.bits([cleaned(texts[i]) for i in told])
        best = bits.argmin(axis=1)
        share = 1.0 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        for i, b, s in zip(told, best, share):
            found[i] = (self.languages[b], float(s))
        return found


def train(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with text and lang.

    The bound: of each language, documents picked by a hash of doc_id whose whole texts amount to
    about ``language_bytes`` (less if all languages together would pass ``sample_bytes``).
    Sequences are counted in Spark; only the counts of that bounded sample reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    names = sorted(r.lang for r in sizes)
    if not names:
        return Model([], *(np.zeros(0, np.int64) for _ in range(3)))
    share = min(language_bytes, sample_bytes // len(names))
    wanted = spark.createDataFrame([(r.lang, min(1.0, share / max(1, r.bytes))) for r in sizes], "lang string, share double")
    picked = docs.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = picked.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    index = {x: i for i, x in enumerate(names)}
    return Model(names, counts["lang"].map(index).to_numpy(np.int64), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def _predicted(sent):
    def run(batches):
        model = sent.value
        for b in batches:
            found = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    lang_pred is the language with the shortest code for the whole text, the first by name if
    several tie; score is its share if code lengths are read as likelihoods. A text that is null
    or has no letter, or any text if nothing was learned, gives ``und`` with score 0. Repeated
    rows are answered each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_predicted(sent), "doc_id long, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 mod 3 is not 1."""
    from lodestone.llm.common import spread, table

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
