"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The piece lattice of a text has an edge for every piece that stands somewhere in it. A forward
Viterbi pass gives the best score of every prefix; those scores are the exact remaining cost of a
backward A* search, which so yields the segmentations in the order of their scores. No piece
reaches over the start of a run of blanks, so the lattice of a text is a chain of the lattices of
its chunks, whose results are kept, and the n best of the whole follow from those of the n - 1
chunks whose second choice costs least.
"""

from __future__ import annotations

import heapq
import re
import string
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_BEST = 4
#: Below the worst piece by this much: a character that no piece covers, coded by its bytes.
UNKNOWN_PENALTY = 10.0
#: Entries of a generation of the chunk caches of a Python worker.
CACHE = 250_000
BLANK = "▁"
_MODELS: dict[str, "Segmenter"] = {}


class Segmenter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.first_plain = max([i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)], default=-1) + 1
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: By character: [children, score or None, id] of the pieces and their beginnings.
        self.trie: dict[str, list] = {}
        for i in plain:
            children, node = self.trie, None
            for c in self.pieces[i]:
                node = children.setdefault(c, [{}, None, 0])
                children = node[0]
            node[1:] = sp.get_score(i), i
        self.longest = max((len(self.pieces[i]) for i in plain), default=1)
        self.missing = min((s for s in map(sp.get_score, plain) if s > -1e6), default=0.0) - UNKNOWN_PENALTY
        self.chained = not any(BLANK in self.pieces[i].lstrip(BLANK) for i in plain)
        # Signs that no piece has after a letter: a lattice also falls apart between the two.
        joined = {b for i in plain for a, b in zip(self.pieces[i], self.pieces[i][1:]) if a.isalpha()}
        signs = re.escape("".join(c for c in string.punctuation + "\n" if c not in joined))
        self.chunk = re.compile(f"{BLANK}*[^\\W\\d_]+(?=[{signs}{BLANK}]|$)|{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.texts = [p.replace(BLANK, " ") for p in self.pieces]
        self.raw = [bytes([self.bytes_of[i]]) if i in self.bytes_of else x.encode("utf-8", "surrogatepass") for i, x in enumerate(self.texts)]
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.lists: dict[str, list] = {}

    def chunks(self, text: str) -> list[str]:
        """The text as the lattices see it: a blank is put before it, blanks become U+2581."""
        if not text:
            return []
        shown = BLANK + text.replace(" ", BLANK)
        return self.chunk.findall(shown) if self.chained else [shown]

    def _edges(self, chunk: str, at: int):
        """(end, score, id) of the pieces that start at a place; id is None for a character in bytes."""
        children, single = self.trie, False
        for end in range(at + 1, len(chunk) + 1):
            got = children.get(chunk[end - 1])
            if got is None:
                break
            children = got[0]
            if got[1] is not None:
                single = single or end == at + 1
                yield end, got[1], got[2]
        if not single:
            yield at + 1, self.missing, None

    def _forward(self, chunk: str):
        """Best and second-best score of every prefix, and the last edge of the best."""
        n = len(chunk)
        low = float("-inf")
        best, second, last = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        trie, missing, longest = self.trie, self.missing, self.longest
        for at in range(n):
            b, s, single, children, end = best[at], second[at], False, trie, at
            for c in chunk[at : at + longest]:
                got = children.get(c)
                if got is None:
                    break
                end += 1
                children, score, i = got
                if score is None:
                    continue
                if end == at + 1:
                    single = True
                x = b + score
                if x > best[end]:
                    y = s + score
                    second[end] = best[end] if best[end] > y else y
                    best[end], last[end] = x, (at, i)
                elif x > second[end]:
                    second[end] = x
            if not single:
                x, end = b + missing, at + 1
                if x > best[end]:
                    y = s + missing
                    second[end] = best[end] if best[end] > y else y
                    best[end], last[end] = x, (at, None)
                elif x > second[end]:
                    second[end] = x
        return best, second, last

    def _ids(self, chunk: str, path: list[tuple[int, int, int | None]]) -> bytes:
        ids = array("I")
        for at, end, i in path:
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_ids.get(b, self.unknown) for b in chunk[at:end].encode("utf-8", "surrogatepass"))
        return ids.tobytes()

    def chunk_best(self, chunk: str) -> tuple[float, float, bytes]:
        """(best score, what the second choice costs more, ids of the best) of one chunk."""
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                best, second, last = self._forward(chunk)
                path, end = [], len(chunk)
                while end:
                    at, i = last[end]
                    path.append((at, end, i))
                    end = at
                got = (best[-1], best[-1] - second[-1], self._ids(chunk, path[::-1]))
            if len(chunk) <= 64:
                self.young[chunk] = got
                if len(self.young) > CACHE:
                    self.old, self.young = self.young, {}
        return got

    def chunk_list(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations (score, ids) of one chunk, by backward A* search.

        A hypothesis covers the chunk from some place to its end; its priority is the exact
        score of the best whole segmentation that ends so. Ties go to what is nearest the start, so
        equal paths are not walked side by side, and no place is left more than ``n`` times, as
        its first n hypotheses already stand for n segmentations that are as good: the work is at
        most n times the lattice, whatever the text.
        """
        got = self.lists.get(chunk)
        if got is not None and (len(got) >= n or getattr(got, "all", False)):
            return got[:n]
        best, _, _ = self._forward(chunk)
        into: list[list] = [[] for _ in range(len(chunk) + 1)]
        for at in range(len(chunk)):
            for end, score, i in self._edges(chunk, at):
                into[end].append((at, score, i))
        heap, order, found, visits = [(-best[-1], len(chunk), 0, 0.0, None)], 1, [], [0] * (len(chunk) + 1)
        while heap and len(found) < n:
            _, place, _, tail, path = heapq.heappop(heap)
            if visits[place] == n:
                continue
            visits[place] += 1
            if place == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                found.append((tail, self._ids(chunk, steps)))
                continue
            for at, score, i in into[place]:
                if visits[at] < n:
                    heapq.heappush(heap, (-(best[at] + score + tail), at, order, score + tail, ((at, place, i), path)))
                    order += 1
        if len(self.lists) > CACHE // 8:
            self.lists.clear()
        if len(chunk) <= 64:
            self.lists[chunk] = found
        return found

    def nbest(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text: (score, ids as unsigned 32-bit bytes), best
        first; fewer if there are no more; one without pieces for a null or empty text."""
        chunks = self.chunks(text or "")
        firsts, i = list(map(self.young.get, chunks)), -1
        for _ in range(firsts.count(None)):
            i = firsts.index(None, i + 1)
            firsts[i] = self.chunk_best(chunks[i])
        scores, costs, pieces = zip(*firsts) if firsts else ((), (), ())
        total = float(sum(scores))
        results: list[tuple[float, dict]] = [(0.0, {})]
        for at in sorted(heapq.nsmallest(n - 1, range(len(costs)), key=costs.__getitem__)):
            some = self.chunk_list(chunks[at], n)
            merged = [(cost + some[0][0] - s, r | {at: ids} if k else r) for cost, r in results for k, (s, ids) in enumerate(some)]
            results = sorted(merged, key=lambda x: x[0])[:n]
        whole = b"".join(pieces)
        ends = [0, *accumulate(map(len, pieces))] if len(results) > 1 else []
        out = []
        for cost, changed in results:
            parts, at = [], 0
            for i in sorted(changed):
                parts += [whole[at : ends[i]], changed[i]]
                at = ends[i + 1]
            out.append((total - cost, b"".join([*parts, whole[at:]]) if changed else whole))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids: pieces joined, bytes decoded, without the blank put before it."""
        seq = array("I")
        seq.frombytes(ids)
        if not seq:
            return ""
        if min(seq) >= self.first_plain:
            return "".join(map(self.texts.__getitem__, seq))[1:]
        return b"".join(map(self.raw.__getitem__, seq)).decode("utf-8", "replace")[1:]


def segmenter(path: str) -> Segmenter:
    if path not in _MODELS:
        _MODELS[path] = Segmenter(path)
    return _MODELS[path]


_FOUND = "doc_id long, segmentations array<struct<score:double,ids:binary>>, text string"


def _segmented(path, n):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))

    def run(batches):
        model = segmenter(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                found = [model.nbest(x, n) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([[{"score": s, "ids": i} for s, i in x] for x in found], kind), pa.array([model.decode(x[0][1]) for x in found], pa.string())],
                    names=["doc_id", "segmentations", "text"],
                )

    return run


def segment(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """(doc_id, segmentations, text) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``segmentations`` has the ``n`` best (score, ids as little-endian unsigned 32-bit), best
    first; ``text`` is the decoded best one. Texts of any length are segmented whole, in time and memory that
    grow with ``n`` times their longest run without a chunk boundary. A null or empty text has one segmentation without
    pieces, of score 0; repeated rows are answered each; an empty table gives an empty result.
    A U+2581 in a text decodes as a blank, which the vocabulary writes so.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_segmented(model, n), _FOUND)


def _digest(path, n):
    def run(batches):
        model = segmenter(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                texts = some.column(1).to_pylist()
                found = [model.nbest(x, n) for x in texts]
                back = [(x or "").replace(BLANK, " ") == model.decode(f[0][1]) for x, f in zip(texts, found)]
                cols = [
                    some.column(0), pa.array([len(f[0][1]) // 4 for f in found], pa.int64()), pa.array([zlib.crc32(f[0][1]) for f in found], pa.int64()),
                    pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())), pa.array([zlib.crc32(b"".join(i for _, i in f)) for f in found], pa.int64()), pa.array(back, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_crc32", "scores", "nbest_crc32", "round_trip"])

    return run


def digest(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """What segment() finds, without the ids: counts, check sums, the n scores and whether the
    best segmentation decodes to the text. Edge cases as there."""
    kind = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, nbest_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_digest(model, n), kind)


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document in the 32k piece vocabulary, as digests."""
    import public_tokenizers

    from lodestone.llm.common import spread, table

    found = digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("scores", F.array_join(F.transform("scores", lambda x: x.cast("decimal(20,3)").cast("string")), ","))
