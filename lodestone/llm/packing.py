"""Packing of tokenised documents into fixed windows by sum-of-squares online placement."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 1024
#: Partially filled windows that a task holds at most, which bounds its memory; then they are settled.
MAX_OPEN = 4096
#: The one special token of the vocabulary, which the tokenizer finds in texts.
SPECIAL = "<|endoftext|>"
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives
    them. The special token, which that library finds in texts, cuts a text; between, tiktoken
    merges over the same vocabulary in half the time."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = np.uint32(self.tokenizer.token_to_id(SPECIAL)).tobytes() if self.tokenizer.token_to_id(SPECIAL) is not None else None
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary and merges in tiktoken; None if the merges of the file are not in the
        order of their ids."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merged = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            return [array("I", e.ids).tobytes() for e in run(texts, add_special_tokens=False)]
        run = self.ranked.encode_ordinary
        ids = lambda text: array("I", run(text)).tobytes() if text else b""
        return [self.special.join(map(ids, x.split(SPECIAL))) if self.special is not None and SPECIAL in x else ids(x) for x in texts]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Sum-of-squares packing of pieces (doc_id, start, doc_tokens, id bytes) of up to ``window`` ids.

    ``levels[h]`` counts the partially filled windows that hold h ids. A piece goes where the sum
    of the squared counts afterwards is least (a new window is level 0); ties take the fullest.
    ``moved`` counts the ids that ``settle`` took out of the window the rule had put them in.
    """

    def __init__(self, window: int, first_id: int, max_open: int):
        self.window, self.next, self.max_open = window, first_id, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.stacks: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = self.moved = 0
        self.rows: list[tuple] = []

    def add(self, piece) -> None:
        size = len(piece[3]) // 4
        if size == self.window:
            self._emit([piece])
            return
        n, top = self.levels, self.window - size
        # Change of the sum if a window leaves level h (1 - 2n) and enters h + size (1 + 2n).
        change = 2 * n[size:] - 2 * n[: top + 1] + 2
        change[0] = 2 * n[size] + 1
        change[top] -= 2 * n[self.window] + 1  # a full window is no longer counted
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(change[::-1]))
        held = self.stacks[h].pop() if h else []
        held.append(piece)
        if h:
            n[h] -= 1
            self.open -= 1
        if h + size == self.window:
            self._emit(held)
            return
        n[h + size] += 1
        self.stacks[h + size].append(held)
        self.open += 1
        if self.open >= self.max_open:
            self.settle()

    def settle(self) -> None:
        """Closes all open windows without padding: the fullest are filled up from the emptiest, whose
        pieces move as they are or are cut where a window is full. Only the very last window is cut
        into sequences whose lengths are powers of two. All other pieces stay where the rule put them."""
        windows = [held for h in range(self.window, 0, -1) for held in self.stacks[h]]
        fills = [h for h in range(self.window, 0, -1) for _ in self.stacks[h]]
        self.levels[:] = 0
        self.stacks = [[] for _ in range(self.window + 1)]
        self.open = 0
        low, high = 0, len(windows) - 1
        while low < high:
            room = self.window - fills[low]
            doc_id, start, total, ids = windows[high].pop()
            take = min(room, len(ids) // 4)
            windows[low].append((doc_id, start, total, ids[: 4 * take]))
            if 4 * take < len(ids):
                windows[high].append((doc_id, start + take, total, ids[4 * take :]))
            fills[low] += take
            fills[high] -= take
            self.moved += take
            if fills[low] == self.window:
                self._emit(windows[low])
                low += 1
            if low < high and not fills[high]:
                high -= 1
        if low == high and fills[low]:
            self._in_powers(windows[low], fills[low])

    def _in_powers(self, pieces, left: int) -> None:
        room, held = 1 << (left.bit_length() - 1), []
        for doc_id, start, total, ids in pieces:
            while ids:
                cut = min(room, len(ids) // 4)
                held.append((doc_id, start, total, ids[: 4 * cut]))
                ids, start, room, left = ids[4 * cut :], start + cut, room - cut, left - cut
                if not room:
                    self._emit(held)
                    room, held = 1 << max(0, left.bit_length() - 1), []

    def _emit(self, held) -> None:
        offset = 0
        for doc_id, start, total, ids in held:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1


def _packed(path: str, window: int, max_open: int):
    names = [x.split()[0] for x in COLUMNS.split(",")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    def run(batches):
        enc = encoder(path)
        packer = Packer(window, TaskContext.get().partitionId() << 36, max_open)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, texts = (b.column(i).slice(at, 256).to_pylist() for i in range(2))
                for doc_id, got in zip(ids, enc.encode([x or "" for x in texts])):
                    got += b"\0\0\0\0"
                    total = len(got) // 4
                    for start in range(0, total, window):
                        packer.add((doc_id, start, total, got[4 * start : 4 * (start + window)]))
                if len(packer.rows) > 20_000:
                    yield batch(packer.rows)
                    packer.rows = []
        packer.settle()
        yield batch(packer.rows)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """Packs every document (doc_id, text; other columns are ignored) into windows of ``window`` ids.

    A document's ids are those of the tokenizer file ``tokenizer`` without special tokens added,
    then id 0; a null or empty text is id 0 alone. Documents longer than a window are cut into
    full windows, and the rest is placed online by the sum-of-squares rule. Each task packs the
    documents of its own partition in their order, without a shuffle; windows that are open at its
    end (or once ``max_open`` are, which bounds memory) are filled up from the emptiest of them, and
    the last one is cut in powers of two, so that nothing is padded. Texts of any length are read
    whole. Rows of one doc_id are separate documents if the table repeats it, and those without one
    are packed too; an empty table gives an empty result. One row per piece: see COLUMNS.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packed(tokenizer, window, max_open), COLUMNS)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 ids of the 50k byte-level vocabulary."""
    import public_tokenizers

    from lodestone.llm.common import spread, table

    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))
