"""Token ids of whole texts in a lower-casing vocabulary whose tokens mark the ends of words."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

_SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)
#: Code points from here on, and those without a category, are left to the tokenizers library.
KNOWN = 0x3000
_MODELS: dict[str, "WordEncoder"] = {}


def _kinds() -> np.ndarray:
    kinds = np.full(KNOWN + 1, _OTHER, np.uint8)
    for i in range(KNOWN):
        name = unicodedata.category(chr(i))
        kinds[i] = _LETTER if name[0] == "L" else _NUMBER if name[0] == "N" else _OTHER if name in ("Cn", "Cs", "Co") else _SIGN
    # White space of regular expressions. U+0000 marks the end of a word here.
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = _SPACE
    kinds[0] = _OTHER
    return kinds


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library.

    A word is a run of letters, one digit, a contraction or a run of signs. Words are found for a
    whole text at once by the kinds of its characters; each gets an end mark, a byte that the
    vocabulary's end-of-word suffix becomes, and tiktoken merges them under the same vocabulary.
    Texts with characters out of reach of that (see ``KNOWN``), with special tokens, or that
    Unicode's composition would change are left to tokenizers itself.
    """

    #: The contractions that stand before runs of letters in the word pattern.
    CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kinds = _kinds()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        suffix, vocab = model["model"]["end_of_word_suffix"], model["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + b"\0" * end

        ranks = {raw(t): i for t, i in vocab.items() if t not in special}
        self.ranked = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})

    def _marked(self, text: str) -> str | None:
        """Words without the white space between them, U+0000 after each; None if this way can't tell."""
        if "<|" in text or "Σ" in text:
            return None
        low = text.lower()
        if not text.isascii() and not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return None
        try:
            code, points = "latin-1", np.frombuffer(low.encode("latin-1"), np.uint8)
            kinds = self.kinds[points]
        except UnicodeEncodeError:
            code, points = "utf-32-le", np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = self.kinds[np.minimum(points, KNOWN)]
        if (kinds == _OTHER).any():
            return None
        ends = np.empty(len(points), bool)
        ends[-1:] = True
        np.not_equal(kinds[:-1], kinds[1:], out=ends[:-1])
        ends[:-1] |= kinds[:-1] == _NUMBER
        if "'" in low:
            for found in self.CONTRACTION.finditer(low):
                at, end = found.span()
                if at == 0 or kinds[at - 1] != _SIGN:
                    ends[at : end - 1] = False
                    ends[end - 1] = True
        # Two places for each character, its own and that of a mark behind it; those in use stay.
        wide, used = np.zeros((len(points), 2), points.dtype), np.empty((len(points), 2), bool)
        wide[:, 0], used[:, 0] = points, kinds != _SPACE
        np.logical_and(ends, used[:, 0], out=used[:, 1])
        return wide[used].tobytes().decode(code)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            marked = self._marked(text)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids if marked is None else self.ranked.encode_ordinary(marked) if marked else []
            out.append(array("I", ids).tobytes())
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _MODELS:
        _MODELS[path] = WordEncoder(path)
    return _MODELS[path]
