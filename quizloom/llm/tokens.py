"""Token ids by the tokenizers library, with a bounded cache of the pieces between white space.

Byte-level BPE with the usual pre-tokenizer never joins a character with the white space after it, so a text may be cut
before each space or line end that follows another character: the ids of the pieces, one after the other, are the ids of
the text. Most pieces of a corpus are repeated, so each is encoded once while the cache holds it. The ids are those of the
tokenizer as its file has it, without special tokens added; a mark such as the end of a text, written out in a text, is its
own token there.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa

END = b"\0\0\0\0"
TOKENIZER = "byte_bpe_50k.json"
#: Some 80 MB in each Python worker, which keeps them from task to task.
CACHE_PIECES = 400_000
LONGEST = 64
#: A word, perhaps after a line end, and the marks after it: parts that the pre-tokenizer always keeps apart.
_SIMPLE = re.compile(r"(\n?)([^\W\d_]+)([^\w\s]*)")
_ENCODERS: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    """A path as given, or the file of that name among the public tokenizers, looked up where the task runs."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next above 255."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder(dict):
    """By piece, without the space that leads it: its ids as bytes; None for those that need their neighbours."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of these marks are encoded as a whole: the tokenizer takes them out before it cuts words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.newline = self.ids(["\n"])[0]
        self.marks: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        coded = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.word(coded)]).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if piece.isalpha():
            found = self._word(" " + piece)
        elif not piece or piece[-1].isspace():
            found = None
        elif (m := _SIMPLE.fullmatch(piece)) and m[2].isalpha():
            begin = self.newline + self._word(m[2]) if m[1] else self[m[2]]
            found = begin + self._mark(m[3]) if m[3] else begin
        else:
            found = self.ids([piece if piece[0] == "\n" else " " + piece])[0]
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self.ids([mark])[0]
        return self.marks[mark]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self) > CACHE_PIECES:
            self.clear()
        get, out = self.__getitem__, []
        for text in texts.to_pylist():
            if text and any(mark in text for mark in self.added):
                out.append(self.ids([text])[0])
                continue
            first, *pieces = (text or "").replace("\n", " \n").split(" ")
            if first and first[-1].isspace():
                out.append(self._merged(text))
                continue
            try:
                out.append(b"".join([self.ids([first])[0] if first else b"", *map(get, pieces)]))
            except TypeError:  # a piece that needs its neighbours
                out.append(self._merged(text))
        return out

    def _merged(self, text: str) -> bytes:
        """For texts with runs of white space: pieces that end in white space go with the next."""
        units, held = [], ""
        first, *others = text.replace("\n", " \n").split(" ")
        for p in [first, *[p if p[:1] == "\n" else " " + p for p in others]]:
            held += p
            if held and not held[-1].isspace():
                units.append(held)
                held = ""
        if held:
            units.append(held)
        known = [self[u[1:]] if k and u[0] == " " and u[1:2].strip() else None for k, u in enumerate(units)]
        return b"".join([self.ids([u])[0] if k is None else k for u, k in zip(units, known, strict=True)])


def encoder(name: str) -> PieceEncoder:
    """One encoder for each tokenizer and Python worker; its cache outlives the task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(tokenizer_path(name))
    return _ENCODERS[name]


def encode_column(name: str, column: pa.Array) -> list[bytes]:
    """Ids of each row, with the end id 0 after them."""
    return [x + END for x in encoder(name).encode(column)]


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
