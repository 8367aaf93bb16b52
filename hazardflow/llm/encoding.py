"""Token ids of whole texts with a public vocabulary, encoding each distinct piece of text once per worker.

A byte-level vocabulary splits a text before any merge, and never across a single space or line break between
two other characters. Such a text is cut there (plain string splitting), the pieces are looked up in a bounded
cache, and only new pieces go to the tokenizer. Every other text is given to the tokenizer as a whole.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CACHE_ENTRIES = 200_000
BATCH_CHARS = 1_000_000
ID_BYTES = 4


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(other)}


class _Pieces(dict):
    """Ids of pieces as bytes, made when first asked for; None for a piece that must not be cut out of its text.

    A piece is named by its text: with a leading line break as it is, else without its leading space.
    """

    # A line break, Latin letters, and marks without the apostrophe: at most three words, one for each part.
    _PARTS = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, tokenizer):
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = tokenizer.model.tokenize
        self._bytes = [i.to_bytes(ID_BYTES, "little") for i in range(tokenizer.get_vocab_size())]
        self._letters = _alphabet()
        self._marks: dict[str, bytes] = {}
        self._old: dict[str, bytes | None] = {}

    def turn(self) -> None:
        """Begin a new generation; pieces of the one before move on when they are asked for again."""
        self._old = dict(self)
        self.clear()
        self._marks.clear()

    def _ids(self, word: str) -> bytes:
        """Ids of one word in the vocabulary's alphabet."""
        return b"".join([self._bytes[t.id] for t in self._merge(word)])

    def _spelled(self, word: str) -> bytes:
        return self._ids(word.encode("utf-8").decode("latin-1").translate(self._letters))

    def _marked(self, marks: str) -> bytes:
        if marks not in self._marks:
            self._marks[marks] = self._spelled(marks)
        return self._marks[marks]

    def __missing__(self, piece: str) -> bytes | None:
        found = self[piece] = self._old[piece] if piece in self._old else self._made(piece)
        return found

    def _made(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():  # most pieces: one word
            return self._ids("\u0120" + piece)
        if (parts := self._PARTS.fullmatch(piece)) and piece not in ("", "\n"):
            line, word, marks = parts.groups()
            if line:
                return self._marked(line) + (self._spelled(word) if word else b"") + (self._marked(marks) if marks else b"")
            if not word:
                return self._marked(" " + marks)
            return self[word] + self._marked(marks) if marks else self._spelled(" " + word)
        if len(piece.split()) != 1 or piece.strip("\n") != piece.strip():
            return None
        return b"".join([self._ids(w) for w, _ in self._split(piece if piece[0] == "\n" else " " + piece)])


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to encoding each text as a whole."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.model._resize_cache(1)  # the pieces are the cache; the model's own would only cost time
        self._entries = entries
        self._pieces = _Pieces(self._tokenizer)

    def _whole(self, text: str) -> bytes:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, ``ID_BYTES`` each."""
        if len(self._pieces) > self._entries:
            self._pieces.turn()
        out = []
        for text in texts:
            ids = list(map(self._pieces.__getitem__, ("\n" + text.replace("\n", " \n")).split(" ")))
            # The line break put before the text is one id.
            out.append(self._whole(text) if None in ids else b"".join(ids)[ID_BYTES:])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path)


def text_runs(batches: Iterable[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Runs of (doc_id, text) rows of about ``chars`` characters, whatever the size of the Arrow batches."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        begin = size = 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size >= chars or i + 1 == batch.num_rows:
                length = i + 1 - begin
                run = [t or "" for t in texts.slice(begin, length).to_pylist()]
                yield ids.slice(begin, length).to_pylist(), run
                begin, size = i + 1, 0
