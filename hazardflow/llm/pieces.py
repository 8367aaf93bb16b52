"""Token ids of whole texts by a sentencepiece model, encoding each distinct chunk of text once per worker.

Where no piece of the vocabulary holds a space mark behind another character, merges never cross from a word into
the space before the next one, so a text is the sequence of its chunks (spaces and the word behind them). Chunks are
looked up in a bounded cache of two generations and all new ones of a run go to the model in one call. A model for
which this does not hold (or that rewrites white space or letters) is given whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from array import array

CACHE_ENTRIES = 150_000
# Longer chunks are encoded each time, which bounds the cache in bytes.
LONGEST_CACHED = 64
MARK = "▁"
# Letters, marks and white space that compatibility normalisation would change.
_PROBE = "  a 　b\t\n c ﬁ Ａ é ẛ̣ ½\r​ "


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to encoding each text as a whole."""

    _CHUNKS = re.compile(" +[^ ]+| +$")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self._entries = entries
        crossing = re.compile(f"[^{MARK}]{MARK}")
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.separable = (
            not any(map(crossing.search, pieces))
            and self.model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
            and self.model.piece_to_id(MARK) != self.model.unk_id()
        )
        self._old: dict[str, bytes] = {}
        self._young: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _chunks(self, text: str) -> list[str]:
        """Chunks without their first space; the model puts one before the text, so an empty chunk is a lone mark."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            return [c[1:] for c in self._CHUNKS.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, four each."""
        if not self.separable:
            return self._ids(texts)
        if len(self._young) > self._entries:
            self._old, self._young = self._young, {}
        chunks = [self._chunks(t) for t in texts]
        new = set(itertools.chain.from_iterable(chunks)).difference(self._young)
        known = {c: self._old[c] for c in new if c in self._old}
        self._young.update(known)
        made = [c for c in new.difference(known) if c]
        found = dict(zip(made, self._ids(made)))
        found[""] = array("I", [self.model.piece_to_id(MARK)]).tobytes()
        self._young.update(found)
        out = [b"".join(map(self._young.__getitem__, cs)) for cs in chunks]
        for chunk in made:
            if len(chunk) > LONGEST_CACHED:
                del self._young[chunk]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and model."""
    return ChunkEncoder(path)


def file_digest(path: str) -> str:
    """Digest of a vocabulary file, which names its version."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
