"""Byte-level BPE over a whole corpus, encoding each distinct word once.

1. Texts are split into words (pre-tokens) by the vocabulary's pattern, in chunks of bounded size. A chunk keeps, per document,
   the positions of its words in the chunk's own word list; its distinct words are dealt out to ``BUCKETS`` buckets by hash.
2. A global shuffle brings equal words of all chunks together: each bucket encodes each of its distinct words once.
3. The ids return to the chunks by a second shuffle and replace the positions, in order.

The lists travel as compressed blobs, one per chunk and bucket. What a chunk keeps lies in a file of the shared folder,
named by a table that is written before the shuffle, so that a task that runs again meets the same chunks.
Decoding joins ids with the table of token bytes by position; the table has one row per vocabulary entry.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from hazardflow.llm.encoding import text_runs, vocabulary
from hazardflow.llm.storage import stored
from hazardflow.session import shared_dir

# White space that does not stand alone between two other characters, or that is neither a space nor a line break.
_IRREGULAR = re.compile(r"\s\s|[^\S \n]")
BUCKETS = 512
CHUNK_CHARS = 8_000_000


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Merges the bytes of one word by rank."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding(
        "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={}
    )
    return encoding._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: entry i holds the bytes of id i."""
    known = {rank: token for token, rank in ranks(path).items()}
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())


def decoded(ids: np.ndarray, path: str) -> memoryview:
    """Bytes of a sequence of ids: a positional join with the token-byte table, whose values lie end to end."""
    taken = token_bytes(path).take(pa.array(ids, pa.int64()))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2])[int(ends[0]) : int(ends[-1])] if len(ids) else memoryview(b"")


@functools.lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def positions(texts: list[str]) -> tuple[list[str], list[bytes]]:
    """Distinct words of the texts, and each text as positions in that list (unsigned 32-bit numbers).

    Most texts are cut at single spaces and line breaks, where no word can span, and only distinct pieces are matched.
    """
    words: dict[str, int] = {}

    def placed(text: str) -> bytes:
        return np.array([words.setdefault(w, len(words)) for w in pattern().findall(text)], dtype="<u4").tobytes()

    pieces: dict[str, bytes] = {}
    out = []
    for text in texts:
        if _IRREGULAR.search(text):
            out.append(placed(text))
            continue
        own = ("\n" + text.replace("\n", " \n")).split(" ")
        for p in own:
            if p not in pieces:
                pieces[p] = placed(p if p[:1] == "\n" else " " + p)
        out.append(b"".join(map(pieces.__getitem__, own))[4:])  # without the line break put before the text
    return list(words), out


def _packed(arrays: list[bytes]) -> bytes:
    """Byte strings as one compressed blob: their lengths, then the strings."""
    lengths = np.array([len(a) for a in arrays], dtype="<u4").tobytes()
    data = b"".join([len(arrays).to_bytes(4, "little"), lengths, *arrays])
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[bytes]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, dtype="<u4", count=n, offset=4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with bytes of one weight side by side, which compresses better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def word_lists(docs: DataFrame, folder: str) -> DataFrame:
    """``chunk, bucket, words``: each chunk's distinct words by bucket; the rest of the chunk goes to a file in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for ids, texts in text_runs(batches, CHUNK_CHARS):
            words, placed = positions(texts)
            # Frequent words get small numbers, which compress well.
            flat = np.frombuffer(b"".join(placed), dtype="<u4")
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number = np.empty(len(words), dtype="<u4")
            number[order] = np.arange(len(words))
            encoded = [words[i].encode("utf-8", "surrogatepass") for i in order]
            bucket = np.array([zlib.crc32(w) % BUCKETS for w in encoded], dtype="<u2")
            chunk = uuid.uuid4().hex
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            kept = [
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(), known.tobytes(),
                np.array([len(p) // 4 for p in placed], dtype="<i8").tobytes(), bucket.tobytes(), _planes(number[flat]),
            ]
            with fs.open_output_stream(f"{root}/{chunk}") as out:
                out.write(_packed(kept))
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
            rows = [
                (b, _packed([encoded[i] for i in by_bucket[edges[b] : edges[b + 1]]]))
                for b in range(BUCKETS)
                if edges[b] < edges[b + 1] or b == 0  # a chunk without words still has a row
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), pa.array([w for _, w in rows])],
                ["chunk", "bucket", "words"],
            )

    return docs.mapInArrow(run, "chunk string, bucket int, words binary")


def word_ids(lists: DataFrame, path: str) -> DataFrame:
    """``chunk, bucket, ids``: the ids of every word of a list, each distinct word encoded once in its bucket."""
    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, here, known = word_encoder(path), None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != here:
                    here, known = bucket, {}
                words = _unpacked(blob)
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w), dtype="<u4").tobytes()
                out.append(_packed([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("bucket"), pa.array(out, pa.binary())], ["chunk", "bucket", "ids"]
            )

    return dealt.mapInArrow(run, "chunk string, bucket int, ids binary")


def _ids_by_position(kept: list[bytes], lists: dict[int, list[bytes]]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's ids: every position replaced by the ids of the word there."""
    doc, known, sizes = np.frombuffer(kept[0], "<i8"), np.frombuffer(kept[1], np.uint8), np.frombuffer(kept[2], "<i8")
    bucket, place = np.frombuffer(kept[3], "<u2"), _from_planes(kept[4])
    rest = {b: iter(words) for b, words in lists.items()}
    words = [next(rest[b]) for b in bucket.tolist()]
    flat = np.frombuffer(b"".join(words), dtype="<u4")
    count = np.array([len(w) // 4 for w in words], dtype=np.int64)
    first = np.cumsum(count) - count
    at = 0
    for d, k, n in zip(doc.tolist(), known.tolist(), sizes.tolist()):
        own = place[at : at + n]
        at += n
        c = count[own]
        # Running index into the flat ids: a word's first id, then one further for each.
        shift = np.repeat(first[own] - (np.cumsum(c) - c), c)
        yield (d if k else None), flat[shift + np.arange(len(shift))]


def _joined(docs: DataFrame, path: str, schema: str, finish: Callable[[list], list[pa.Array]]) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "bpe-chunks")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    lists = stored(word_lists(docs, folder), "bpe-words")
    dealt = word_ids(lists, path).repartition("chunk").sortWithinPartitions("chunk")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        here, lists = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            kept = _unpacked(fs.open_input_stream(f"{root}/{here}").read())
            some, size = [], 0
            for row in _ids_by_position(kept, lists):
                some.append(row)
                size += len(row[1])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays(finish(some), names)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays(finish(some), names)

        for batch in batches:
            for chunk, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "ids"))):
                if chunk != here:
                    if here is not None:
                        yield from out()
                    here, lists = chunk, {}
                lists[bucket] = _unpacked(blob)
        if here is not None:
            yield from out()

    return dealt.mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, ids`` for every document: ids of the whole text as little-endian unsigned 32-bit numbers.

    A null text is an empty one and has no ids. Repeated rows are encoded row by row, a null id stays null.
    """

    def finish(rows: list) -> list[pa.Array]:
        return [pa.array([d for d, _ in rows], pa.int64()), pa.array([i.tobytes() for _, i in rows], pa.binary())]

    return _joined(_texts(docs, id_col, text_col), vocabulary(vocab), "doc_id long, ids binary", finish)


def decode(encoded: DataFrame, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids`` (as ``encode`` gives them); null ids give null bytes."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            back = [None if i is None else bytes(decoded(np.frombuffer(i, dtype="<u4"), path)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encoding and decoding in one: number of ids, SHA-256 of the ids and of the bytes they decode to."""
    path = vocabulary(vocab)

    def finish(rows: list) -> list[pa.Array]:
        return [
            pa.array([d for d, _ in rows], pa.int64()), pa.array([len(i) for _, i in rows], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for _, i in rows]),
            pa.array([hashlib.sha256(decoded(i, path)).hexdigest() for _, i in rows]),
        ]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _joined(_texts(docs, id_col, text_col), path, schema, finish)
