"""Alignment of two tokenizers over the same texts, in Arrow arrays.

A is a byte-level vocabulary applied to a space and the text, B a sentencepiece model, which puts the space itself.
Ids of a run of documents are flat list arrays; lengths in bytes are looked up, added up inside documents, and tokens
of A and B that end together meet in a hash join on (document, end). These ends cut both sequences into groups.
Pairs of ids that end together are counted per task and added up by Spark.

Two tokens that end together are suffixes of one another, so the number of different pairs is bounded by the two
vocabularies (``possible_pairs``), whatever the corpus: the table of counts may go to every task.

Odd rows: a text that is null or empty, or whose tokens do not spell the space and the text in both vocabularies (one that
holds U+2581 itself, for instance), has no tokens: zeros and an empty digest. A null id stays null; repeated rows
each come back and each count; an empty table gives an empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from hazardflow.llm import encoding, pieces
from hazardflow.llm.storage import stored

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RUN_CHARS = 400_000
# A document-end key has the document of the run above these bits, the end in bytes below.
END_BITS = 40
# Links that are joined or counted at a time, whatever the size of the Arrow batches.
RUN_LINKS = 1_000_000


def _byte_bytes(path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary; special entries stand for their own text."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    other = encoding._alphabet()
    byte = {other.get(b, chr(b)): b for b in range(256)}
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def _byte_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes a space and each text to little-endian unsigned 32-bit ids.

    Where the file's merges make entries in the order of their ids, the ids are ranks, and the rank encoder gives the same
    ids several times faster than the library of the file; otherwise that library does it.
    """
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, split = given["model"], given["pre_tokenizer"] or {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][m] for m in merged]
    plain = not given["normalizer"] and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    special = {t["id"] for t in given["added_tokens"]}
    if not (plain and level and all(i < j for i, j in zip(made, made[1:])) and len(made) + 256 + len(special) == len(_byte_bytes(path))):
        whole = encoding.encoder(path)._whole
        return lambda texts: [whole(" " + t) for t in texts]
    import public_tokenizers
    import tiktoken

    ranks = {entry: i for i, entry in enumerate(_byte_bytes(path)) if i not in special}
    ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [ranked.encode_to_numpy(" " + t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]


class Vocabularies:
    """Bytes of every entry of A and B, as Arrow arrays by id, and the encoders of both."""

    def __init__(self, a_path: str, b_path: str):
        self.encode_a = _byte_encoder(a_path)
        piece_encoder = pieces.encoder(b_path)
        self.encode_b = piece_encoder.encode
        self.a = pa.array(_byte_bytes(a_path), pa.large_binary())
        self.b = pa.array(self._spelled(piece_encoder.model), pa.large_binary())
        self.a_length, self.b_length = pc.binary_length(self.a), pc.binary_length(self.b)
        largest = max(len(self.a), len(self.b))
        # Decimal ids with each separator: id * 3 is followed by a comma, + 1 by a bar, + 2 by a semicolon.
        self.numbers = pa.array([f"{i}{sep}" for i in range(largest) for sep in ",|;"], pa.large_string())

    @staticmethod
    def _spelled(model) -> list[bytes]:
        return [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(pieces.MARK, " ").encode()
            for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]

    def possible_pairs(self) -> int:
        """Number of (A, B) entries of which one is a suffix of the other: no corpus has more different pairs."""
        a, b = self.a.to_pylist(), self.b.to_pylist()
        times_a, times_b = {}, {}
        for times, entries in ((times_a, a), (times_b, b)):
            for e in entries:
                times[e] = times.get(e, 0) + 1
        longer_a = sum(times_b.get(e[i:], 0) for e in a for i in range(len(e)))
        return longer_a + sum(times_a.get(e[i:], 0) for e in b for i in range(1, len(e)))


@functools.lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Both vocabularies, once per worker process."""
    return Vocabularies(a_path, b_path)


def _lists(encoded: list[bytes]) -> pa.LargeListArray:
    """Ids of documents as one list array."""
    offsets = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(e) // encoding.ID_BYTES for e in encoded], out=offsets[1:])
    flat = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _spells(ids: pa.LargeListArray, entries: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether the entries of each document's ids, joined, are the wanted bytes."""
    joined = entries.take(ids.flatten())
    at = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(joined) + 1)[np.asarray(ids.offsets)]
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    return np.array([data[at[i] : at[i + 1]] == w for i, w in enumerate(wanted)], dtype=bool)


def _ends(ids: pa.LargeListArray, lengths: pa.Array, place: str) -> tuple[pa.Table, np.ndarray]:
    """The document-end key and position of every token, and the first position of every document."""
    flat, doc = ids.flatten(), np.asarray(pc.list_parent_indices(ids))
    total = np.asarray(pc.cumulative_sum(pc.cast(lengths.take(flat), pa.int64())))
    first = np.asarray(ids.offsets)
    before = np.concatenate([[0], total])[first[:-1]]  # bytes of all documents before each
    key = (doc << END_BITS) + total - before[doc]
    return pa.table({"key": key, place: np.arange(len(flat), dtype=np.int32)}), first


class Aligned:
    """Groups and links of a run of documents that all spell their texts."""

    def __init__(self, ids_a: pa.LargeListArray, ids_b: pa.LargeListArray, own: Vocabularies):
        a, first_a = _ends(ids_a, own.a_length, "at_a")
        b, first_b = _ends(ids_b, own.b_length, "at_b")
        links = a.join(b, keys="key", join_type="inner", use_threads=False)
        # Ends grow strictly inside a document, so positions in A order the links, and each link ends one group.
        order = np.argsort(np.asarray(links["at_a"]))
        at_a, at_b = np.asarray(links["at_a"])[order].astype(np.int64), np.asarray(links["at_b"])[order].astype(np.int64)
        id_a, id_b = np.asarray(ids_a.flatten()), np.asarray(ids_b.flatten())
        self.n_a, self.n_b = np.diff(first_a), np.diff(first_b)
        self.doc = np.asarray(links["key"])[order] >> END_BITS
        self.n_links = np.bincount(self.doc, minlength=len(ids_a))
        self.pairs = id_a[at_a] * len(own.b) + id_b[at_b]
        self.digests = self._digests(id_a, id_b, at_a, at_b, first_a + first_b, own)

    @staticmethod
    def _digests(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, first: np.ndarray, own: Vocabularies) -> list[str]:
        """Digest of each document's groups, written out as decimal ids with separators.

        The written form of all documents is one string array in reading order, so its bytes are already joined.
        """
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[at_a] = last_b[at_b] = 1
        groups_a, groups_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(a)) + np.concatenate([[0], at_b + 1])[groups_a]  # after B's tokens of earlier groups
        place_b = np.arange(len(b)) + (at_a + 1)[groups_b]  # after A's tokens of its own group
        written = np.empty(len(a) + len(b), dtype=np.int64)
        written[place_a] = a * 3 + last_a
        written[place_b] = b * 3 + 2 * last_b
        text = own.numbers.take(pa.array(written))
        at = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1)[first].tolist()
        data = memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]


def _align_texts(texts: list[str], own: Vocabularies) -> tuple[Aligned, pa.LargeListArray]:
    """The alignment of a run of texts and each one's pairs; texts that are not spelled by both have no tokens."""
    wanted = [b" " + t.encode() for t in texts]
    ids_a = own.encode_a(texts)
    ids_b = own.encode_b(texts)
    whole = _spells(_lists(ids_a), own.a, wanted) & _spells(_lists(ids_b), own.b, wanted)
    if not whole.all():
        ids_a = [ids if ok else b"" for ids, ok in zip(ids_a, whole)]
        ids_b = [ids if ok else b"" for ids, ok in zip(ids_b, whole)]
    found = Aligned(_lists(ids_a), _lists(ids_b), own)
    offsets = np.concatenate([[0], np.cumsum(found.n_links)])
    return found, pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(found.pairs))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_VOCABULARY, b: str = B_VOCABULARY
) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the digest of its groups, and its linked pairs.

    A pair is written as the id of A times the size of B plus the id of B. The rows are stored.
    """
    a_path, b_path = encoding.vocabulary(a), encoding.vocabulary(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(a_path, b_path)
        for ids, texts in encoding.text_runs(batches, RUN_CHARS):
            found, pairs = _align_texts(texts, own)
            links = pa.array(found.n_links.astype(np.int64))
            columns = [pa.array(ids, pa.int64()), pa.array(found.n_a), pa.array(found.n_b), links, links]
            columns += [pa.array(found.digests, pa.string()), pairs.cast(pa.list_(pa.int64()))]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(chosen.mapInArrow(run, ALIGNED), "aligned")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``RUN_LINKS`` links; a document is never cut."""
    for batch in batches:
        links = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("pairs")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = links[begin - 1] if begin else 0
            end = max(int(np.searchsorted(links, done + RUN_LINKS)), begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def pair_counts(aligned: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> DataFrame:
    """Links of the whole corpus per pair of ids, and whether no pair with the same id of B has more.

    Tasks count their own pairs first; a task's table is bounded by ``possible_pairs`` like the result.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _runs(batches):
            flat = pc.list_flatten(batch.column("pairs"))
            own = pa.table({"pair": flat}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            own = own.rename_columns(["pair", "n"])
            if held is not None:
                both = pa.concat_tables([held, own])
                own = both.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            held = own
        if held is not None:
            yield from held.combine_chunks().to_batches()

    size_b = len(vocabularies(encoding.vocabulary(a), encoding.vocabulary(b)).b)
    total = aligned.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    id_b = F.col("pair") % F.lit(size_b)
    ids = total.select("pair", F.floor(F.col("pair") / F.lit(size_b)).alias("id_a"), id_b.alias("id_b"), "n")
    return ids.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("id_b")))


def scored(aligned: DataFrame, counts: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> DataFrame:
    """Add to each document the links whose pair is the best of its B id, and the sum of the counts of its links."""
    bound = vocabularies(encoding.vocabulary(a), encoding.vocabulary(b)).possible_pairs()
    table = counts.select("pair", "n", "best").toArrow()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} pairs of ids where the vocabularies allow {bound}")
    pair, n, best = (table[c].combine_chunks() for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = pa.table({"pair": pair, "n": n, "best": best.cast(pa.int64())})
        for batch in _runs(batches):
            pairs = batch.column("pairs")
            links = pa.table({"doc": pc.list_parent_indices(pairs), "pair": pc.list_flatten(pairs)})
            links = links.join(weights, "pair", join_type="inner", use_threads=False)
            sums = links.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
            out = np.zeros((2, batch.num_rows), dtype=np.int64)
            own = np.asarray(sums["doc"])
            out[0, own], out[1, own] = np.asarray(sums["best_sum"]), np.asarray(sums["n_sum"])
            columns = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(out[0]), "count_sum": pa.array(out[1]), "groups_sha256": batch.column("groups_sha256")}
            yield pa.RecordBatch.from_pydict(columns)

    return aligned.mapInArrow(run, SCORED)


def cross_aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment, corpus-wide counts and scores of every document."""
    aligned = align(docs, id_col, text_col)
    return scored(aligned, pair_counts(aligned))
