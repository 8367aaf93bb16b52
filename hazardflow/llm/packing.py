"""Best-fit packing of token pieces into sequences of a fixed length, exact complements first.

Only the number of pieces of each length matters for the packing, so it is solved on at most ``capacity``
counts: combinations of two, three or four lengths that fill a sequence exactly are found through an index of
single, pair and triple sums and consumed as often as the counts allow; best fit places what is left. The
solution says which sequences the r-th piece of a length goes to; pieces are numbered within their length in
parallel, in groups of bounded size, so that no length is ever gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazardflow.llm.encoding import ID_BYTES, encoder, text_runs, vocabulary
from hazardflow.llm.storage import stored

CAPACITY = 2048
# Pieces of one length that are numbered together in a task.
GROUP_ROWS = 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first, which may be shorter."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json",
    end_id: int = 0, capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each whole text, its end id included.

    A null or empty text is one piece that holds the end id. Repeated rows give repeated pieces, a null id stays null.
    """
    path = vocabulary(vocab)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for ids, texts in text_runs(batches):
            rows = []
            for doc, tokens in zip(ids, encode(texts)):
                tokens += end
                for piece, (start, length) in enumerate(cut(len(tokens) // ID_BYTES, capacity)):
                    own = tokens[start * ID_BYTES : (start + length) * ID_BYTES]
                    rows.append((doc, piece, start, length, zlib.crc32(own)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES)


class Plan:
    """Where the pieces of each length go: runs of consecutive pieces to runs of consecutive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        # Per length: (first rank, number of pieces, first sequence, offset there).
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next ``n`` pieces of a length go one each to ``n`` sequences from ``sequence`` on."""
        self.runs.setdefault(length, []).append((int(self.used[length]), n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def fill(self, lengths: list[int]) -> None:
        """Consume a combination of lengths that fills a sequence, as often as there are pieces for it."""
        n = min(int(self.left[x]) // lengths.count(x) for x in set(lengths))
        offset = 0
        for x in lengths:
            self.place(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def _enough(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def _pair(self, first: list[int], rest: int) -> list[int] | None:
        """Two available lengths with the sum ``rest`` beside those of ``first``, the longer as long as possible."""
        a = np.arange(rest - 1, (rest + 1) // 2 - 1, -1)
        a = a[(self.left[a] > 0) & (self.left[rest - a] > 0)] if rest >= 2 else a[:0]
        return next((c for x in a.tolist() if self._enough(c := [*first, x, rest - x])), None)

    def _combination(self, length: int, most: int) -> list[int] | None:
        """Available lengths that fill a sequence together with ``length``: one, two or three, at most ``most``."""
        gap = self.capacity - length
        if gap == 0:
            return [length]
        if self._enough([length, gap]):
            return [length, gap]
        if most >= 2 and (found := self._pair([length], gap)):
            return found
        if most < 3 or gap < 3:
            return None
        there = (self.left[:gap] > 0).astype(np.int64)
        pair_sums = np.convolve(there, there)[:gap] > 0
        third = np.arange(gap - 2, 0, -1)
        third = third[(self.left[third] > 0) & pair_sums[gap - third]]
        return next((c for x in third.tolist() if (c := self._pair([length, x], gap - x))), None)

    def exact(self, most: int) -> None:
        """Fill sequences exactly, longest lengths first."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                found = self._combination(length, most)
                if found is None:
                    break
                while self._enough(found):
                    self.fill(found)

    def best_fit(self) -> None:
        """Longest first into the fullest sequence that has room; sequences with equal room go together."""
        room: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, number)
        rooms: list[int] = []

        def put(gap: int, first: int, n: int) -> None:
            if gap and n:
                if gap not in room:
                    bisect.insort(rooms, gap)
                room.setdefault(gap, []).append((first, n))

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):  # open as many as hold all that is left
                    each = self.capacity // length
                    n = -(-int(self.left[length]) // each)
                    put(self.capacity, self.sequences, n)
                    self.sequences += n
                    continue
                gap = rooms[at]
                first, n = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                    rooms.pop(at)
                placed = min(n, int(self.left[length]))
                self.place(length, placed, first, self.capacity - gap)
                put(gap, first + placed, n - placed)
                put(gap - length, first, placed)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` pieces of each length; time and size depend on the number of lengths, not of pieces.

    Exact fills with single, pair and triple complements can use up lengths that best fit needs, so the number of
    complements is tried from one to three and the plan with the fewest sequences is taken.
    """
    plans = []
    for most in (1, 2, 3):
        plan = Plan(counts, capacity)
        plan.exact(most)
        plan.best_fit()
        plans.append(plan)
    return min(plans, key=lambda p: p.sequences)


def _groups(counts: dict[int, int], group_rows: int) -> Column:
    """How many groups the pieces of a length are numbered in; one literal entry per length."""
    sizes = [-(-counts.get(n, 0) // group_rows) or 1 for n in range(1, max(counts, default=1) + 1)]
    return F.element_at(F.lit(sizes), F.col("length").cast("int"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of ``token_pieces``).

    Sequences are gapless from offset 0. Equal lengths are interchangeable, so ties and repeated rows need no order.
    An empty table gives an empty one.
    """
    pieces = stored(pieces, "pieces")
    # At most ``capacity`` rows reach the driver, whatever the number of pieces.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = solve(counts, capacity)
    runs = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*plan.runs[x])) for x in plan.runs}
    key = ["length", "_group"]
    grouped = pieces.withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), _groups(counts, group_rows))
    )
    before = W.partitionBy("length").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    bases = grouped.groupBy(*key).agg(F.count("*").alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = W.partitionBy(*key).orderBy("doc_id", "piece")
    ranked = grouped.join(bases, key).withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, _, to, at = runs[x]
                run = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = to[run] + rank[own] - first[run]
                offset[own] = at[run]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(look_up, f"{PIECES}, sequence_id long, offset long")
