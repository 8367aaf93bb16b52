"""Multiclass gradient boosting: per round one regression tree for each class on the shared softmax residuals.

Feature values are cut into bins once, at quantiles of all training rows. Trees grow level by level: every task adds
up its residuals by node and bin, the sums of all tasks decide the splits. Residuals are rounded to integers before they
are added, so that the model does not depend on how rows are dealt to tasks. A barrier stage would wait a second for every
exchange of sums, of which a fit needs a thousand; a job over kept rows does not. Kept rows are mapped files of the
executor, since passing all rows to Python in every job would take longer than adding them up.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import pickle
import random
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import cache, cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from hazardflow.operators import workers

BINS = 64
DEEPEST = 6  # leaves of a tree are bits of one number
UNIT = float(2**24)
SCORE_ROWS = 128
BLOCK_ROWS = 8192
GROUP_BINS = 4096
CHUNK_ROWS = 2**16
CHUNKS = 3
COUNTED = 2**43  # above twice any sum of the residuals of so many chunks, and with all their counts below 2**63
TRIES = 4
ALONE_ROWS = 1_000_000  # up to so many rows, a job for each step costs more than it saves
TASK_ROWS = 25_000
MOST_SUMS = 64  # above so many tasks, their sums are added in the cluster first
CHECKPOINT_ROUNDS = 25  # no longer read: lost rows are made again from the trees


@dataclass
class Trees:
    """Full trees of one depth in breadth-first order; a node without a split sends every row to its left."""

    features: list[str]
    classes: list[str]
    edges: list[list[float]]
    prior: list[float]
    depth: int
    feature: list[list[int]] = field(default_factory=list)
    bin: list[list[int]] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)  # of the leaves, the step size included
    importance: list[float] = field(default_factory=list)
    rows: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def read(text: str) -> Trees:
        return Trees(**json.loads(text))

    def binned(self, values: np.ndarray) -> np.ndarray:
        return _binned(values, self.edges)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Margins of binned rows, one column for each class.

        Each tree test that a bin fails rules out the leaves on its left. What a feature's bin rules out is looked up for
        all trees at once, and the lowest leaf that is left is the one the row falls into.
        """
        allowed, value = self._tables
        kind = allowed[0].dtype.type
        first = np.arange(len(self.feature)) * 2**self.depth
        out = np.empty((len(bins), len(self.classes)))
        for low in range(0, len(bins), SCORE_ROWS):
            part = bins[low : low + SCORE_ROWS]
            left = allowed[0][part[:, 0]]
            for f in range(1, part.shape[1]):
                left &= allowed[f][part[:, f]]
            lowest = left & (~left + kind(1))
            leaf = _place(lowest)
            leaf += first
            gains = np.einsum("ijk->ik", value[leaf].reshape(len(part), -1, len(self.classes)))
            out[low : low + SCORE_ROWS] = gains + self.prior
        return out

    @cached_property
    def _tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each feature the leaves that a bin leaves to every tree, as bits; values of all trees' leaves."""
        n_trees, leaves = len(self.feature), 2**self.depth
        kind = np.uint32 if leaves <= 32 else np.uint64
        allowed = [np.full((len(e) + 1, n_trees), kind(2**leaves - 1 if leaves < 64 else 2**64 - 1)) for e in self.edges]
        for t, (tests, bins_of) in enumerate(zip(self.feature, self.bin)):
            for node, f in enumerate(tests):
                if f >= 0:
                    level = (node + 1).bit_length() - 1
                    width = leaves >> (level + 1)
                    low = (node + 1 - (1 << level)) * 2 * width
                    allowed[f][bins_of[node] + 1 :, t] &= kind(~(((1 << width) - 1) << low) & (2**leaves - 1))
        return allowed, np.array(self.value).reshape(-1)

    def shares(self, values: np.ndarray) -> np.ndarray:
        """Class probabilities of rows of feature values; equal rows are scored once."""
        bins = self.binned(values)
        if np.prod([float(len(e) + 1) for e in self.edges]) < 2.0**62:
            key = np.zeros(len(bins), dtype=np.int64)
            for f, own in enumerate(self.edges):
                key = key * (len(own) + 1) + bins[:, f]
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            bins = bins[at]
        else:
            bins, back = np.unique(bins, axis=0, return_inverse=True)
        return _softmax(self.margins(bins).T).T[back.reshape(-1)]

    def probabilities(self, values: Column) -> Column:
        """Class probabilities of an array column of feature values."""
        model = self

        @arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(model.features))
            found = model.shares(flat)
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))

        return score(values)


def _softmax(margins: np.ndarray) -> np.ndarray:
    """Shares from margins, one row for each class."""
    powers = np.exp(margins - margins.max(axis=0))
    powers /= powers.sum(axis=0)
    return powers


def _binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    bins = np.empty(values.shape, dtype=np.uint8)
    for f, own in enumerate(edges):
        bins[:, f] = np.searchsorted(own, values[:, f], side="left")
    return bins


def _drawn(ids: np.ndarray, round_number: int, share: float, seed: int) -> np.ndarray:
    """Rows that take part in a round, by a hash of their id, so that it does not matter which task holds them."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64((round_number + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def _best_splits(sums: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the feature, bin and gain of the best split; -1 where none helps. Last axis: bins of all features."""
    feature = np.full(sums.shape[0], -1)
    bin_of = np.zeros(sums.shape[0], dtype=int)
    gain = np.zeros(sums.shape[0])
    for f, (low, high) in enumerate(zip(first, first[1:])):
        if high - low < 2:
            continue
        left_n, left = np.cumsum(counts[:, low:high], axis=1)[:, :-1], np.cumsum(sums[:, low:high], axis=1)[:, :-1]
        right_n, right = counts[:, low:high].sum(axis=1, keepdims=True) - left_n, sums[:, low:high].sum(axis=1, keepdims=True) - left
        both = (left_n > 0) & (right_n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            better = left_n * right_n / (left_n + right_n) * (left / left_n - right / right_n) ** 2
        better = np.where(both, better, 0.0)
        at = better.argmax(axis=1)
        most = better[np.arange(len(at)), at]
        wins = most > gain * (1 + 1e-12)
        feature[wins], bin_of[wins], gain[wins] = f, at[wins], most[wins]
    return feature, bin_of, gain


@dataclass
class _Layout:
    """Features whose bins are counted together: the numbers of their bins, multiplied, are at most ``GROUP_BINS``.

    A code is the joint bin of a group. A feature of one bin decides nothing and is in no group, unless all are so.
    """

    bins: list[int]  # by feature
    groups: list[list[int]]

    @staticmethod
    def of(bins: list[int]) -> _Layout:
        groups: list[list[int]] = []
        for f in sorted((f for f, n in enumerate(bins) if n > 1), key=lambda f: -bins[f]) or [0]:
            room = [g for g in groups if bins[f] * int(np.prod([bins[x] for x in g])) <= GROUP_BINS]
            if room:
                room[0].append(f)
            else:
                groups.append([f])
        return _Layout(bins, groups)

    def shape(self, group: list[int]) -> tuple[int, ...]:
        return tuple(self.bins[f] for f in group)

    def sizes(self) -> list[int]:
        return [int(np.prod(self.shape(g))) for g in self.groups]

    def codes(self, bins: np.ndarray) -> list[np.ndarray]:
        """For each group the code of every row."""
        found = []
        for group in self.groups:
            code = np.zeros(len(bins), dtype=np.uint16)
            for f in group:
                code = code * np.uint16(self.bins[f]) + bins[:, f]
            found.append(code)
        return found

    def by_feature(self, joint: list[np.ndarray]) -> np.ndarray:
        """Sums by bin of all features from those by code, one array for each group; the last axis is replaced."""
        first = np.concatenate([[0], np.cumsum(self.bins)])
        found = np.empty((*joint[0].shape[:-1], first[-1]), dtype=joint[0].dtype)
        found[..., [first[f] for f, n in enumerate(self.bins) if n == 1]] = joint[0].sum(axis=-1, keepdims=True)
        for group, sums in zip(self.groups, joint):
            whole = sums.reshape(*sums.shape[:-1], *self.shape(group))
            before = sums.ndim - 1
            for i, f in enumerate(group):
                others = tuple(before + j for j in range(len(group)) if j != i)
                found[..., first[f] : first[f + 1]] = whole.sum(axis=others)
        return found


@dataclass
class _Fit:
    """One round: its number and the splits of its trees as far as they are grown, one row for each class."""

    round: int
    depth: int
    feature: np.ndarray
    bin: np.ndarray

    def words(self, layout: _Layout, level: int, wanted: np.ndarray | None = None) -> list[tuple[list[int], int, list[np.ndarray]]]:
        """Tables that say which node of a level a code may lead to, one bit for each node and class.

        What all groups of a row leave is the bit of its node, or none if that node is not ``wanted``. Several classes
        share a number: their places in it, the bits of each, and a table for each group.
        """
        n_classes, nodes = len(self.feature), 2**level
        bits = max(8, nodes)
        share = 64 // bits
        every = (1 << nodes) - 1
        found = []
        for low in range(0, n_classes, share):
            classes = list(range(low, min(low + share, n_classes)))
            tables = [np.zeros(size, dtype="<u8") for size in layout.sizes()]
            for i, k in enumerate(classes):
                kept = every if wanted is None else sum(1 << n for n in np.flatnonzero(wanted[k]).tolist())
                own = [np.full(size, kept, dtype="<u8") for size in layout.sizes()]
                for node in range(nodes - 1):
                    depth = (node + 1).bit_length() - 1
                    width = nodes >> (depth + 1)
                    left = ((1 << width) - 1) << ((node + 1 - (1 << depth)) * 2 * width)
                    f = int(self.feature[k, node])
                    if f < 0:  # a node without a split sends every row to its left
                        own[0] &= np.uint64(every & ~(left << width))
                        continue
                    g = next(g for g, group in enumerate(layout.groups) if f in group)
                    shape, axis = layout.shape(layout.groups[g]), layout.groups[g].index(f)
                    sides = np.where(np.arange(shape[axis]) > self.bin[k, node], np.uint64(every & ~left), np.uint64(every & ~(left << width)))
                    view = own[g].reshape(shape)
                    view &= sides.reshape([-1 if j == axis else 1 for j in range(len(shape))])
                for table, mine in zip(tables, own):
                    table |= mine << np.uint64(i * bits)
            found.append((classes, bits, tables))
        return found


def _nodes(codes: list[np.ndarray], words: list[tuple[list[int], int, list[np.ndarray]]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each class the bit of every row's node."""
    for classes, bits, tables in words:
        word = tables[0][codes[0]]
        for table, own in zip(tables[1:], codes[1:]):
            word &= table[own]
        split = word.view(f"<u{bits // 8}").reshape(len(word), -1)
        yield from ((k, split[:, i]) for i, k in enumerate(classes))


def _place(bit: np.ndarray) -> np.ndarray:
    """The position of the only bit that is set."""
    found = bit.astype(np.float64).view(np.int64)
    found >>= 52
    found -= 1023
    return found


class _Sums:
    """Residuals and rows by class, node and bin, added up as numbers that hold both."""

    def __init__(self, layout: _Layout, n_classes: int, width: int):
        self.layout, self.sizes, self.shape, self.chunks = layout, layout.sizes(), (n_classes, width, -1), 0
        self.held = [np.zeros((n_classes, width * size), dtype=np.int64) for size in self.sizes]
        self.total = self._split()

    def _split(self) -> np.ndarray:
        both = self.layout.by_feature([h.reshape(self.shape) for h in self.held])
        counts = (both + COUNTED // 2) // COUNTED
        return np.stack([both - counts * COUNTED, counts])

    def add(self, k: int, codes: list[np.ndarray], residual: np.ndarray, node: np.ndarray | None = None) -> None:
        """With ``node``, the codes are changed in place."""
        weight = residual.astype(np.int64)
        weight += COUNTED
        for held, code, size in zip(self.held, codes, self.sizes):
            if node is not None:
                code += node * size
            np.add.at(held[k], code, weight)

    def next(self) -> None:
        """A chunk is added."""
        self.chunks += 1
        if self.chunks == CHUNKS:
            self.done()

    def done(self) -> np.ndarray:
        self.total += self._split()
        for held in self.held:
            held[:] = 0
        self.chunks = 0
        return self.total


class _Shard:
    """The rows of one task in columns. ``make`` gives an array for a name, a type and a shape.

    Margins are kept twice, of a round and of the one before it, so that a round can be started again. The rows that take
    part in a round, ``drawn`` of them, are copied side by side with their residuals and spreads.
    """

    def __init__(self, layout: _Layout, n_classes: int, n: int, drawn: int, make: Callable[[str, str, tuple[int, ...]], np.ndarray]):
        self.layout, self.n_classes, self.n, self.drawn = layout, n_classes, n, drawn
        self.codes, self.own = ([make(f"{x}{g}", "u2", (n,)) for g in range(len(layout.groups))] for x in ("codes", "drawn"))
        self.label, self.ids = make("label", "u1", (n,)), make("id", "i8", (n,))
        self.margins = [make(f"margins{i}", "f8", (n_classes, n)) for i in range(2)]
        self.residual, self.spread = (make(x, "i4", (n_classes, n)) for x in ("residual", "spread"))

    @staticmethod
    def _parts(columns: list[np.ndarray], n: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
        for low in range(0, n, CHUNK_ROWS):
            part = slice(low, min(low + CHUNK_ROWS, n))
            yield part, [c[part].astype(np.int64) for c in columns]

    def _moved(self, prior: list[float], number: int, before: tuple[_Fit, np.ndarray] | None) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Chunks of all rows, with their margins at the start of a round, from those of the round before and its trees."""
        old, new = self.margins[(number + 1) % 2], self.margins[number % 2]
        words = before and before[0].words(self.layout, before[0].depth)
        for part, codes in self._parts(self.codes, self.n):
            if before is None:
                new[:, part] = np.array(prior)[:, None]
            else:
                for k, bit in _nodes(codes, words):
                    new[k, part] = old[k, part] + before[1][k][_place(bit)]
            yield part, codes

    def move(self, prior: list[float], number: int, before: tuple[_Fit, np.ndarray] | None) -> None:
        """Go through a round that is known."""
        for _ in self._moved(prior, number, before):
            pass

    def start(self, prior: list[float], number: int, before: tuple[_Fit, np.ndarray] | None, share: float, seed: int) -> np.ndarray:
        """Start a round; residuals and rows of its roots."""
        sums, self.drawn = _Sums(self.layout, self.n_classes, 1), 0
        for part, codes in self._moved(prior, number, before):
            rows = np.flatnonzero(_drawn(np.asarray(self.ids[part]), number, share, seed))
            to = slice(self.drawn, self.drawn + len(rows))
            codes = [c[rows] for c in codes]
            for own, code in zip(self.own, codes):
                own[to] = code
            label = self.label[part][rows]
            p = _softmax(np.stack([m[rows] for m in self.margins[number % 2][:, part]]))
            for k in range(self.n_classes):
                residual = (label == k) - p[k]
                residual *= UNIT
                np.rint(residual, out=residual)
                self.residual[k, to] = residual
                sums.add(k, codes, residual)
                spread = 1 - p[k]
                spread *= p[k]
                spread *= UNIT
                self.spread[k, to] = np.rint(spread, out=spread)
            sums.next()
            self.drawn += len(rows)
        return sums.done()

    def sums(self, fit: _Fit, level: int, wanted: np.ndarray) -> np.ndarray:
        """Residuals and rows by class, parent and bin of a level's nodes that are ``wanted``, one for each parent."""
        sums, words = _Sums(self.layout, self.n_classes, 2**level // 2), fit.words(self.layout, level, wanted)
        for part, codes in self._parts(self.own, self.drawn):
            for k, bit in _nodes(codes, words):
                rows = np.flatnonzero(bit != 0)
                sums.add(k, [c[rows] for c in codes], self.residual[k, part][rows], _place(bit[rows]) >> 1)
            sums.next()
        return sums.done()

    def spreads(self, fit: _Fit) -> np.ndarray:
        """Spread by class and leaf."""
        words, leaves = fit.words(self.layout, fit.depth), 2**fit.depth
        total = np.zeros((self.n_classes, leaves))
        for part, codes in self._parts(self.own, self.drawn):
            for k, bit in _nodes(codes, words):
                total[k] += np.bincount(_place(bit), self.spread[k, part], leaves)
        return total


class _Alone:
    """All rows in one task, for small tables."""

    def __init__(self, shard: _Shard, model: Trees, share: float, seed: int):
        self.shard, self.prior, self.share, self.seed = shard, model.prior, share, seed

    def start(self, number: int, before: tuple[_Fit, np.ndarray] | None) -> np.ndarray:
        return self.shard.start(self.prior, number, before, self.share, self.seed)

    def sums(self, fit: _Fit, level: int, wanted: np.ndarray) -> np.ndarray:
        return self.shard.sums(fit, level, wanted)

    def spreads(self, fit: _Fit) -> np.ndarray:
        return self.shard.spreads(fit)


class _Spread:
    """Rows dealt over tasks that keep them in files of their executor: one job for each step brings back its sums.

    The files lie in Spark's local folders, as its own intermediate files do, and what says where they are is a stored
    table, by which Spark sends a task to the executor that has its files. Where files are missing, they are made again
    from the dealt rows and the trees so far.
    """

    def __init__(self, dealt: RDD, layout: _Layout, model: Trees, share: float, seed: int):
        self.dealt, self.layout, self.model, self.share, self.seed = dealt, layout, model, share, seed
        self.name, self.folders, self.written = f"fit-{uuid.uuid4().hex}", None, False
        self._place(-1)

    def _place(self, done: int) -> None:
        """Have the rows written by tasks, as they are when the given round is started; -1 before the first."""
        if self.folders is not None:
            self.folders.unpersist()
        layout, name, share, seed = self.layout, self.name, self.share, self.seed
        prior, past = self.model.prior, [None, *(_past(self.model, number) for number in range(done))]

        def stored(blocks: Iterator[bytes]) -> Iterator[str]:
            folder = _write(blocks, name, layout)
            shard = _opened(folder, layout, len(prior), 0)
            for number in range(done):
                shard.move(prior, number, past[number])
            if done >= 0:
                shard.start(prior, done, past[done], share, seed)
                _mark(folder, done, shard.drawn)
            yield folder

        self.folders = self.dealt.mapPartitions(stored).persist(StorageLevel.MEMORY_AND_DISK)

    def _added(self, step: Callable[[_Shard], np.ndarray], needs: int, done: int | None = None) -> np.ndarray:
        """The sum of what ``step`` gives for each task's rows, which must have come to round ``needs``.

        With ``done``, the step brings them to that round, and may be taken again.
        """
        layout, n_classes = self.layout, len(self.model.prior)

        def run(own: Iterator[str]) -> Iterator[np.ndarray | None]:
            _settle()
            for folder in own:
                number, drawn = _marked(folder)
                if number is None or number not in (needs, done):
                    yield None
                    continue
                shard = _opened(folder, layout, n_classes, drawn)
                made = step(shard)
                if done is not None:
                    _mark(folder, done, shard.drawn)
                yield made

        for _ in range(TRIES):
            found = self.folders.mapPartitions(run)
            if found.getNumPartitions() > MOST_SUMS:
                made = found.treeReduce(_both)
            else:
                sums = found.collect()
                # On a busy cluster a task may have been sent to an executor without its files.
                missing = [i for i, own in enumerate(sums) if own is None]
                for i in missing:
                    sums[i] = found.context.runJob(found, list, [i])[0]
                made = reduce(_both, sums)
            if made is not None:
                self.written = True
                return made
            self._place(needs)
        raise RuntimeError("rows of a fit were lost again and again")

    def start(self, number: int, before: tuple[_Fit, np.ndarray] | None) -> np.ndarray:
        prior, share, seed = self.model.prior, self.share, self.seed
        return self._added(lambda shard: shard.start(prior, number, before, share, seed), number - 1, number)

    def sums(self, fit: _Fit, level: int, wanted: np.ndarray) -> np.ndarray:
        return self._added(lambda shard: shard.sums(fit, level, wanted), fit.round)

    def spreads(self, fit: _Fit) -> np.ndarray:
        return self._added(lambda shard: shard.spreads(fit), fit.round)

    def drop(self) -> None:
        """Remove the files; those of a lost executor go with Spark's local folders."""
        with contextlib.suppress(Exception):
            if self.written:
                self.folders.foreach(lambda folder: shutil.rmtree(os.path.dirname(folder), ignore_errors=True))
            self.folders.unpersist()


@cache
def _settle() -> None:
    """Spare a worker's modules the search for garbage that follows each of its tasks."""
    gc.freeze()


def _both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return None if a is None or b is None else a + b


def _past(model: Trees, number: int) -> tuple[_Fit, np.ndarray]:
    """A round that is done: its trees and leaf values."""
    own = slice(number * len(model.classes), (number + 1) * len(model.classes))
    return _Fit(number, model.depth, np.array(model.feature[own]), np.array(model.bin[own])), np.array(model.value[own])


def _write(blocks: Iterator[bytes], name: str, layout: _Layout) -> str:
    """Write a task's rows to files of the executor; their folder, which no other attempt writes to."""
    local = os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    folder = os.path.join(random.choice(local.split(",")), "python", name, uuid.uuid4().hex)
    os.makedirs(folder)
    columns = [f"codes{g}" for g in range(len(layout.groups))] + ["label", "id"]
    with contextlib.ExitStack() as files:
        to = {c: files.enter_context(open(os.path.join(folder, c), "wb")) for c in columns}
        for block in blocks:
            for column, values in pickle.loads(block).items():
                to[column].write(values.tobytes())
    _mark(folder, -1, 0)
    return folder


def _opened(folder: str, layout: _Layout, n_classes: int, drawn: int) -> _Shard:
    def mapped(name: str, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        path = os.path.join(folder, name)
        if not n:
            return np.empty(shape, dtype=kind)
        return np.memmap(path, dtype=kind, mode="r+" if os.path.exists(path) else "w+", shape=shape)

    n = os.path.getsize(os.path.join(folder, "label"))
    return _Shard(layout, n_classes, n, drawn, mapped)


def _mark(folder: str, number: int, drawn: int) -> None:
    """Note the round that the files have come to, -1 before the first, and how many rows take part in it."""
    path = os.path.join(folder, f"round-{uuid.uuid4().hex}")
    with open(path, "w") as f:
        f.write(f"{number} {drawn}")
    os.replace(path, os.path.join(folder, "round"))


def _marked(folder: str) -> tuple[int | None, int]:
    try:
        with open(os.path.join(folder, "round")) as f:
            number, drawn = f.read().split()
    except OSError:
        return None, 0
    return int(number), int(drawn)


def _leaf_sums(by_bin: np.ndarray, first: np.ndarray, feature: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    """Sums of the two leaves below each node, from its sums by bin of all features."""
    whole = by_bin[:, first[0] : first[1]].sum(axis=1)
    left = [row[first[f] : first[f] + b + 1].sum() if f >= 0 else w for row, f, b, w in zip(by_bin, feature, bin_of, whole)]
    return np.stack([left, whole - left], axis=1)


def _train(model: Trees, rows: _Alone | _Spread, trees: int, step: float) -> Trees:
    """The rounds of a fit. Sums are of integers, so a node is exactly what its parent has besides the other child.

    Only the child with fewer rows is added up.
    """
    n_classes, depth, first = len(model.classes), model.depth, _first(model)
    total, importance = int(first[-1]), np.zeros(len(model.features))
    before = None
    for number in range(trees):
        feature, bin_of = np.full((n_classes, 2**depth - 1), -1), np.zeros((n_classes, 2**depth - 1), dtype=int)
        gains = np.zeros((n_classes, 2**depth - 1))
        fit = _Fit(number, depth, feature, bin_of)
        nodes = rows.start(number, before).astype(float)
        for level in range(depth):
            width = 2**level
            if level:
                on_left = _leaf_sums(nodes[1].reshape(-1, total), first, *best[:2])
                small = on_left.argmin(axis=1) if len(on_left) else on_left
                wanted = np.eye(2, dtype=bool)[small].reshape(n_classes, width)
                found = rows.sums(fit, level, wanted).astype(float)
                is_left = (small == 0).reshape(1, n_classes, width // 2, 1)
                left = np.where(is_left, found, nodes - found)
                # Children of a node lie beside each other.
                nodes = np.stack([left, nodes - left], axis=3).reshape(2, n_classes, width, total)
            here = slice(width - 1, 2 * width - 1)
            best = _best_splits(*nodes.reshape(2, n_classes * width, total), first)
            feature[:, here], bin_of[:, here], gains[:, here] = (x.reshape(n_classes, width) for x in best)
        top = _leaf_sums(nodes[0].reshape(-1, total), first, *best[:2]).reshape(n_classes, -1)
        under = rows.spreads(fit)
        value = step * (n_classes - 1) / n_classes * np.divide(top, under, out=np.zeros_like(top), where=under > 0)
        before = fit, value
        for k in range(n_classes):
            used = feature[k] >= 0
            by_feature = np.bincount(feature[k][used], gains[k][used], len(importance))
            importance += by_feature / by_feature.sum() if by_feature.sum() > 0 else 0
        model.feature += feature.tolist()
        model.bin += bin_of.tolist()
        model.value += value.tolist()
    model.importance = (importance / importance.sum() if importance.sum() > 0 else importance).tolist()
    return model


def _first(model: Trees) -> np.ndarray:
    """Where each feature's bins begin among those of all, and their number."""
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in model.edges])])


def _blocks(batches: Iterator[pa.RecordBatch], model: Trees, layout: _Layout) -> Iterator[dict[str, np.ndarray]]:
    """Rows as columns of codes, labels and ids."""
    for table in _tables(batches):
        bins = model.binned(np.stack([table[f].to_numpy() for f in model.features], axis=1))
        label, ids = table["label"].to_numpy().astype("u1"), table["id"].to_numpy().astype("i8")
        yield {f"codes{g}": c for g, c in enumerate(layout.codes(bins))} | {"label": label, "id": ids}


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut and put together to tables of BLOCK_ROWS rows; the last may be shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= BLOCK_ROWS:
            yield pa.Table.from_batches([*held, batch.slice(0, BLOCK_ROWS - n)])
            batch, held, n = batch.slice(BLOCK_ROWS - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _dealt(chosen: DataFrame, n: int, model: Trees, layout: _Layout) -> RDD:
    """The rows as blocks in ``n`` tasks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, model, layout):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return chosen.repartition(n).mapInArrow(packed, "block binary").rdd.map(lambda row: row["block"])


def _kept(blocks: Iterator[dict[str, np.ndarray]], layout: _Layout, n_classes: int) -> _Shard:
    """Rows in memory."""
    held = list(blocks)
    n = sum(len(b["label"]) for b in held)

    def make(name: str, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        return np.concatenate([b[name] for b in held]) if held and name in held[0] else np.empty(shape, dtype=kind)

    return _Shard(layout, n_classes, n, 0, make)


def train(
    rows: DataFrame, features: list[str], label: str, row_id: Column, classes: list[str],
    trees: int, step: float, depth: int, share: float, seed: int, n_workers: int | None = None,
) -> Trees:
    """Fit boosted trees to rows whose ``label`` is the position of their class.

    Missing and NaN values read 0. Rows are kept in files of all executors (about 120 bytes each), none is left out. A small
    table is fitted by one task; else every step of a round is a job over these files. ``row_id`` decides which rounds a
    row takes part in. A table without rows gives equal probabilities.
    """
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth must be 1 to {DEEPEST}")
    clean = [F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    chosen = rows.select(*clean, F.col(label).cast("int").alias("label"), row_id.cast("long").alias("id"))
    # All cut points in one pass: a mergeable quantile summary for each column.
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = [F.percentile_approx(f, shares, 10 * BINS).alias(f) for f in features]
    most = [F.max(f).alias(f"_max{i}") for i, f in enumerate(features)]
    by_class = [F.count_if(F.col("label") == k).alias(f"_class{k}") for k in range(len(classes))]
    summary = chosen.agg(F.count("*").alias("_n"), *cuts, *most, *by_class).first()
    edges = [sorted({v for v in summary[f] or [] if v < summary[f"_max{i}"]}) for i, f in enumerate(features)]
    model = Trees(list(features), list(classes), edges, [0.0] * len(classes), depth, rows=summary["_n"])
    seen = np.array([summary[f"_class{k}"] for k in range(len(classes))], dtype=np.int64)
    model.prior = np.log(np.maximum(seen / max(model.rows, 1), 1e-7)).tolist()
    layout, spark = _Layout.of([len(e) + 1 for e in edges]), rows.sparkSession
    n = n_workers or workers.count(spark, model.rows, ALONE_ROWS, TASK_ROWS)
    if n == 1:

        def alone(table: pa.Table, _: workers.Exchange) -> str:
            shard = _kept(_blocks(iter(table.to_batches()), model, layout), layout, len(classes))
            return _train(model, _Alone(shard, model, share, seed), trees, step).dump()

        return Trees.read(workers.fit(chosen, 1, alone))
    spread = _Spread(_dealt(chosen, n, model, layout), layout, model, share, seed)
    try:
        return _train(model, spread, trees, step)
    finally:
        spread.drop()
