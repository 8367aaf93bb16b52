"""Reuse of predictions within a time limit: which rows must be scored and which take an earlier answer.

Per feature key in time order, the first row is scored ("fresh"). A row reuses the last scored answer while
its age is at most the limit; a reuse does not extend the limit; the first row past it is scored again. Each
decision depends on the one before, so a key cannot be cut at arbitrary points, and gaps between rows
(sessions, ``lag``) give wrong answers.

One key may hold a third of the table, so neither the chain nor its summary is folded over a key. Distinct times are
dealt into sorted ranges of equal row count. Inside a range, chains are followed by pointer doubling in arrays. A key's
run in a range acts on its chain as a step function: from the last scored time before the run to the last scored time
in it. The steps of runs that are continued from range to range are rows; each points at the step that comes after it
(an as-of join), the pointers are doubled in joins, and the steps on the chain mark where every range starts from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from hazardflow import dims
from hazardflow.functions.times import MICROS, micros
from hazardflow.operators import ranges
from hazardflow.operators.ranges import PART


def followers(times: np.ndarray, begins: np.ndarray, ttl: int) -> np.ndarray:
    """For every time, the position of the first later one of its run that is past the limit; the length if none.

    ``begins`` are the first positions of the runs. Gaps are cut to just above the limit, which leaves every comparison
    as it is, so that one search serves all runs without leaving 64 bits.
    """
    n = len(times)
    first = np.zeros(n, dtype=bool)
    first[begins] = True
    gaps = np.minimum(np.diff(times, prepend=times[:1]), ttl + 1)
    line = np.cumsum(np.where(first, ttl + 1, gaps))
    after = np.searchsorted(line, line + ttl, side="right")
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    return np.where(after < ends, after, n)


def chain(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Marks of all positions reached from ``start`` along ``after``, in as many rounds as the logarithm of the chain."""
    marks = np.zeros(len(after) + 1, dtype=bool)
    marks[start] = True
    jump = np.append(after, len(after))
    while (jump != len(after)).any():
        marks[jump[np.flatnonzero(marks)]] = True
        jump = jump[jump]
    return marks[:-1]


def run_steps(times: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one run of sorted distinct times: ``upto`` and the position left from.

    A limit that expires at ``x`` enters at the first time after ``x``, in the first step whose ``upto`` is after ``x``. A
    row before the run can only hand over a time up to one limit into the run, so those times and the next one enter.
    """
    n = len(times)
    after = followers(times, np.array([0]), ttl)
    last, jump = np.arange(n), np.append(after, n)
    alive = np.flatnonzero(after < n)
    while len(alive):
        last[alive] = last[jump[alive]]
        jump[alive] = jump[jump[alive]]
        alive = alive[jump[alive] < n]
    entries = int(np.searchsorted(times, times[0] + ttl, side="left")) + 1 if n else 0
    left = last[:entries]
    ends = np.flatnonzero(np.append(left[1:] != left[:-1], True)) if entries else np.array([], dtype=int)
    ends = np.minimum(ends, n - 1)
    return times[ends], left[ends]


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Positions at which one of the columns differs from the row before; the first position is always one."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = True
    for name in columns:
        column = batch.column(name)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches with the positions at which runs begin, and whether the first row goes on with the run before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            names = [PART, *keys]
            begins = _changes(batch, names)
            first = [batch.column(c)[0].as_py() for c in names]
            yield batch, begins, first == last
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in names]


def _step_rows(keys: list[str], ttl: int):
    """Runs of a key in a range to the steps of their function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def steps() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                upto, left = run_steps(rows["us"].to_numpy(), ttl)
                out = rows.take(pa.array(left))
                columns = [*[out[c] for c in (*keys, PART)], pa.array(upto), out["us"], out["id"]]
                yield from pa.table(columns, names=[*keys, PART, "upto", "left_us", "left_id"]).to_batches()

        for batch, begins, goes_on in _runs(batches, keys):
            bounds = [*begins.tolist(), batch.num_rows]
            for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
                if i or not goes_on:
                    yield from steps()
                    held.clear()
                held.append(batch.slice(low, high - low))
        yield from steps()

    return run


def _replay(keys: list[str], ttl: int, starts: dict[int, tuple[int, Any]]):
    """Rows of sorted ranges to the id whose prediction each takes; ``starts`` has the scored row a range begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_part, put = None, None
        for batch, begins, goes_on in _runs(batches, keys):
            times, part = batch.column("us").to_numpy(), batch.column(PART).to_numpy()
            n = len(times)
            ends = np.append(begins[1:], n)
            carried: dict[int, tuple[int, Any]] = {}  # by run: the scored row it begins with
            for i, low in enumerate(begins.tolist()):
                new_part = part[low] != last_part
                last_part = int(part[low])
                if i == 0 and goes_on:
                    carried[i] = put
                elif new_part and last_part in starts:
                    carried[i] = starts[last_part]
            enter = begins.copy()
            for i, (us, _) in carried.items():
                enter[i] = begins[i] + np.searchsorted(times[begins[i] : ends[i]], us + ttl, side="right")
            marks = chain(enter[enter < ends], followers(times, begins, ttl))
            owner = np.maximum.accumulate(np.where(marks, np.arange(n), -1))
            ids = batch.column("id")
            given = list(carried)
            for place, i in enumerate(given):
                own = owner[begins[i] : ends[i]]
                own[own < begins[i]] = n + place
            if given:
                ids = pa.concat_arrays([ids, pa.array([carried[i][1] for i in given], ids.type)])
            at = int(owner[-1])
            put = (int(times[at]), ids[at].as_py()) if at < n else carried[given[at - n]]
            columns = [*[batch.column(c) for c in keys], batch.column("us"), ids.take(pa.array(owner))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "us", "source_id"])

    return run


def _starts(times: DataFrame, continued: DataFrame, keys: list[str], ttl: int, parts: int | None) -> DataFrame:
    """The scored row that stands when a continued range begins: (_part, us, id), at most one for each range."""
    long = times.join(F.broadcast(continued.select(*keys).distinct()), keys, "left_semi")
    fields = [times.schema[c] for c in (*keys, PART)]
    us, row_id = times.schema["us"].dataType, times.schema["id"].dataType
    schema = StructType([*fields, StructField("upto", us), StructField("left_us", us), StructField("left_id", row_id)])
    steps = ranges.stored(ranges.in_order(long, [*keys, "us"]).mapInArrow(_step_rows(keys, ttl), schema), "reuse-steps")
    asked = steps.select(*keys, "upto", (F.col("left_us") + F.lit(ttl)).alias("at"))
    pointers = ranges.next_above(asked, steps.select(*keys, F.col("upto").alias("value")), keys, parts)
    pointers = ranges.stored(pointers.where("found is not null").select(*keys, "upto", "found"), "reuse-pointers")
    runs = ranges.stored(long.groupBy(*keys, PART).agg(F.min("us").alias("first")), "reuse-runs")
    # A key's chain begins with the first step of its first run.
    marked = steps.groupBy(*keys).agg(F.min("upto").alias("upto"))
    most = runs.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    for _ in range((most - 1).bit_length()):
        onward = marked.join(pointers, [*keys, "upto"]).select(*keys, F.col("found").alias("upto"))
        marked = ranges.stored(marked.unionByName(onward), "reuse-chain")
        behind = pointers.select(*keys, F.col("upto").alias("found"), F.col("found").alias("farther"))
        pointers = pointers.join(behind, [*keys, "found"]).select(*keys, "upto", F.col("farther").alias("found"))
        pointers = ranges.stored(pointers, "reuse-pointers")
    left = steps.join(marked, [*keys, "upto"]).select(*keys, PART, F.struct("left_us", "left_id").alias("left"))
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    standing = F.last("left", ignorenulls=True).over(before)
    starts = runs.join(left, [*keys, PART], "left").withColumn("put", standing).where("put is not null")
    return starts.select(PART, F.col("put.left_us").alias("us"), F.col("put.left_id").alias("id"))


def scored_sources(rows: DataFrame, keys: list[str], ttl_us: int, parts: int | None = None) -> DataFrame:
    """For every distinct time of a key the id of the scored row that serves it: (keys, us, source_id).

    ``rows`` holds the keys, ``us`` and ``id``; at equal times of a key the smallest id counts.
    """
    distinct = ranges.least(rows, [*keys, "us"], "id")
    times = ranges.dealt(distinct, [*keys, "us"], "reuse-times", parts)
    continued = ranges.stored(ranges.continued(times, keys), "reuse-continued")
    starts: dict[int, tuple[int, Any]] = {}
    if not continued.isEmpty():
        found = _starts(times, continued, keys, ttl_us, parts)
        starts = {r[PART]: (r["us"], r["id"]) for r in found.collect()}  # one for each range at most
    schema = StructType([*[times.schema[c] for c in (*keys, "us")], StructField("source_id", times.schema["id"].dataType)])
    return ranges.in_order(times, [*keys, "us"]).mapInArrow(_replay(keys, ttl_us, starts), schema)


def mark_reuse(
    requests: DataFrame,
    keys: list[str],
    ts: str = "ts",
    event_id: str = "event_id",
    ttl_seconds: int = dims.REUSE_TTL_SECONDS,
    parts: int | None = None,
) -> DataFrame:
    """Add ``reused`` and ``source_id``, the id of the row whose prediction each row takes.

    A limit of 0 means the default. At equal times of one key, the smallest id is scored. A row's own id,
    position and routing stay its own; only the prediction is shared. Keys must not be null. ``parts`` sets the number
    of ranges; without it the session's shuffle settings do.
    """
    ttl_us = (ttl_seconds or dims.REUSE_TTL_SECONDS) * MICROS
    rows = requests.withColumn("_us", micros(F.col(ts)))
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_us").alias("us"), F.col(event_id).alias("id")
    )
    sources = scored_sources(narrow, names, ttl_us, parts).toDF(*keys, "_us", "source_id")
    marked = rows.join(sources, [*keys, "_us"], "left").drop("_us")
    return marked.withColumn("reused", F.col(event_id) != F.col("source_id"))


def reuse_stats(marked: DataFrame, keys: list[str], ttl_seconds: int = dims.REUSE_TTL_SECONDS) -> DataFrame:
    """Hits, misses, hit rate (0 without requests), number of keys and the limit."""
    per_key = marked.groupBy(*keys).agg(F.count_if("reused").alias("h"), F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("h"), F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce(F.sum(F.col("n") - F.col("h")), F.lit(0)).cast("bigint").alias("misses"),
        F.count(F.lit(1)).alias("size"),
    )
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0))
    return totals.withColumn("hit_rate", rate).withColumn(
        "default_ttl_seconds", F.lit(float(ttl_seconds or dims.REUSE_TTL_SECONDS))
    )


def share_predictions(marked: DataFrame, scored: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Give every row the prediction of its source row; ``scored`` holds one prediction per fresh id."""
    predictions = scored.withColumnRenamed(event_id, "source_id")
    return marked.join(predictions, "source_id", "left")
