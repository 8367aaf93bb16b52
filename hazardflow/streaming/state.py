"""Stateful stream operators: reuse within a time limit, drift of the last N labels, and feed health."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazardflow import dims, session
from hazardflow.functions.times import MICROS, micros
from hazardflow.operators.boosting import Trees
from hazardflow.operators.models import CLASSES, SEQUENCE_VALUES
from hazardflow.operators.sequence_training import SequenceModel


def use_rocksdb(spark: SparkSession) -> None:
    """These operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session.STATE_STORE)


def _ordered(rows: Iterator[pd.DataFrame], extra: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key's rows of one micro-batch in ``(time, id)`` order: ids, times and one more column."""
    parts = [(part["id"].to_numpy(), part["us"].to_numpy(), part[extra].to_numpy()) for part in rows]
    ids, times, values = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((ids, times))
    return ids[order], times[order], values[order]


def reuse_sources(
    ids: np.ndarray, times: np.ndarray, clears: np.ndarray, limit: int, put: int | None, source: int | None
) -> tuple[np.ndarray, int | None, int | None]:
    """For rows in time order, whose prediction each takes; and the scored row that stands at the end.

    A row older than the scored row before the first one is late: it is scored itself and changes nothing. Each step jumps
    to the first row that is past the limit, so the steps number the scored rows.
    """
    sources = ids.copy()
    late = 0 if put is None else int(np.searchsorted(times, put, side="left"))
    edges = np.append(np.flatnonzero(clears), len(ids))
    begin = late
    for edge in edges.tolist():
        while begin < edge:
            if put is None or times[begin] - put > limit:
                put, source = int(times[begin]), int(ids[begin])
            end = min(edge, int(np.searchsorted(times, put + limit, side="right")))
            sources[begin:end] = source
            begin = end
        if edge < len(ids) and edge >= late:  # a late invalidation is about an older prediction
            put = source = None
            begin = edge + 1
    return sources, put, source


class ReuseWithinLimit(StatefulProcessor):
    """Per key, the last scored row's time and id; rows within the limit take that id.

    Rows of a micro-batch are handled in time order, whatever files they came in. A row that is older than what
    earlier batches have decided is answered as a scored row of its own: it takes no later row's answer and leaves
    the state alone. No row is ever left out. A tombstone row (``invalidate`` true) clears the key. State that is not renewed
    is dropped after a time to live on the cluster's clock.
    """

    def __init__(self, ttl_us: int, keep_ms: int) -> None:
        self._ttl_us, self._keep_ms = ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._scored = handle.getValueState("scored", "put_us long, source_id long", ttlDurationMs=self._keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ids, times, clears = _ordered(rows, "invalidate")
        clears = clears.astype(bool)
        before = self._scored.get() or (None, None)
        sources, *after = reuse_sources(ids, times, clears, self._ttl_us, *before)
        if tuple(after) != tuple(before):
            if after[0] is None:
                self._scored.clear()
            else:
                self._scored.update(tuple(after))
        ids, sources = ids[~clears], sources[~clears]
        yield pd.DataFrame({"id": ids, "source_id": sources, "reused": ids != sources})

    def close(self) -> None:
        pass


def reuse_stream(
    requests: DataFrame,
    keys: list[str],
    ts: str = "ts",
    row_id: str = "seq",
    ttl_seconds: int = dims.REUSE_TTL_SECONDS,
    keep_hours: int = 24,
    invalidate: str | None = None,
) -> DataFrame:
    """Each request with the id of the row whose prediction it takes. Invalidation is a row, clearing a new checkpoint.

    State is one time and id per key, kept for ``keep_hours`` on the cluster's clock after it was last written (the
    limit itself if that is longer). There is no watermark, so as many rows come out as go in, invalidations apart.
    """
    clear = F.lit(False) if invalidate is None else F.coalesce(F.col(invalidate), F.lit(False))
    rows = requests.select(
        *keys, F.col(row_id).cast("bigint").alias("id"), micros(F.col(ts)).alias("us"), clear.alias("invalidate")
    )
    limit = ttl_seconds or dims.REUSE_TTL_SECONDS
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ReuseWithinLimit(limit * MICROS, max(limit, keep_hours * 3600) * 1000),
        outputStructType="id long, source_id long, reused boolean",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


SPOOLED = 8 * 2**20  # bytes of a group's model inputs that stay in memory
OUT_ROWS = 10_000
# Groups of keys that share a state; an emptying row goes to each of them.
GROUPS = 256
ANSWERED = (
    "event_id string, source_id string, severity string, confidence double, p3h double, "
    "estimated_affected_population long, composite_risk_score double"
)
_HELD = "put_us long, epoch long, source_id string, severity string, confidence double, p3h double"


class _Inputs:
    """What the models read of a group's rows, by place of arrival: in memory while small, else in an unnamed temporary file."""

    _schema = pa.schema([("event_id", pa.string()), ("features", pa.list_(pa.float64())), ("sequence", pa.list_(pa.float64()))])

    def __enter__(self) -> _Inputs:
        self._file = tempfile.SpooledTemporaryFile(max_size=SPOOLED)
        return self

    def __exit__(self, *_: Any) -> None:
        self._file.close()

    def kept(self, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, list[str]]:
        """The other columns in time order with the place of every row, times of emptying rows, and keys by number."""
        parts, clears, numbers, n = [], [np.empty(0, dtype=np.int64)], {}, 0
        with pa.ipc.new_stream(self._file, self._schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for part in rows:
                given = part["clear"].to_numpy(bool)
                clears.append(part["us"].to_numpy()[given])
                part = part.loc[~given]
                if not len(part):
                    continue
                out.write_batch(pa.RecordBatch.from_pandas(part[self._schema.names], self._schema, preserve_index=False))
                narrow = part[["us", "estimated_affected_population", "composite_risk_score"]].copy()
                narrow["event_id"] = part["event_id"].astype("string[pyarrow]")
                narrow["key"] = np.array([numbers.setdefault(k, len(numbers)) for k in part["key"]], dtype=np.int32)
                narrow["place"] = np.arange(n, n + len(part))
                n += len(part)
                parts.append(narrow)
        if not parts:
            return pd.DataFrame(), np.concatenate(clears), []
        ordered = pd.concat(parts, ignore_index=True).sort_values(["us", "event_id"], kind="stable", ignore_index=True)
        return ordered, np.concatenate(clears), list(numbers)

    def rows(self, places: np.ndarray) -> Iterator[pd.DataFrame]:
        """The rows at ascending places, batch by batch; an empty table first."""
        yield self._schema.empty_table().to_pandas()
        self._file.seek(0)
        low = 0
        for batch in pa.ipc.open_stream(self._file):
            here = places[np.searchsorted(places, low) : np.searchsorted(places, low + batch.num_rows)] - low
            low += batch.num_rows
            if len(here):
                yield batch.take(pa.array(here)).to_pandas()


class AnswersWithinLimit(StatefulProcessor):
    """Per key, the last scored row with its answer; only rows that no held answer serves reach the models.

    Keys are held in groups. An emptying row (``clear``) reaches every group and opens a new epoch there, named by its
    time: answers of an earlier epoch serve no row of a later one. Rows are handled in time order inside a
    micro-batch; a row older than what is held for its key is scored by itself and leaves the state alone.

    What the models read waits in a temporary file until it is known which rows are scored, so that memory holds a group's
    times and ids only, and one batch of features.
    """

    def __init__(self, model: Trees | None, escalation: SequenceModel | None, ttl_us: int, keep_ms: int) -> None:
        self._model, self._escalation, self._ttl_us, self._keep_ms = model, escalation, ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._epoch = handle.getValueState("epoch", "us long")
        self._held = handle.getMapState("held", "key string", _HELD, ttlDurationMs=self._keep_ms)

    def _answers(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Answers of the models, all rows of the group at once."""
        out = pd.DataFrame({"source_id": rows["event_id"], "severity": "MODERATE", "confidence": 0.0, "p3h": np.nan})
        if len(rows) and self._model is not None:
            shares = self._model.shares(np.stack(rows["features"].to_list()).astype(float))
            out["severity"] = np.array(CLASSES, dtype=object)[shares.argmax(axis=1)]
            out["confidence"] = shares.max(axis=1)
        if len(rows) and self._escalation is not None:
            flat = [np.zeros(SEQUENCE_VALUES) if s is None else s for s in rows["sequence"]]
            at = self._escalation.horizons.index(3)
            out["p3h"] = self._escalation.shares(np.stack(flat).astype(float))[:, at]
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        with _Inputs() as inputs:
            yield from self._answered(*inputs.kept(rows), inputs)

    def _answered(self, part: pd.DataFrame, clears: np.ndarray, names: list[str], inputs: _Inputs) -> Iterator[pd.DataFrame]:
        known = self._epoch.get()
        epochs = np.unique(np.append(clears, -(2**62) if known is None else known[0]))
        if len(clears):
            self._epoch.update((int(epochs[-1]),))
        if not len(part):
            return
        # Rows older than every known epoch belong to the first one.
        epoch = epochs[np.maximum(np.searchsorted(epochs, part["us"].to_numpy(), side="right") - 1, 0)]
        times, sources = part["us"].to_numpy(), np.arange(len(part))
        held: dict[int, tuple] = {}  # by number: answers that were held before, as negative sources
        ends: list[tuple[str, int, int, int]] = []  # key, time put, epoch, source
        for number, places in part.groupby("key", sort=False).indices.items():
            name = names[number]
            before = self._held.getValue((name,)) if self._held.containsKey((name,)) else None
            put, own_epoch, source = (None, None, None) if before is None else (before[0], before[1], -1 - len(held))
            if before is not None:
                held[source] = before
            for e in np.unique(epoch[places]).tolist():
                own = places[epoch[places] == e]
                if own_epoch is not None and e < own_epoch:
                    continue  # late: each is scored by itself
                if e != own_epoch:
                    put, source = None, None
                found, put, source = reuse_sources(own, times[own], np.zeros(len(own), dtype=bool), self._ttl_us, put, source)
                sources[own], own_epoch = found, e
            if source is not None and source >= 0:
                ends.append((name, put, own_epoch, source))
        fresh = np.flatnonzero(sources == np.arange(len(part)))
        wanted = part["place"].to_numpy()[fresh]
        made = pd.concat([self._answers(rows) for rows in inputs.rows(np.sort(wanted))], ignore_index=True)
        earlier = [held[n][2:] for n in range(-1, -1 - len(held), -1)]
        table = pd.concat([made, pd.DataFrame(earlier, columns=made.columns).astype(made.dtypes)], ignore_index=True)
        place = np.empty(len(part), dtype=int)
        place[fresh[np.argsort(wanted)]] = np.arange(len(fresh))
        at = np.where(sources >= 0, place[np.maximum(sources, 0)], len(fresh) - 1 - sources)
        for name, put, own_epoch, source in ends:
            answer = made.iloc[place[source]]
            p3h = None if np.isnan(answer["p3h"]) else float(answer["p3h"])
            self._held.updateValue((name,), (int(put), int(own_epoch), answer["source_id"], answer["severity"], float(answer["confidence"]), p3h))
        for low in range(0, len(part), OUT_ROWS):
            own = part.iloc[low : low + OUT_ROWS]
            out = table.iloc[at[low : low + OUT_ROWS]].reset_index(drop=True)
            out.insert(0, "event_id", own["event_id"].to_numpy(object, na_value=None))
            for c in ("estimated_affected_population", "composite_risk_score"):
                out[c] = own[c].to_numpy()
            out["p3h"] = out["p3h"].astype(object).where(out["p3h"].notna(), None)
            yield out

    def close(self) -> None:
        pass


def answer_stream(
    rows: DataFrame, key: str, model: Trees | None, escalation: SequenceModel | None, seconds: int, keep_hours: int = 24
) -> DataFrame:
    """Requests with answers that are shared within ``seconds``; see ``AnswersWithinLimit``.

    ``rows`` has the key, event_id, ts, features, sequence (flat), two columns that are passed on, and ``clear``.
    """
    # The emptying rows have no key: one of them becomes a row for every group, a fixed number.
    group = F.when(F.col("clear"), F.sequence(F.lit(0), F.lit(GROUPS - 1))).otherwise(
        F.array(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int"))
    )
    chosen = rows.select(
        F.explode(group).alias("group"), F.col(key).alias("key"), "event_id", micros(F.col("ts")).alias("us"), "clear",
        "features", "sequence", "estimated_affected_population", "composite_risk_score",
    )
    limit = seconds or dims.REUSE_TTL_SECONDS
    return chosen.groupBy("group").transformWithStateInPandas(
        statefulProcessor=AnswersWithinLimit(model, escalation, limit * MICROS, max(limit, keep_hours * 3600) * 1000),
        outputStructType=ANSWERED,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def window_drifts(codes: np.ndarray, shares: np.ndarray, window: int) -> np.ndarray:
    """For every full window of ``window`` labels, how far each class's share is from its baseline.

    Row ``i`` belongs to the window that ends at label ``window - 1 + i``; codes of unknown labels are negative.
    """
    full = max(0, len(codes) - window + 1)
    out = np.empty((full, len(shares)))
    for c, share in enumerate(shares):
        seen = np.concatenate([[0], np.cumsum(codes == c)])
        out[:, c] = np.abs((seen[window:] - seen[:-window])[:full] / window - share) if full else 0
    return out


class LastLabelsDrift(StatefulProcessor):
    """Per key, the last N labels; an alert row for each label once the window is full and drifted."""

    def __init__(self, baseline: dict[str, float], window: int, warning: float, critical: float) -> None:
        total = sum(baseline.values())
        self._shares = {c: n / total for c, n in baseline.items()} if total else {}
        self._window, self._warning, self._critical = window, warning, critical

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._labels = handle.getListState("labels", "label string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ids, _, labels = _ordered(rows, "label")
        last = [r[0] for r in self._labels.get()] if self._labels.exists() else []
        both = np.concatenate([np.array(last, dtype=object), labels])
        classes = list(self._shares)
        codes = pd.Categorical(both, categories=classes).codes
        drifts = window_drifts(codes, np.array([self._shares[c] for c in classes]), self._window)
        # The first window can end inside the state; its alert has been given.
        drifts = drifts[max(0, len(drifts) - len(ids)) :]
        self._labels.put([(label,) for label in both[-self._window :]])
        if not classes or not len(drifts):
            return
        worst = drifts.argmax(axis=1)
        size = drifts[np.arange(len(drifts)), worst]
        hit = np.flatnonzero(size >= self._warning)
        yield pd.DataFrame(
            {
                "key": key[0],
                "id": ids[len(ids) - len(drifts) :][hit],
                "severity_class": np.array(classes, dtype=object)[worst[hit]],
                "drift_magnitude": size[hit],
                "severity": np.where(size[hit] >= self._critical, "CRITICAL", "WARNING"),
            }
        ).astype({"id": "int64", "drift_magnitude": "float64"})

    def close(self) -> None:
        pass


def drift_stream(
    predictions: DataFrame,
    baseline: dict[str, float],
    key: str,
    label: str = "predicted_severity",
    ts: str = "ts",
    row_id: str = "seq",
    window: int = dims.DRIFT_WINDOW,
    warning: float = dims.DRIFT_WARNING,
    critical: float = dims.DRIFT_CRITICAL,
) -> DataFrame:
    """Drift alerts per key. State is the last ``window`` labels of each key.

    A key is one ordered sequence of labels and so one task: choose keys that split the stream. Labels are ordered by time inside a
    micro-batch and by arrival across micro-batches; none is left out.
    """
    rows = predictions.select(
        F.col(key).cast("string").alias("key"),
        F.col(row_id).cast("bigint").alias("id"),
        micros(F.col(ts)).alias("us"),
        F.col(label).alias("label"),
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LastLabelsDrift(baseline, window, warning, critical),
        outputStructType="key string, id long, severity_class string, drift_magnitude double, severity string",
        outputMode="Append",
        timeMode="None",
    )


def feed_health_stream(polls: DataFrame) -> DataFrame:
    """Last poll per source, kept up to date; staleness is read from it at any ``as_of``.

    A maximum per source, so the built-in aggregation state serves; use output mode ``update`` or ``complete``.
    """
    return polls.groupBy("source").agg(
        F.max(F.col("polled_at").cast("timestamp")).alias("polled_at"), F.count(F.lit(1)).alias("feed_polls")
    )
