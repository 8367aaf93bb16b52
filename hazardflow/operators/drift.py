"""Prediction drift: class shares of the last N predictions against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow import dims
from hazardflow.functions.decisions import drift_text
from hazardflow.operators.chunks import CHUNK, HOUR, TIME, attach, earlier_chunks, in_chunk, with_chunks


def baseline_shares(counts: DataFrame, label: str = "severity", weight: str = "n") -> DataFrame:
    """Class weights as shares of their total; a zero total gives no rows."""
    total = F.sum(weight).over(Window.partitionBy())
    shares = counts.withColumn("_total", total)
    return shares.where(F.col("_total") > 0).select(label, (F.col(weight) / F.col("_total")).alias("share"))


def compare_distributions(recent: DataFrame, baseline: DataFrame, label: str = "severity") -> DataFrame:
    """Baseline classes with the recent share (0 when absent) and the absolute difference."""
    right = recent.select(F.col(label), F.col("share").alias("recent_share"))
    joined = baseline.select(F.col(label), F.col("share").alias("baseline_share")).join(right, label, "left")
    recent_share = F.coalesce("recent_share", F.lit(0.0))
    return joined.select(
        label,
        "baseline_share",
        recent_share.alias("recent_share"),
        F.abs(recent_share - F.col("baseline_share")).alias("drift"),
    )


def numbered_counts(
    predictions: DataFrame,
    keys: list[str],
    label: str,
    classes: list[str],
    ts: str,
    event_id: str,
    chunk_seconds: int,
) -> DataFrame:
    """Row number and running class counts per key in ``(ts, id)`` order, without one task per key."""
    timed = with_chunks(predictions, ts, chunk_seconds).select(*keys, event_id, ts, TIME, CHUNK, label)

    def hit(position: int) -> Column:
        return F.when(F.col(label) == classes[position], 1).otherwise(0)

    names = range(len(classes))
    slices = timed.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(hit(i)).alias(f"_n{i}") for i in names]
    )
    before = earlier_chunks(keys)
    offsets = slices.select(
        *keys,
        CHUNK,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in names],
    )
    so_far = in_chunk(keys, F.col(TIME), F.col(event_id)).rowsBetween(Window.unboundedPreceding, 0)
    rows = timed.withColumns(
        {
            "_r": F.count(F.lit(1)).over(so_far),
            **{f"_r{i}": F.sum(hit(i)).over(so_far) for i in names},
        }
    )
    rows = attach(rows, offsets, keys)
    return rows.select(
        *keys,
        event_id,
        ts,
        (F.col("_o") + F.col("_r")).alias("idx"),
        *[(F.col(f"_o{i}") + F.col(f"_r{i}")).alias(f"_c{i}") for i in names],
    )


def window_counts(
    numbered: DataFrame, keys: list[str], classes: int, window: int, block_rows: int
) -> DataFrame:
    """Class counts over the last ``window`` rows: the running count minus the one ``window`` rows earlier.

    Rows are regrouped into blocks of equal row count, each block led by the last ``window`` rows of the one
    before, so that ``lag`` reaches back inside its own block. Blocks have one size whatever the key holds.
    """
    block = F.floor((F.col("idx") - 1) / F.lit(block_rows)).cast("bigint")
    at = (F.col("idx") - 1) % F.lit(block_rows)
    homes = F.when(at >= block_rows - window, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(homes))
    order = Window.partitionBy(*keys, "_block").orderBy("idx")
    recent = {
        f"_w{i}": F.col(f"_c{i}") - F.coalesce(F.lag(f"_c{i}", window).over(order), F.lit(0)) for i in range(classes)
    }
    full = (F.col("_home") == F.col("_block")) & (F.col("idx") >= window)
    return spread.withColumns(recent).where(full).drop("_home", "_block", *[f"_c{i}" for i in range(classes)])


def prediction_drift(
    predictions: DataFrame,
    baseline: dict[str, float],
    keys: list[str] | None = None,
    label: str = "predicted_severity",
    ts: str = "ts",
    event_id: str = "event_id",
    window: int = dims.DRIFT_WINDOW,
    warning: float = dims.DRIFT_WARNING,
    critical: float = dims.DRIFT_CRITICAL,
    chunk_seconds: int = HOUR,
    block_rows: int | None = None,
) -> DataFrame:
    """An alert for each prediction whose last ``window`` labels moved away from the baseline.

    The drift is the largest absolute share difference over the baseline's classes in their given order,
    the first class on ties. Labels outside the baseline count in the window but raise no alert of their own.
    An empty baseline gives no rows.
    """
    keys = keys or []
    total = sum(baseline.values())
    classes = list(baseline)
    shares = [baseline[c] / total for c in classes] if total else []
    if not shares:
        return alert_columns(predictions.where(F.lit(False)), keys, label, ts, event_id)
    block_rows = max(block_rows or 50 * window, window)
    rows = numbered_counts(predictions, keys, label, classes, ts, event_id, chunk_seconds)
    rows = window_counts(rows, keys, len(classes), window, block_rows)
    recent = [F.col(f"_w{i}").cast("double") / F.lit(float(window)) for i in range(len(classes))]
    differences = F.array(*[F.abs(r - F.lit(s)) for r, s in zip(recent, shares, strict=True)])
    rows = rows.withColumn("drift_magnitude", F.array_max(differences)).withColumn(
        "_at", F.array_position(differences, F.array_max(differences)).cast("int")
    )
    level = F.when(F.col("drift_magnitude") >= critical, "CRITICAL").when(
        F.col("drift_magnitude") >= warning, "WARNING"
    )
    rows = rows.withColumn("severity", level).where(F.col("severity").isNotNull())
    drifting = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_at"))
    return rows.select(
        *keys,
        event_id,
        ts,
        "idx",
        F.concat(F.lit("severity_distribution_"), drifting).alias("metric_name"),
        F.element_at(F.array(*recent), F.col("_at")).alias("current_value"),
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_at")).alias("baseline_value"),
        "drift_magnitude",
        "severity",
        drift_text(drifting, F.col("drift_magnitude"), F.col("severity")).alias("message"),
    )


def alert_columns(df: DataFrame, keys: list[str], label: str, ts: str, event_id: str) -> DataFrame:
    """The alert schema over no rows."""
    return df.select(
        *keys,
        event_id,
        ts,
        F.lit(0).cast("bigint").alias("idx"),
        F.lit("").alias("metric_name"),
        *[F.lit(0.0).alias(n) for n in ("current_value", "baseline_value", "drift_magnitude")],
        F.lit("").alias("severity"),
        F.lit("").alias("message"),
    )


def recent_alerts(alerts: DataFrame, limit: int = 20, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """The last alerts in time order."""
    return alerts.orderBy(F.col(ts).desc(), F.col(event_id).desc()).limit(limit)
