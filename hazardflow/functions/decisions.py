"""Severity, routing, escalation and key columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hazardflow import dims


def _lookup(value: Column, table: dict[str, Column]) -> Column:
    """A literal map, so that ``value`` is evaluated once however long its expression is."""
    entries = [part for key, result in table.items() for part in (F.lit(key), result)]
    return F.try_element_at(F.create_map(*entries), value)


def cap_severity(word: Column) -> Column:
    """Alert-protocol severity word as a class; unmapped words give null."""
    return _lookup(word, {k: F.lit(v) for k, v in dims.CAP_SEVERITY.items()})


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {k: F.lit(v) for k, v in dims.SEVERITY_RANK.items()})


def channels(severity: Column) -> Column:
    """Ordered notification channels of a severity; unknown classes give null."""
    return _lookup(severity, {k: F.array(*[F.lit(c) for c in v]) for k, v in dims.CHANNELS.items()})


def escalation_likely(p3h: Column, threshold: float = dims.ESCALATION_THRESHOLD) -> Column:
    """Whether the 3-hour probability reaches the threshold; unknown probabilities are not likely."""
    return F.coalesce(p3h >= F.lit(threshold), F.lit(False))


def escalation_confidence(p1h: Column, p3h: Column, p6h: Column) -> Column:
    return (p1h + p3h + p6h) / F.lit(3.0)


def argmax_label(probabilities: Column, classes: list[str]) -> Column:
    """Class of the largest probability, the first one on ties. ``classes`` are in probability order."""
    position = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), position)


def untrained_prediction() -> dict[str, Column]:
    """What a missing severity model answers."""
    return {
        "severity": F.lit("MODERATE"),
        "confidence": F.lit(0.0),
        "importances": F.create_map().cast("map<string,double>"),
    }


def sequence_valid(sequence: Column) -> Column:
    """Whether a sensor sequence has the full 24 x 15 shape."""
    right_width = F.forall(sequence, lambda row: F.size(row) == dims.SEQUENCE_WIDTH)
    return F.coalesce((F.size(sequence) == dims.SEQUENCE_STEPS) & right_width, F.lit(False))


def sequence_or_zeros(sequence: Column, valid: Column | None = None) -> Column:
    """The sequence, or zeros of the full shape; ``valid`` is the shape's verdict if it is there already."""
    zero_row = F.array_repeat(F.lit(0.0), dims.SEQUENCE_WIDTH)
    return F.when(sequence_valid(sequence) if valid is None else valid, sequence).otherwise(F.array_repeat(zero_row, dims.SEQUENCE_STEPS))


def feature_key(names: list[str]) -> Column:
    """SHA-256 of the named columns as compact JSON in name order; ``-0.0`` and ``0.0`` share a key."""
    ordered = [(F.col(n) + F.lit(0.0)).alias(n) for n in sorted(names)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def drift_text(severity_class: Column, drift: Column, level: Column) -> Column:
    """Alert message of a drift finding."""
    prefix = F.when(level == "CRITICAL", F.lit("Critical drift in ")).otherwise(F.lit("Drift detected in "))
    return F.concat(prefix, severity_class, F.format_string(": %.1f%% from baseline", drift * F.lit(100.0)))
