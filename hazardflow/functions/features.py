"""The ten model features as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hazardflow import dims
from hazardflow.functions.text import digest_mod, strip


def _num(value: float) -> Column:
    return F.lit(float(value))


def event_type_code(event_type: Column, lower: Column | None = None) -> Column:
    """Position of the first hazard word found in the text, else a digest bucket, over 15.

    Give ``lower``, a column of the lower-case text made by an earlier projection, for many or long texts: it is then made
    once, and all 15 searches run as generated code. The words neither start nor end with white space, so only the
    digest needs the stripped text; few rows come that far.
    """
    text = F.lower(event_type) if lower is None else lower
    known = [F.when(text.contains(word), F.lit(i)) for i, word in enumerate(dims.EVENT_TYPES)]
    digest = digest_mod(F.md5(strip(text)), 32, len(dims.EVENT_TYPES))
    return F.coalesce(*known, digest).cast("double") / _num(len(dims.EVENT_TYPES))


def event_type_bucket(event_type: Column) -> Column:
    """SHA-256 bucket of the raw text, 0 to 19."""
    return digest_mod(F.sha2(event_type, 256), 64, 20)


def _has(event_type: Column, *words: str) -> Column:
    """Whether a lower-case text holds one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | event_type.contains(word)
    return found


def magnitude_score(magnitude: Column, event_type: Column) -> Column:
    """Share of the scale: 10 for earthquakes, 200 knots otherwise. Negative values stay negative."""
    value = F.coalesce(magnitude, _num(0))
    return F.least(F.when(_has(F.lower(event_type), "earthquake"), value / _num(10)).otherwise(value / _num(200)), _num(1))


def density_score(density: Column) -> Column:
    return F.least(F.coalesce(density, _num(1000)) / _num(20000), _num(1))


def prior_count_score(prior: Column) -> Column:
    """Whole events out of ten, at most 1. The count is limited before it is truncated, so no value is too large."""
    limited = F.least(F.coalesce(prior.cast("double"), _num(0)), _num(10))
    return F.signum(limited) * F.floor(F.abs(limited)).cast("double") / _num(10)


def network_degradation(magnitude: Column, event_type: Column) -> Column:
    base = F.least(F.coalesce(magnitude, _num(0)) / _num(8), _num(1))
    severe = _has(F.lower(event_type), "earthquake", "tsunami", "hurricane")
    return F.when(severe, F.least(base * _num(1.4), _num(1))).otherwise(base * _num(0.7))


def time_of_day_risk(local_ts: Column) -> Column:
    """Night 0.9, rush hours 0.7, else 0.4, by the hour on the wall clock at the event."""
    hour = F.hour(local_ts)
    return (
        F.when((hour >= 22) | (hour < 6), _num(0.9))
        .when(hour.between(6, 8) | hour.between(17, 19), _num(0.7))
        .otherwise(_num(0.4))
    )


def evacuation_score(lat: Column) -> Column:
    return F.greatest(_num(0.1), _num(1) - F.abs(F.pmod(lat, _num(3))) / _num(3))


def hospital_score(lat: Column) -> Column:
    return F.greatest(_num(0.1), _num(1) - (F.abs(lat) % _num(5)) / _num(5))


def weather_compounding(magnitude: Column, event_type: Column) -> Column:
    value = F.coalesce(magnitude, _num(0))
    return F.when(
        _has(F.lower(event_type), "wildfire", "hurricane"), F.least(_num(0.3) + value / _num(15), _num(1))
    ).otherwise(_num(0.2))


def model_features(
    event_type: Column,
    magnitude: Column,
    lat: Column,
    lon: Column,
    local_ts: Column,
    prior: Column | None = None,
    density: Column | None = None,
    vulnerability: Column | None = None,
    lower: Column | None = None,
) -> dict[str, Column]:
    """All ten features in vector order, ready for one ``withColumns``. ``lower``: see ``event_type_code``."""
    prior = F.lit(0) if prior is None else prior
    density = _num(1000) if density is None else density
    vulnerability = _num(dims.DEFAULT_VULNERABILITY) if vulnerability is None else vulnerability
    columns = [
        event_type_code(event_type, lower),
        magnitude_score(magnitude, event_type),
        density_score(density),
        vulnerability,
        prior_count_score(prior),
        network_degradation(magnitude, event_type),
        time_of_day_risk(local_ts),
        evacuation_score(lat),
        hospital_score(lat),
        weather_compounding(magnitude, event_type),
    ]
    return dict(zip(dims.MODEL_FEATURES, columns, strict=True))
