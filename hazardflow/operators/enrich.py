"""Row enrichment: geographic risk, population, model features and input quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardflow import dims
from hazardflow.functions import features, geo, quality
from hazardflow.operators.ranks import column_quantiles


def geo_risk(events: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Region, density, vulnerability, affected people, composite risk, shelter distance and hospitals."""
    la, lo = F.col(lat), F.col(lon)
    region = geo.region_type(la, lo)
    density = geo.pseudo_density(la, lo)
    base = events.withColumns({"region_type": region, "population_density": density})
    base = base.withColumn("vulnerability_score", geo.vulnerability(F.col("region_type")))
    return base.withColumns(
        {
            "estimated_affected_population": geo.affected_population(F.col("population_density")),
            "composite_risk_score": geo.composite_risk(
                F.col("vulnerability_score"), F.col("population_density"), lo
            ),
            "nearest_shelter_km": geo.shelter_km(la),
            "hospital_count_25km": geo.hospital_count(la).cast("bigint"),
        }
    )


def population(
    events: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    area: str = "affected_area_sq_km",
    state: str = "state_code",
) -> DataFrame:
    """People in the affected area by state density.

    The state is inferred from coordinates when absent. The density table has a fixed 50 rows, so its
    broadcast does not grow with the data. States outside it take the default density and LOW confidence.
    """
    named = events.withColumn("_state", F.coalesce(F.col(state), geo.infer_state(F.col(lat), F.col(lon))))
    densities = F.broadcast(dims.state_density(events.sparkSession).withColumnRenamed("state_code", "_state"))
    joined = named.join(densities, "_state", "left")
    known = F.col("base_density").isNotNull()
    density = F.coalesce("base_density", F.lit(dims.DEFAULT_STATE_DENSITY))
    urban = geo.urban_fraction(density)
    adjusted = density * (F.lit(1.0) + F.lit(2.0) * urban)
    confidence = F.when(known & (F.col(area) < 1000), "HIGH").when(known, "MEDIUM").otherwise("LOW")
    return (
        joined.withColumns(
            {
                "inferred_state": F.col("_state"),
                "urban_fraction": urban,
                "density_per_sq_km": adjusted,
                "estimated_population": (adjusted * F.col(area)).cast("bigint"),
                "population_confidence": confidence,
            }
        )
        .drop("_state", "base_density")
    )


def feature_vector(
    events: DataFrame,
    event_type: str = "event_type",
    magnitude: str = "magnitude",
    lat: str = "latitude",
    lon: str = "longitude",
    local_ts: str = "ts",
    prior: str | None = "prior_24h_event_count",
    density: str | None = "population_density",
    vulnerability: str | None = "vulnerability_score",
    prefix: str = "",
) -> DataFrame:
    """Add the ten model features in vector order."""

    def optional(name: str | None) -> Column | None:
        return None if name is None else F.col(name)

    columns = features.model_features(
        F.col(event_type),
        F.col(magnitude),
        F.col(lat),
        F.col(lon),
        F.col(local_ts),
        optional(prior),
        optional(density),
        optional(vulnerability),
        F.col("_lower_type"),
    )
    lowered = events.withColumn("_lower_type", F.lower(F.col(event_type)))
    return lowered.withColumns({f"{prefix}{name}": column for name, column in columns.items()}).drop("_lower_type")


def raw_inputs(
    magnitude: str = "magnitude",
    density: str = "population_density",
    vulnerability: str = "vulnerability_score",
    extra: str | None = None,
) -> dict[str, Column]:
    """The raw quality inputs of an event after geographic enrichment; the request's own map wins."""
    base = {
        "magnitude_or_wind_speed": F.coalesce(F.col(magnitude), F.lit(0.0)),
        "population_density_at_center": F.col(density),
        "infrastructure_vulnerability_score": F.col(vulnerability),
        "affected_area_sq_km": F.lit(dims.DEFAULT_AREA_SQ_KM),
    }
    return base if extra is None else quality.overridden(base, F.col(extra))


def given_inputs(
    magnitude: str = "magnitude", lat: str = "latitude", lon: str = "longitude", extra: str | None = None
) -> dict[str, Column]:
    """What the checks of an event need to look at: its own values.

    Density and vulnerability follow from the coordinates, so a bad coordinate stands for both, and a filter on
    them need not repeat the geographic formulas.
    """
    # An infinite coordinate gives NaN, which is rejected; finite ones pass unchanged.
    point = (F.col(lat) - F.col(lat)) + (F.col(lon) - F.col(lon))
    given = {"magnitude_or_wind_speed": F.col(magnitude), "population_density_at_center": point}
    if extra is None:
        return given
    own = quality.from_map(F.col(extra))
    return own | {
        "magnitude_or_wind_speed": F.coalesce(own["magnitude_or_wind_speed"], F.col(magnitude)),
        "population_density_at_center": F.coalesce(own["population_density_at_center"], point),
    }


def quality_checked(
    events: DataFrame,
    values: dict[str, Column],
    given: dict[str, Column] | None = None,
    strict: bool = False,
    scaling: quality.Scaling = quality.Scaling.MIN_MAX,
    prefix: str = "in_",
) -> tuple[DataFrame, DataFrame]:
    """Valid rows with ``quality_warnings`` and the ten processed inputs, and rejected rows with ``quality_errors``.

    Validity is decided on ``given`` (default: the values themselves). Reasons are only spelled out for
    rejected rows; valid rows pass a plain condition.
    """
    valid = quality.is_valid(values if given is None else given, strict)
    processed = quality.preprocess(values, scaling)
    good = events.where(valid).withColumns(
        {
            "quality_warnings": quality.warnings(values),
            **{f"{prefix}{name}": column for name, column in processed.items()},
        }
    )
    return good, events.where(~valid).withColumn("quality_errors", quality.errors(values, strict))


def fit_scaling(df: DataFrame, names: list[str], scaling: quality.Scaling) -> DataFrame:
    """Scale columns by statistics of the whole table instead of the fixed limits.

    Only the fitted numbers come to the driver; medians are found by ranks, all columns in one pass. A column without
    values stays as it is.
    """
    centres: dict[str, tuple[float, float]] = {}
    if scaling is quality.Scaling.Z_SCORE:
        row = df.agg(
            *[s for n in names for s in (F.avg(n).alias(f"c_{n}"), F.stddev_samp(n).alias(f"s_{n}"))]
        ).first()
        centres = {n: (row[f"c_{n}"], row[f"s_{n}"]) for n in names}
    elif scaling is quality.Scaling.ROBUST:
        for row in column_quantiles(df, names, (0.25, 0.5, 0.75)).collect():
            centres[row["name"]] = (row["p50"], row["p75"] - row["p25"])
    centres = {n: (c, s) for n, (c, s) in centres.items() if c is not None}
    return df.withColumns(
        {n: (F.col(n) - F.lit(c)) / F.lit(s) if s else F.col(n) - F.lit(c) for n, (c, s) in centres.items()}
    )
