"""Triage requests: JSON in, validated rows and a quarantine out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardflow import schemas


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests from JSON lines; malformed lines keep their text in ``_corrupt_record``."""
    reader = (spark.readStream if stream else spark.read).schema(schemas.REQUEST)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """Requests from a JSON text column, such as a message topic's value."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return rows.select(F.from_json(column, schemas.REQUEST, options).alias("r")).select("r.*")


def problems() -> Column:
    """Reasons to reject a request: malformed, a required field missing, or coordinates out of range.

    Spark leaves a field null when its type does not fit and marks the row as corrupt, so the wrong type of
    one field is reported as a malformed record.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    return F.array_compact(
        F.array(
            F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed record")),
            F.when(F.col("event_id").isNull(), F.lit("event_id missing")),
            F.when(F.col("event_type").isNull(), F.lit("event_type missing")),
            F.when(lat.isNull(), F.lit("latitude missing")),
            F.when(lon.isNull(), F.lit("longitude missing")),
            F.when(F.isnan(lat) | ~lat.between(-90.0, 90.0), F.lit("latitude out of range")),
            F.when(F.isnan(lon) | ~lon.between(-180.0, 180.0), F.lit("longitude out of range")),
            F.when(
                F.col("timestamp").isNotNull() & F.col("timestamp").try_cast("timestamp").isNull(),
                F.lit("timestamp unreadable"),
            ),
        )
    )


def checked_requests(requests: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Requests with defaults filled and a ``problems`` array.

    ``_local_ts`` keeps the hour on the sender's clock; ``ts`` is the instant. A missing time takes ``as_of``.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    text = F.col("timestamp")
    local = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    return requests.withColumns(
        {
            "problems": problems(),
            "magnitude": F.coalesce("magnitude", F.lit(0.0)),
            "ts": F.coalesce(text.try_cast("timestamp"), as_of.cast("timestamp")),
            "_local_ts": F.coalesce(local, as_of.cast("timestamp_ntz")),
            "additional_features": F.coalesce("additional_features", F.create_map().cast("map<string,double>")),
        }
    ).drop("timestamp")


def split_requests(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests and the quarantine with its reasons."""
    bad = F.size("problems") > 0
    return checked.where(~bad).drop("problems", "_corrupt_record"), checked.where(bad)
