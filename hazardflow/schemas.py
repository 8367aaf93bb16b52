"""Explicit schemas of feeds, requests and training tables."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
POLYGON = T.ArrayType(POINT)

_CAP_TEXT = ["event", "severity", "urgency", "certainty", "areaDesc", "headline", "description"]

CAP_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in _CAP_TEXT],
        T.StructField("polygon", T.StringType()),
        T.StructField("sent", T.StringType()),
        T.StructField("expires", T.StringType()),
    ]
)

SEISMIC_FEATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("mag", T.DoubleType()),
                    T.StructField("magType", T.StringType()),
                    T.StructField("place", T.StringType()),
                    T.StructField("time", T.LongType()),
                    T.StructField("alert", T.StringType()),
                    T.StructField("tsunami", T.IntegerType()),
                    T.StructField("felt", T.IntegerType()),
                    T.StructField("cdi", T.DoubleType()),
                    T.StructField("mmi", T.DoubleType()),
                    T.StructField("url", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
        ),
    ]
)
SEISMIC_FEED = T.StructType([T.StructField("features", T.ArrayType(SEISMIC_FEATURE))])

# Each feature stays a JSON text, from which typed fields are read; nothing of it is lost.
WARNING_FEED = T.StructType([T.StructField("features", T.ArrayType(T.StringType()))])

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("cap_severity", T.StringType()),
        T.StructField("polygon", POLYGON),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("additional_features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("sensor_sequence", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

TRAINING_EVENT = T.StructType(
    [
        *[T.StructField(f"feature_{i}", T.DoubleType()) for i in range(10)],
        T.StructField("severity", T.StringType()),
        T.StructField("event_id", T.StringType()),
    ]
)

SEQUENCE = T.StructType(
    [
        T.StructField("seq", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("y", T.FloatType()),
    ]
)
