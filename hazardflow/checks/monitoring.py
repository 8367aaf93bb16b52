"""Monitoring, spatial, registry and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import dims, session
from hazardflow.checks.fixtures import alert_polygons, hazard_events, view, with_views
from hazardflow.checks.registry import query, r6, sql_round, sql_stamp, stamp
from hazardflow.operators import evaluation, feeds, metrics, ranks, registry, spatial
from hazardflow.sources.feeds import (
    cap_alerts,
    normalize,
    read_cap_feed,
    read_seismic,
    read_warnings,
    seismic_events,
    warning_rows,
)
from hazardflow.sources.tables import read_training_events

AS_OF = "2024-01-30 12:00:00"

# --- distributions and counters ------------------------------------------------------------------------


@query(
    "class_distribution",
    with_views(
        f"""SELECT observed_severity AS severity, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total,
        {sql_round('COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER ()')} AS pct
        FROM hazard_events GROUP BY observed_severity ORDER BY n DESC, severity""",
        "hazard_events",
    ),
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select(F.col("observed_severity").alias("severity"))
    return metrics.class_distribution(rows).withColumn("pct", r6("pct"))


_SUMMARY = ["value", "latency_ms", "affected_area_sq_km", "latitude", "longitude"]


@query(
    "feature_summary",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, {sql_round(f'AVG({c})', 2)} AS mean, {sql_round(f'stddev_samp({c})', 2)} AS std,
            {sql_round(f'MIN({c})', 2)} AS min, {sql_round(f'MAX({c})', 2)} AS max FROM hazard_events"""
            for c in _SUMMARY
        ),
        "hazard_events",
    ),
)
def feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.feature_summary(hazard_events(spark, sf), _SUMMARY)


def triage_log(spark: SparkSession, sf: str) -> DataFrame:
    """Served predictions: severity, latency and whether escalation was likely."""
    return hazard_events(spark, sf).select(
        "event_id",
        "seq",
        "ts",
        "source",
        F.col("predicted_severity").alias("severity"),
        "latency_ms",
        (F.col("value") >= 100).alias("escalation_likely"),
    )


def errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).where("event_type = 'Flash Flood'")
    kind = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    return rows.select("source", "ts", F.concat(F.lit("type_"), kind).alias("error_type"))


_ERRORS = """errors AS (SELECT source, ts, concat('type_', CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3
  AS VARCHAR)) AS error_type FROM hazard_events WHERE event_type = 'Flash Flood')"""


@query(
    "prediction_counters",
    with_views(
        """SELECT 'predictions_total' AS name, COUNT(*) AS value FROM hazard_events
        UNION ALL SELECT 'escalations_predicted', COUNT(*) FROM hazard_events WHERE value >= 100
        UNION ALL SELECT concat('severity_', predicted_severity), COUNT(*) FROM hazard_events GROUP BY 1""",
        "hazard_events",
    ),
)
def prediction_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prediction_counters(triage_log(spark, sf))


@query(
    "feed_counters",
    with_views(
        f"""SELECT source, CAST(SUM(item_count) AS BIGINT) AS feed_events, COUNT(*) AS feed_polls,
        {sql_stamp('MAX(polled_at)')} AS feed_last_poll FROM feed_polls GROUP BY source""",
        "feed_polls",
    ),
)
def feed_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.feed_counters(view(spark, sf, "feed_polls")).withColumn("feed_last_poll", stamp("feed_last_poll"))


@query(
    "error_counters",
    with_views(
        f"""{_ERRORS} SELECT coalesce(source, '*') AS source, coalesce(error_type, '*') AS error_type,
        COUNT(*) AS errors, GROUPING(source, error_type)::INTEGER AS level FROM errors GROUP BY ROLLUP (source, error_type)""",
        "hazard_events",
    ),
)
def error_counters(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.error_counters(errors(spark, sf), totals=True)
    return found.fillna("*", ["source", "error_type"])


_BUCKET = "CASE " + " ".join(f"WHEN latency_ms <= {b} THEN '{b:.0f}'" for b in dims.LATENCY_BOUNDS) + " ELSE '+inf' END"


@query(
    "latency_histogram",
    with_views(
        f"""SELECT source, {_BUCKET} AS upper_bound, COUNT(*) AS bucket_count,
        {sql_round('SUM(latency_ms)', 4)} AS bucket_total_ms FROM hazard_events GROUP BY ALL""",
        "hazard_events",
    ),
)
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.latency_histogram(triage_log(spark, sf), keys=["source"])
    name = F.when(F.col("upper_bound") == float("inf"), "+inf").otherwise(F.col("upper_bound").cast("int").cast("string"))
    total = F.floor(F.col("bucket_total_ms") * 10000 + 0.5).cast("double") / 10000
    return found.withColumns({"upper_bound": name, "bucket_total_ms": total})


@query(
    "latency_stats",
    with_views(
        f"""SELECT source, {sql_round('AVG(latency_ms)', 4)} AS avg_ms, COUNT(latency_ms) AS observations,
        {sql_round('SUM(latency_ms)', 4)} AS total_ms FROM hazard_events GROUP BY source""",
        "hazard_events",
    ),
)
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.latency_stats(triage_log(spark, sf), keys=["source"])
    return found.withColumns(
        {c: F.floor(F.col(c) * 10000 + 0.5).cast("double") / 10000 for c in ("avg_ms", "total_ms")}
    )


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy reports per model over time."""
    return hazard_events(spark, sf).select(
        F.concat(F.lit("m"), (F.col("sensor_id") % 12).cast("string")).alias("model"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("value") / 1000)).alias("accuracy"),
        "ts",
        "seq",
    )


_GAUGES = """gauges AS (SELECT concat('m', CAST(sensor_id % 12 AS VARCHAR)) AS model,
  1::DOUBLE / (1::DOUBLE + value / 1000) AS accuracy, ts, seq FROM hazard_events)"""


@query(
    "model_gauges",
    with_views(
        f"""{_GAUGES}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY ts DESC, seq DESC) AS rn
        FROM gauges) SELECT model, {sql_round('accuracy')} AS accuracy FROM n WHERE rn = 1""",
        "hazard_events",
    ),
)
def model_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.last_gauge(gauges(spark, sf), "model", "accuracy", "ts", "seq").withColumn("accuracy", r6("accuracy"))


@query(
    "metrics_snapshot",
    with_views(
        f"""{_ERRORS}, {_GAUGES},
        g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY ts DESC, seq DESC) AS rn FROM gauges),
        s AS (SELECT 'counter' AS kind, 'predictions_total' AS name, COUNT(*)::DOUBLE AS value FROM hazard_events
          UNION ALL SELECT 'counter', 'escalations_predicted', COUNT(*) FROM hazard_events WHERE value >= 100
          UNION ALL SELECT 'histogram', 'prediction_latency_avg_ms', AVG(latency_ms) FROM hazard_events
          UNION ALL SELECT 'histogram', 'prediction_latency_count', COUNT(latency_ms) FROM hazard_events
          UNION ALL SELECT 'histogram', 'prediction_latency_total_ms', SUM(latency_ms) FROM hazard_events
          UNION ALL SELECT 'severity', predicted_severity, COUNT(*) FROM hazard_events GROUP BY 2
          UNION ALL SELECT 'counter', concat('feed_events_', source), SUM(item_count) FROM feed_polls GROUP BY 2
          UNION ALL SELECT 'counter', concat('feed_polls_', source), COUNT(*) FROM feed_polls GROUP BY 2
          UNION ALL SELECT 'gauge', concat('feed_last_poll_', source), MAX(epoch_us(polled_at)) / 1000000::DOUBLE
            FROM feed_polls GROUP BY 2
          UNION ALL SELECT 'counter', concat('errors_', source, '_', error_type), COUNT(*) FROM errors GROUP BY 2
          UNION ALL SELECT 'gauge', concat('model_accuracy_', model), accuracy FROM g WHERE rn = 1)
        SELECT kind, name, {sql_round('value', 4)} AS value, '{AS_OF}' AS as_of FROM s""",
        "feed_polls",
    ),
)
def metrics_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    last = metrics.last_gauge(gauges(spark, sf), "model", "accuracy", "ts", "seq")
    found = metrics.snapshot(
        triage_log(spark, sf), view(spark, sf, "feed_polls"), errors(spark, sf), last, F.lit(AS_OF)
    )
    return found.withColumn("value", F.floor(F.col("value") * 10000 + 0.5).cast("double") / 10000)


_LE = ", ".join(f"COUNT(*) FILTER (WHERE latency_ms <= {b}) AS le{i}" for i, b in enumerate(dims.LATENCY_BOUNDS))


def _sql_quantile(q: float) -> str:
    cases = []
    for i, bound in enumerate(dims.LATENCY_BOUNDS):
        low, below = (dims.LATENCY_BOUNDS[i - 1], f"le{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN le{i} >= {q}::DOUBLE * n THEN {low} + {bound - low} * ({q}::DOUBLE * n - {below}) / (le{i} - {below})")
    return sql_round(f"CASE {' '.join(cases)} ELSE 1000 END")


@query(
    "histogram_quantiles",
    with_views(
        f"""w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS b, COUNT(*) AS n, {_LE} FROM hazard_events GROUP BY 1)
        SELECT {sql_stamp('b')} AS window_start, n AS observations, {_sql_quantile(0.5)} AS p50,
        {_sql_quantile(0.95)} AS p95, {_sql_quantile(0.99)} AS p99 FROM w""",
        "hazard_events",
    ),
)
def histogram_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.histogram_quantiles(triage_log(spark, sf))
    return found.select(
        stamp("window_start").alias("window_start"), "observations", *[r6(c).alias(c) for c in ("p50", "p95", "p99")]
    )


@query(
    "exact_quantiles",
    with_views(
        "SELECT source, "
        + ", ".join(f"{sql_round(f'quantile_cont(latency_ms, {q})')} AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))
        + " FROM hazard_events GROUP BY source",
        "hazard_events",
    ),
)
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = ranks.exact_quantiles(triage_log(spark, sf), ["source"], "latency_ms")
    return found.select("source", *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "approximate_quantiles",
    with_views(
        "SELECT source, "
        + ", ".join(f"quantile_disc(latency_ms, {q}) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))
        + " FROM hazard_events GROUP BY source",
        "hazard_events",
    ),
)
def approximate_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact as long as a source has fewer rows than the sketch's accuracy; beyond that the rank is off by 1e-4 at most."""
    return metrics.approximate_quantiles(triage_log(spark, sf), ["source"])


@query(
    "prediction_rate",
    with_views(
        f"""SELECT {sql_stamp("time_bucket(INTERVAL 1 MINUTE, ts)")} AS window_start, COUNT(*) AS n,
        {sql_round('COUNT(*) / 60::DOUBLE')} AS per_second FROM hazard_events GROUP BY 1""",
        "hazard_events",
    ),
)
def prediction_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.rates(triage_log(spark, sf), "ts", 60)
    return found.withColumns({"window_start": stamp("window_start"), "per_second": r6("per_second")})


@query(
    "feed_rate",
    with_views(
        f"""SELECT source, {sql_stamp("time_bucket(INTERVAL 5 MINUTES, polled_at)")} AS window_start,
        CAST(SUM(item_count) AS BIGINT) AS n, {sql_round('SUM(item_count) / 300::DOUBLE')} AS per_second
        FROM feed_polls GROUP BY 1, 2""",
        "feed_polls",
    ),
)
def feed_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.rates(view(spark, sf, "feed_polls"), "polled_at", 300, ["source"], "item_count")
    return found.withColumns({"window_start": stamp("window_start"), "per_second": r6("per_second")})


@query(
    "error_rate",
    with_views(
        f"""{_ERRORS} SELECT source, {sql_stamp("time_bucket(INTERVAL 5 MINUTES, ts)")} AS window_start,
        COUNT(*) AS n, {sql_round('COUNT(*) / 300::DOUBLE')} AS per_second FROM errors GROUP BY 1, 2""",
        "hazard_events",
    ),
)
def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.rates(errors(spark, sf), "ts", 300, ["source"])
    return found.withColumns({"window_start": stamp("window_start"), "per_second": r6("per_second")})


@query(
    "batch_statistics",
    with_views(
        f"""s AS (SELECT epoch_us(ts) // 50000 AS slot, COUNT(*) AS n FROM hazard_events GROUP BY 1)
        SELECT CAST(SUM(ceil(n / 64)) AS BIGINT) AS total_batches, CAST(SUM(n) AS BIGINT) AS total_requests,
        {sql_round('SUM(n) / SUM(ceil(n / 64))', 2)} AS avg_batch_size FROM s""",
        "hazard_events",
    ),
)
def batch_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.batch_statistics(hazard_events(spark, sf))


@query(
    "batch_statistics_hourly",
    with_views(
        f"""s AS (SELECT epoch_us(ts) // 3600000000 AS slot, COUNT(*) AS n FROM hazard_events GROUP BY 1)
        SELECT CAST(SUM(ceil(n / 8)) AS BIGINT) AS total_batches, CAST(SUM(n) AS BIGINT) AS total_requests,
        {sql_round('SUM(n) / SUM(ceil(n / 8))', 2)} AS avg_batch_size FROM s""",
        "hazard_events",
    ),
)
def batch_statistics_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Longer slots and a lower limit, so that slots split into several batches."""
    return metrics.batch_statistics(hazard_events(spark, sf), slot_ms=3_600_000, limit=8)


# --- feeds ---------------------------------------------------------------------------------------------

_LATEST = """latest AS (SELECT source, item_count, polled_at, ROW_NUMBER() OVER (PARTITION BY source
  ORDER BY polled_at DESC, seq DESC) AS rn FROM feed_polls)"""


@query(
    "feed_status_upsert",
    with_views(
        f"{_LATEST} SELECT source, item_count, {sql_stamp('polled_at')} AS polled_at FROM latest WHERE rn = 1",
        "feed_polls",
    ),
)
def feed_status_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The log's halves merged one after the other into an empty status table."""
    polls = view(spark, sf, "feed_polls")
    early = feeds.latest_status(polls.where("polled_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    merged = feeds.merge_status(early, polls.where("polled_at >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return merged.withColumn("polled_at", stamp("polled_at"))


_WATCHED = "WHERE source <> 'nws'"


@query(
    "feed_status_report",
    with_views(
        f"""{_LATEST.replace('FROM feed_polls', f'FROM feed_polls {_WATCHED}')},
        feeds(source) AS (VALUES ('noaa'), ('usgs'), ('nws'))
        SELECT f.source, CASE WHEN l.source IS NULL THEN 'initializing'
          WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(polled_at) <= 300000000 THEN 'active' ELSE 'idle' END AS status,
        CAST(coalesce(item_count, 0) AS BIGINT) AS item_count,
        {sql_stamp(f"coalesce(polled_at, TIMESTAMP '{AS_OF}')")} AS last_poll
        FROM feeds f LEFT JOIN (SELECT * FROM latest WHERE rn = 1) l ON f.source = l.source""",
        "feed_polls",
    ),
)
def feed_status_report(spark: SparkSession, sf: str) -> DataFrame:
    """One feed has not been polled yet."""
    status = feeds.latest_status(view(spark, sf, "feed_polls").where("source <> 'nws'"))
    report = feeds.status_report(status, F.lit(AS_OF).cast("timestamp_ntz"))
    return report.withColumn("last_poll", stamp("last_poll"))


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(MAX(polled_at))) / 1000000::DOUBLE"


@query(
    "feed_staleness",
    with_views(
        f"""SELECT source, {sql_round(_AGE, 1)} AS last_poll_seconds_ago,
        CASE WHEN {_AGE} > 86400 THEN 'STALE' ELSE 'HEALTHY' END AS status FROM feed_polls GROUP BY source""",
        "feed_polls",
    ),
)
def feed_staleness(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.staleness(view(spark, sf, "feed_polls"), F.lit(AS_OF).cast("timestamp_ntz"), 86400)


@query(
    "active_feeds",
    with_views(
        f"""SELECT COUNT(*) AS active_feeds FROM (SELECT source FROM feed_polls GROUP BY source
        HAVING {_AGE} <= 86400)""",
        "feed_polls",
    ),
)
def active_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.active_feeds(view(spark, sf, "feed_polls"), F.lit(AS_OF).cast("timestamp_ntz"), 86400)


@query(
    "feed_item_counts",
    with_views("SELECT source, COUNT(*) AS item_count FROM hazard_events GROUP BY source", "hazard_events"),
)
def feed_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.item_counts(hazard_events(spark, sf))


@query(
    "seismic_filter",
    with_views(
        """SELECT event_id, magnitude, 'unknown' AS magnitude_type, latitude, longitude, 10::DOUBLE AS depth_km,
        seq % 2 = 1 AS tsunami_flag, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 100 END AS INTEGER) AS felt_count,
        strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS occurred_at
        FROM hazard_events WHERE event_type = 'earthquake' AND magnitude >= 2.5""",
        "hazard_events",
    ),
)
def seismic_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = seismic_events(seismic_features(spark, sf))
    return found.select(
        "event_id",
        "magnitude",
        "magnitude_type",
        "latitude",
        "longitude",
        "depth_km",
        "tsunami_flag",
        "felt_count",
        stamp("occurred_at").alias("occurred_at"),
    )


def seismic_features(spark: SparkSession, sf: str) -> DataFrame:
    """Seismic features built from the earthquake events, null magnitudes included."""
    # The stored type beside the derived one, so that the scan skips the others.
    rows = hazard_events(spark, sf, "event_type = 'view'").where("event_type = 'earthquake'")
    null = F.lit(None)
    return rows.select(
        F.col("event_id").alias("id"),
        F.struct(
            F.col("magnitude").alias("mag"),
            null.cast("string").alias("magType"),
            null.cast("string").alias("place"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
            null.cast("string").alias("alert"),
            (F.col("seq") % 2).cast("int").alias("tsunami"),
            F.when(F.expr("seq % 3 <> 0"), F.col("seq") % 100).cast("int").alias("felt"),
            null.cast("double").alias("cdi"),
            null.cast("double").alias("mmi"),
            null.cast("string").alias("url"),
        ).alias("properties"),
        F.struct(F.array("longitude", "latitude", F.lit(10.0)).alias("coordinates")).alias("geometry"),
    )


_NORMALIZED = with_views(
    f"""SELECT event_id, 'usgs' AS source, 'earthquake' AS event_type, {sql_round('magnitude')} AS magnitude,
      {sql_round('latitude')} AS lat, {sql_round('longitude')} AS lon,
      strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, NULL AS cap_severity
    FROM hazard_events WHERE event_type = 'earthquake' AND magnitude >= 2.5
    UNION ALL SELECT concat('warning-', event_id), 'nws', 'Flash Flood Warning', NULL, {sql_round('latitude + 0.25')},
      {sql_round('longitude + 0.5')}, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), 'Moderate'
    FROM hazard_events WHERE event_type = 'Flash Flood'
    UNION ALL SELECT concat('alert-', CAST(alert_id AS VARCHAR)), 'noaa', 'Flood Warning', NULL,
      {sql_round('CASE WHEN is_triangle = 1 THEN (3 * lat0 + dlat) / 3 ELSE (4 * lat0 + 2 * dlat) / 4 END')},
      {sql_round('CASE WHEN is_triangle = 1 THEN (3 * lon0 + 2 * dlon) / 3 ELSE (4 * lon0 + 2 * dlon) / 4 END')},
      '2024-01-02 03:04:05', 'Severe' FROM alert_polygons""",
    "hazard_events",
    "alert_polygons",
)


def _cap_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Alert entries whose polygon text repeats the first corner."""
    ring = F.concat("polygon", F.slice("polygon", 1, 1))
    pairs = F.transform(ring, lambda p: F.concat_ws(",", p["lat"].cast("string"), p["lon"].cast("string")))
    return alert_polygons(spark, sf).select(
        F.concat(F.lit("alert-"), F.col("alert_id").cast("string")).alias("id"),
        F.lit("Flood Warning").alias("event"),
        F.lit("Severe").alias("severity"),
        *[F.lit(None).cast("string").alias(n) for n in ("urgency", "certainty", "areaDesc", "headline", "description")],
        F.array_join(pairs, " ").alias("polygon"),
        F.lit("2024-01-02T03:04:05Z").alias("sent"),
        F.lit("2024-01-03T03:04:05Z").alias("expires"),
    )


def _warning_features(spark: SparkSession, sf: str) -> DataFrame:
    """Warning features as JSON text: a box half a degree high and one degree wide from each flash flood on."""
    rows = hazard_events(spark, sf).where("event_type = 'Flash Flood'")
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5), (0.0, 0.0)]
    ring = F.array(*[F.array(F.col("longitude") + x, F.col("latitude") + y) for x, y in corners])
    feature = F.struct(
        F.concat(F.lit("warning-"), F.col("event_id")).alias("id"),
        F.struct(
            F.lit("Flash Flood Warning").alias("event"),
            F.lit("Moderate").alias("severity"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sent"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return rows.select(F.to_json(feature).alias("feature"))


def _normal_rows(events: DataFrame) -> DataFrame:
    numbers = [r6(c).alias(c) for c in ("magnitude", "lat", "lon")]
    return events.select("event_id", "source", "event_type", *numbers, stamp("ts").alias("ts"), "cap_severity")


@query("feed_normalization", _NORMALIZED)
def feed_normalization(spark: SparkSession, sf: str) -> DataFrame:
    """Seismic events, alerts and warnings as one event table."""
    alerts = cap_alerts(_cap_entries(spark, sf)).where("entry_ok")
    warnings = warning_rows(_warning_features(spark, sf))
    return _normal_rows(normalize(alerts, seismic_events(seismic_features(spark, sf)), warnings))


def landed_feeds(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    """The three feeds as files: Atom entries, and JSON feature collections of some hundred features each."""
    folder = session.shared_dir(spark, "feeds")
    _cap_entries(spark, sf).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(f"{folder}/cap")
    quakes = seismic_features(spark, sf).select(F.to_json(F.struct("id", "properties", "geometry")).alias("feature"))
    for name, features in (("seismic", quakes), ("warnings", _warning_features(spark, sf))):
        files = F.pmod(F.xxhash64("feature"), F.lit(max(1, features.count() // 400)))
        one = F.concat(F.lit('{"features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}"))
        collections = features.groupBy(files.alias("file")).agg(one.alias("value"))
        collections.write.partitionBy("file").text(f"{folder}/{name}")
    return f"{folder}/cap", f"{folder}/seismic", f"{folder}/warnings"


@query("landed_feeds", _NORMALIZED)
def landed_feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same events read from the landed files of all three feeds."""
    cap, seismic, warnings = landed_feeds(spark, sf)
    return _normal_rows(
        normalize(read_cap_feed(spark, cap), read_seismic(spark, seismic), read_warnings(spark, warnings))
    )


@query(
    "historical_events",
    with_views(
        f"""SELECT observed_severity AS severity, COUNT(*) AS n, {sql_round('SUM(value)', 3)} AS total,
        COUNT(*) FILTER (WHERE magnitude IS NULL) AS missing FROM hazard_events GROUP BY 1""",
        "hazard_events",
    ),
)
def historical_events(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows written as CSV with a header and read back by column name."""
    path = session.shared_dir(spark, "training")
    given = {"feature_0": F.col("value"), "feature_1": F.col("magnitude")}
    names = [f"feature_{i}" for i in range(10)]
    rows = hazard_events(spark, sf).select(
        "event_id", F.col("observed_severity").alias("severity"), *[given.get(n, F.lit(0.5)).alias(n) for n in names]
    )
    rows.write.option("header", "true").csv(path)
    back = read_training_events(spark, path)
    total = F.floor(F.sum("feature_0") * 1000 + 0.5).cast("double") / 1000
    missing = F.count_if(F.col("feature_1").isNull())
    return back.groupBy("severity").agg(F.count("*").alias("n"), total.alias("total"), missing.alias("missing"))


# --- space ---------------------------------------------------------------------------------------------

_EDGES = """ring AS (SELECT alert_id, is_triangle, lat0, lon0, lat0 + dlat AS lat1, lon0 + dlon AS lon1
    FROM alert_polygons),
  edges AS (SELECT alert_id, lat0 AS y1, lon0 AS x1, lat0 AS y2, lon1 AS x2 FROM ring
    UNION ALL SELECT alert_id, lat0, lon1, lat1, lon1 FROM ring
    UNION ALL SELECT alert_id, lat1, lon1, lat1, lon0 FROM ring WHERE is_triangle = 0
    UNION ALL SELECT alert_id, lat1, lon0, lat0, lon0 FROM ring WHERE is_triangle = 0
    UNION ALL SELECT alert_id, lat1, lon1, lat0, lon0 FROM ring WHERE is_triangle = 1),
  tested AS (SELECT e.event_id, g.alert_id, e.latitude AS y, e.longitude AS x, g.*
    FROM hazard_events e, edges g),
  pairs AS (SELECT event_id, alert_id FROM tested GROUP BY event_id, alert_id
    HAVING SUM(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
      AND NOT bool_or((y2 - y1) * (x - x1) = (x2 - x1) * (y - y1) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)
        AND x BETWEEN least(x1, x2) AND greatest(x1, x2)))"""
_EDGE_VIEWS = ("hazard_events", "alert_polygons")


@query("alert_containment", with_views(f"{_EDGES} SELECT event_id, alert_id FROM pairs", *_EDGE_VIEWS))
def alert_containment(spark: SparkSession, sf: str) -> DataFrame:
    events = hazard_events(spark, sf).select("event_id", "latitude", "longitude")
    polygons = alert_polygons(spark, sf).select("alert_id", "polygon")
    return spatial.containment_pairs(events, polygons).select("event_id", "alert_id")


@query(
    "events_under_alert",
    with_views(
        f"{_EDGES} SELECT event_id, source FROM hazard_events WHERE event_id IN (SELECT event_id FROM pairs)",
        *_EDGE_VIEWS,
    ),
)
def events_under_alert(spark: SparkSession, sf: str) -> DataFrame:
    events = hazard_events(spark, sf).select("event_id", "source", "latitude", "longitude")
    return spatial.events_under_alert(events, alert_polygons(spark, sf)).select("event_id", "source")


@query(
    "events_outside_alerts",
    with_views(
        f"{_EDGES} SELECT event_id, source FROM hazard_events WHERE event_id NOT IN (SELECT event_id FROM pairs)",
        *_EDGE_VIEWS,
    ),
)
def events_outside_alerts(spark: SparkSession, sf: str) -> DataFrame:
    events = hazard_events(spark, sf).select("event_id", "source", "latitude", "longitude")
    return spatial.events_outside_alerts(events, alert_polygons(spark, sf)).select("event_id", "source")


# --- model versions ------------------------------------------------------------------------------------

_REGISTRY = """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY version ORDER BY registered_at DESC, seq DESC) AS rn,
    ROW_NUMBER() OVER (PARTITION BY version ORDER BY registered_at, seq) AS fn FROM registrations),
  firsts AS (SELECT version, seq AS first_seq, ROW_NUMBER() OVER (ORDER BY registered_at, seq) AS position
    FROM ranked WHERE fn = 1),
  versions AS (SELECT r.version, r.model_type, r.description, CASE WHEN f.position = 1 AND r.seq = f.first_seq THEN 100::DOUBLE
    ELSE r.traffic_weight END AS traffic_weight, r.is_active, r.registered_at, f.position, f.position = 1 AS is_default
    FROM ranked r JOIN firsts f ON r.version = f.version WHERE r.rn = 1)"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return registry.register(view(spark, sf, "registrations"))


@query(
    "version_registration",
    with_views(
        f"""{_REGISTRY} SELECT version, model_type, description, traffic_weight, is_active, position, is_default,
        {sql_stamp('registered_at')} AS registered_at FROM versions""",
        "registrations",
    ),
)
def version_registration(spark: SparkSession, sf: str) -> DataFrame:
    return versions(spark, sf).withColumn("registered_at", stamp("registered_at"))


PROMOTED = "v5"
_PROMOTE = f"""promoted AS (SELECT version, is_active, position, CASE WHEN version = '{PROMOTED}' THEN 30::DOUBLE
    WHEN is_active THEN 70::DOUBLE / (SELECT COUNT(*) FROM versions WHERE is_active AND version <> '{PROMOTED}')
    ELSE traffic_weight END AS traffic_weight, version = '{PROMOTED}' AS is_default FROM versions)"""


@query(
    "version_promotion",
    with_views(
        f"{_REGISTRY}, {_PROMOTE} SELECT version, is_active, {sql_round('traffic_weight')} AS traffic_weight, "
        "is_default FROM promoted",
        "registrations",
    ),
)
def version_promotion(spark: SparkSession, sf: str) -> DataFrame:
    promoted = registry.promote(versions(spark, sf), PROMOTED, 30.0)
    return promoted.select("version", "is_active", r6("traffic_weight").alias("traffic_weight"), "is_default")


_CUMULATIVE = """cumulative AS (SELECT version, position, SUM(traffic_weight) OVER (ORDER BY position) AS c
    FROM promoted WHERE is_active)"""


@query(
    "cumulative_weights",
    with_views(
        f"{_REGISTRY}, {_PROMOTE}, {_CUMULATIVE} SELECT version, position, {sql_round('c')} AS cumulative_weight "
        "FROM cumulative",
        "registrations",
    ),
)
def cumulative_weights(spark: SparkSession, sf: str) -> DataFrame:
    found = registry.cumulative_weights(registry.promote(versions(spark, sf), PROMOTED, 30.0))
    return found.select("version", "position", r6("cumulative_weight").alias("cumulative_weight"))


_POINT = "CAST(concat('0x', substr(md5(event_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE * 100::DOUBLE"
_ASSIGN = f"""points AS (SELECT *, {_POINT} AS u FROM hazard_events),
  assigned AS (SELECT p.event_id, p.seq, p.observed_severity, p.latency_ms, p.value, coalesce(
    (SELECT arg_min(version, position) FROM cumulative WHERE u <= c),
    (SELECT arg_max(version, position) FROM cumulative)) AS assigned_version FROM points p)"""
_SPLIT_VIEWS = ("registrations", "hazard_events")


@query(
    "traffic_split",
    with_views(
        f"{_REGISTRY}, {_PROMOTE}, {_CUMULATIVE}, {_ASSIGN} SELECT event_id, assigned_version FROM assigned",
        *_SPLIT_VIEWS,
    ),
)
def traffic_split(spark: SparkSession, sf: str) -> DataFrame:
    promoted = registry.promote(versions(spark, sf), PROMOTED, 30.0)
    events = hazard_events(spark, sf).select("event_id")
    return registry.assign_versions(events, promoted).select("event_id", "assigned_version")


_FORCE = "CASE WHEN seq % 11 = 0 THEN 'v7' WHEN seq % 13 = 0 THEN 'v99' ELSE NULL END"
_SERVED = f"served AS (SELECT *, coalesce({_FORCE}, assigned_version) AS served_version FROM assigned)"


def _served(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    promoted = registry.promote(versions(spark, sf), PROMOTED, 30.0)
    events = hazard_events(spark, sf).select(
        "event_id", F.col("observed_severity").alias("severity"), "latency_ms", "value", F.expr(_FORCE).alias("force_version")
    )
    return promoted, *registry.serve_versions(events, promoted)


@query(
    "forced_version",
    with_views(
        f"""{_REGISTRY}, {_PROMOTE}, {_CUMULATIVE}, {_ASSIGN}, {_SERVED} SELECT event_id, served_version,
        served_version IN (SELECT version FROM versions) AS known FROM served""",
        *_SPLIT_VIEWS,
    ),
)
def forced_version(spark: SparkSession, sf: str) -> DataFrame:
    _, good, bad = _served(spark, sf)
    return good.select("event_id", "served_version", F.lit(True).alias("known")).unionByName(
        bad.select("event_id", "served_version", F.lit(False).alias("known"))
    )


@query(
    "version_listing",
    with_views(
        f"""{_REGISTRY}, {_PROMOTE}, {_CUMULATIVE}, {_ASSIGN}, {_SERVED}
        SELECT p.version, v.model_type, v.description, {sql_round('p.traffic_weight')} AS traffic_weight, p.is_active, p.is_default,
        CAST((SELECT COUNT(*) FROM served s WHERE s.served_version = p.version) AS BIGINT) AS prediction_count
        FROM promoted p JOIN versions v ON p.version = v.version""",
        *_SPLIT_VIEWS,
    ),
)
def version_listing(spark: SparkSession, sf: str) -> DataFrame:
    promoted, good, _ = _served(spark, sf)
    listing = registry.version_listing(promoted, good).withColumn("traffic_weight", r6("traffic_weight"))
    return listing.drop("registered_at", "position")


@query(
    "version_outcomes",
    with_views(
        f"""{_REGISTRY}, {_PROMOTE}, {_CUMULATIVE}, {_ASSIGN}, {_SERVED}
        SELECT served_version, COUNT(*) AS requests,
        {', '.join(f"COUNT(*) FILTER (WHERE observed_severity = '{c}') AS {c.lower()}" for c in dims.SEVERITIES)},
        {sql_round('AVG(1 / (1 + value))')} AS mean_confidence,
        {sql_round('quantile_cont(latency_ms, 0.95)')} AS p95_latency_ms
        FROM served WHERE served_version <> 'v99' GROUP BY served_version""",
        *_SPLIT_VIEWS,
    ),
)
def version_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    _, good, _ = _served(spark, sf)
    found = registry.compare_outcomes(good.withColumn("confidence", F.lit(1.0) / (F.lit(1.0) + F.col("value"))))
    return found.withColumns({c: r6(c) for c in ("mean_confidence", "p95_latency_ms")})


# --- evaluation ----------------------------------------------------------------------------------------

_PAIR = "observed_severity = '{c}'"


def _sql_report() -> str:
    per_class = " UNION ALL ".join(
        f"""SELECT '{c}' AS class, COUNT(*) FILTER (WHERE l = '{c}' AND p = '{c}') AS tp,
        COUNT(*) FILTER (WHERE p = '{c}') AS pp, COUNT(*) FILTER (WHERE l = '{c}') AS ap FROM x"""
        for c in dims.SEVERITIES
    )
    return with_views(
        f"""x AS (SELECT observed_severity AS l, predicted_severity AS p FROM hazard_events),
        c AS ({per_class}),
        r AS (SELECT class, CASE WHEN pp = 0 THEN 0::DOUBLE ELSE tp / pp END AS precision,
          CASE WHEN ap = 0 THEN 0::DOUBLE ELSE tp / ap END AS recall, ap AS support FROM c),
        f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0::DOUBLE
          ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r),
        a AS (SELECT COUNT(*) FILTER (WHERE l = p) / COUNT(*) AS acc, COUNT(*) AS n FROM x),
        u AS (SELECT class, precision, recall, f1, support FROM f
          UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM a
          UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM f
          UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support),
            SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support) FROM f)
        SELECT class, {sql_round('precision')} AS precision, {sql_round('recall')} AS recall, {sql_round('f1')} AS f1,
          CAST(support AS BIGINT) AS support FROM u""",
        "hazard_events",
    )


@query("classification_report", _sql_report())
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    report = evaluation.classification_report(hazard_events(spark, sf), "observed_severity", "predicted_severity")
    return report.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(
    "confusion_matrix",
    with_views(
        "SELECT observed_severity AS label, "
        + ", ".join(f"COUNT(*) FILTER (WHERE predicted_severity = '{c}') AS {c}" for c in dims.SEVERITIES)
        + " FROM hazard_events GROUP BY 1",
        "hazard_events",
    ),
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion_matrix(hazard_events(spark, sf), "observed_severity", "predicted_severity")


# Stand-in scores: high for small values, so that ties occur and the ranking is far from perfect.
_SCORED = """scored AS (SELECT source, 1::DOUBLE / (1::DOUBLE + value) AS score,
  CASE WHEN observed_severity IN ('EXTREME', 'SEVERE') THEN 1 ELSE 0 END AS label FROM hazard_events)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return hazard_events(spark, sf).select(
        "source",
        (F.lit(1.0) / (F.lit(1.0) + F.col("value"))).alias("score"),
        F.when(F.col("observed_severity").isin("EXTREME", "SEVERE"), 1).otherwise(0).alias("label"),
    )


@query(
    "threshold_metrics",
    with_views(
        f"""{_SCORED}, c AS (SELECT source, COUNT(*) FILTER (WHERE score >= 0.02 AND label = 1) AS tp,
          COUNT(*) FILTER (WHERE score >= 0.02) AS fl, COUNT(*) FILTER (WHERE label = 1) AS po FROM scored GROUP BY 1)
        SELECT source, tp AS true_positives, fl AS flagged, po AS positives,
          {sql_round('CASE WHEN fl = 0 THEN 0 ELSE tp / fl END')} AS precision,
          {sql_round('CASE WHEN po = 0 THEN 0 ELSE tp / po END')} AS recall FROM c""",
        "hazard_events",
    ),
)
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.threshold_metrics(scored(spark, sf), "score", "label", 0.02, ["source"])
    return found.withColumns({c: r6(c) for c in ("precision", "recall")})


@query(
    "auc_roc",
    with_views(
        f"""{_SCORED}, g AS (SELECT source, score, COUNT(*) FILTER (WHERE label = 1) AS pos,
          COUNT(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1, 2),
        b AS (SELECT *, SUM(neg) OVER (PARTITION BY source ORDER BY score) - neg + neg / 2 AS below FROM g)
        SELECT source, CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives,
          {sql_round('SUM(pos * below) / (SUM(pos) * SUM(neg))')} AS auc FROM b GROUP BY source""",
        "hazard_events",
    ),
)
def auc_roc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.auc(scored(spark, sf), "score", "label", ["source"]).withColumn("auc", r6("auc"))


@query(
    "validation_loss",
    with_views(
        f"""{_SCORED}, p AS (SELECT source, label, greatest(least(score, 1 - 1e-7), 1e-7) AS q FROM scored)
        SELECT source, {sql_round('AVG(-(label * ln(q) + (1 - label) * ln(1 - q)))')} AS log_loss, COUNT(*) AS n
        FROM p GROUP BY source""",
        "hazard_events",
    ),
)
def validation_loss(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.log_loss(scored(spark, sf), "score", "label", ["source"]).withColumn("log_loss", r6("log_loss"))


@query(
    "time_ordered_split",
    with_views(
        """h AS (SELECT epoch_us(ts) // 3600000000 AS s, COUNT(*) AS n FROM hazard_events GROUP BY 1),
        c AS (SELECT s, SUM(n) OVER (ORDER BY s) AS c, SUM(n) OVER () AS t FROM h),
        k AS (SELECT (MIN(s) + 1) * 3600000000 AS cut FROM c WHERE c >= 0.8::DOUBLE * t)
        SELECT epoch_us(ts) < cut AS train, COUNT(*) AS n, CAST(SUM(seq) AS BIGINT) AS id_sum
        FROM hazard_events, k GROUP BY 1""",
        "hazard_events",
    ),
)
def time_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    train, held = evaluation.time_split(hazard_events(spark, sf), "ts")
    tagged = train.select("seq", F.lit(True).alias("train")).unionByName(held.select("seq", F.lit(False).alias("train")))
    return tagged.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("id_sum"))


