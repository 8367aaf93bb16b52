"""Queries over time: counts, gaps, averages, labels, drift, sequences and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import dims
from hazardflow.checks.fixtures import hazard_events, with_views
from hazardflow.checks.registry import query, r6, sql_round, sql_stamp, stamp
from hazardflow.operators import drift, history, reuse, sequences
from hazardflow.operators.chunks import suggest_seconds


@query(
    "prior_event_count",
    with_views(
        """SELECT seq, CAST(COUNT(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
          RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior_count FROM hazard_events""",
        "hazard_events",
    ),
)
def prior_event_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", "event_type", "ts")
    width = suggest_seconds(rows, "ts")
    return history.prior_event_count(rows, ["event_type"], chunk_seconds=width).select("seq", "prior_count")


_CELL = "CAST(floor(latitude) AS BIGINT) AS cy, CAST(floor(longitude) AS BIGINT) AS cx"


@query(
    "prior_event_count_by_cell",
    with_views(
        f"""c AS (SELECT seq, event_type, ts, {_CELL} FROM hazard_events)
        SELECT seq, CAST(COUNT(*) OVER (PARTITION BY event_type, cy, cx ORDER BY epoch_us(ts)
          RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior_count FROM c""",
        "hazard_events",
    ),
)
def prior_event_count_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select(
        "seq",
        "event_type",
        "ts",
        F.floor("latitude").cast("bigint").alias("cy"),
        F.floor("longitude").cast("bigint").alias("cx"),
    )
    found = history.prior_event_count(rows, ["event_type", "cy", "cx"], chunk_seconds=suggest_seconds(rows, "ts"))
    return found.select("seq", "prior_count")


@query(
    "hours_since_last",
    with_views(
        f"""SELECT seq, {sql_round('''coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type
          ORDER BY ts, seq)) / 3600000000::DOUBLE, 720)''')} AS hours_since_last FROM hazard_events""",
        "hazard_events",
    ),
)
def hours_since_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", "event_type", "ts")
    found = history.hours_since_last(
        rows, ["event_type"], event_id="seq", chunk_seconds=suggest_seconds(rows, "ts")
    )
    return found.select("seq", r6("hours_since_last").alias("hours_since_last"))


@query(
    "historical_severity_avg",
    with_views(
        f"""SELECT seq, {sql_round('''coalesce(AVG(severity_rank) OVER (PARTITION BY event_type
          ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2)''')} AS historical_severity_avg
        FROM hazard_events""",
        "hazard_events",
    ),
)
def historical_severity_avg(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", "event_type", "ts", "severity_rank")
    found = history.historical_average(
        rows, ["event_type"], "severity_rank", event_id="seq", chunk_seconds=suggest_seconds(rows, "ts")
    )
    return found.select("seq", r6("historical_severity_avg").alias("historical_severity_avg"))


_LABELS = ", ".join(
    f"""CASE WHEN coalesce(MAX(severity_rank) OVER (PARTITION BY event_type, region ORDER BY epoch_us(ts)
      RANGE BETWEEN 1 FOLLOWING AND {h * 3600}000000 FOLLOWING), 0) > severity_rank THEN 1 ELSE 0 END
      AS escalated_{h}h"""
    for h in (1, 3, 6)
)


@query(
    "escalation_labels",
    with_views(
        f"""r AS (SELECT *, sensor_id % 8 AS region FROM hazard_events) SELECT seq, {_LABELS} FROM r""",
        "hazard_events",
    ),
)
def escalation_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).withColumn("region", F.col("sensor_id") % 8)
    rows = rows.select("seq", "event_type", "region", "ts", "severity_rank")
    found = history.escalation_labels(
        rows, ["event_type", "region"], "severity_rank", chunk_seconds=suggest_seconds(rows, "ts")
    )
    return found.select("seq", *[f"escalated_{h}h" for h in (1, 3, 6)])


# --- drift ---------------------------------------------------------------------------------------------


def _baseline(rows: DataFrame, label: str = "predicted_severity") -> dict[str, float]:
    """Rows per severity of the whole table, in the fixed class order (at most four numbers)."""
    counts = rows.where(F.col(label).isin(dims.SEVERITIES)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    found = {r[label]: float(r["n"]) for r in counts.collect()}
    return {c: found[c] for c in dims.SEVERITIES if c in found}


_CLASSES = dims.SEVERITIES


def _drift_sql(keys: list[str], window: int, shares: str, label: str = "predicted_severity") -> str:
    """Alerts from a plain sliding window, with the class shares given by a CTE ``b``."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    key_list = "".join(f"{k}, " for k in keys)
    counts = ", ".join(
        f"""COUNT(*) FILTER (WHERE {label} = '{c}') OVER ({part}ORDER BY ts, seq
          ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) / {window}::DOUBLE AS w{i}"""
        for i, c in enumerate(_CLASSES)
    )
    drifts = ", ".join(f"abs(w{i} - b{i})" for i in range(4))
    at = "CASE " + " ".join(f"WHEN abs(w{i} - b{i}) = d THEN {{{i}}}" for i in range(4)) + " END"
    name = at.format(*[f"'severity_distribution_{c}'" for c in _CLASSES])
    return with_views(
        f"""b AS ({shares}), w AS (SELECT {key_list}seq, ROW_NUMBER() OVER ({part}ORDER BY ts, seq) AS idx, {counts}
        FROM hazard_events), x AS (SELECT w.*, b.*, greatest({drifts}) AS d FROM w, b WHERE idx >= {window})
        SELECT {key_list}seq, idx, {name} AS metric_name,
          {sql_round(at.format(*[f'w{i}' for i in range(4)]))} AS current_value,
          {sql_round(at.format(*[f'b{i}' for i in range(4)]))} AS baseline_value, {sql_round('d')} AS drift_magnitude,
          CASE WHEN d >= 0.30::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END AS severity
        FROM x WHERE d >= 0.15::DOUBLE""",
        "hazard_events",
    )


_OBSERVED = "SELECT " + ", ".join(
    f"COUNT(*) FILTER (WHERE predicted_severity = '{c}') / COUNT(*)::DOUBLE AS b{i}" for i, c in enumerate(_CLASSES)
) + " FROM hazard_events"
_UNIFORM = "SELECT " + ", ".join(f"0.25::DOUBLE AS b{i}" for i in range(4))
_ALERT = ["idx", "metric_name", "current_value", "baseline_value", "drift_magnitude", "severity"]


def _alerts(found: DataFrame, keys: list[str]) -> DataFrame:
    rounded = {c: r6(c) for c in ("current_value", "baseline_value", "drift_magnitude")}
    return found.withColumns(rounded).select(*keys, "seq", *_ALERT)


def _uniform_drift(spark: SparkSession, sf: str, window: int, keys: list[str]) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", "ts", "source", "predicted_severity")
    uniform = dict.fromkeys(dims.SEVERITIES, 0.25)
    width = suggest_seconds(rows, "ts")
    return drift.prediction_drift(rows, uniform, keys, event_id="seq", window=window, chunk_seconds=width)


@query("prediction_drift", _drift_sql([], 1000, _UNIFORM))
def prediction_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Unkeyed drift of the last 1000 predictions against even shares."""
    return _alerts(_uniform_drift(spark, sf, 1000, []), [])


@query("prediction_drift_by_source", _drift_sql(["source"], 1000, _UNIFORM))
def prediction_drift_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(_uniform_drift(spark, sf, 1000, ["source"]), ["source"])


@query(
    "drift_messages",
    f"""SELECT source, seq, concat(CASE severity WHEN 'CRITICAL' THEN 'Critical drift in ' ELSE 'Drift detected in ' END,
      replace(metric_name, 'severity_distribution_', ''), printf(': %.1f%% from baseline', drift_magnitude * 100)) AS message
    FROM ({_drift_sql(['source'], 1000, _UNIFORM)})""",
)
def drift_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the drift alerts."""
    return _uniform_drift(spark, sf, 1000, ["source"]).select("source", "seq", "message")


@query("prediction_drift_observed", _drift_sql(["source"], 20, _OBSERVED))
def prediction_drift_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Short windows against the whole table's own shares."""
    rows = hazard_events(spark, sf).select("seq", "ts", "source", "predicted_severity")
    width = suggest_seconds(rows, "ts")
    found = drift.prediction_drift(
        rows, _baseline(rows), ["source"], event_id="seq", window=20, chunk_seconds=width
    )
    return _alerts(found, ["source"])


@query("recent_alerts", f"SELECT * FROM ({_drift_sql([], 1000, _UNIFORM)}) ORDER BY idx DESC LIMIT 20")
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(drift.recent_alerts(_uniform_drift(spark, sf, 1000, []), event_id="seq"), [])


@query(
    "baseline_shares",
    with_views(
        f"""SELECT predicted_severity AS severity, {sql_round('COUNT(*) / SUM(COUNT(*)) OVER ()')} AS share
        FROM hazard_events GROUP BY predicted_severity""",
        "hazard_events",
    ),
)
def baseline_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = hazard_events(spark, sf).groupBy(F.col("predicted_severity").alias("severity")).count()
    return drift.baseline_shares(counts, weight="count").withColumn("share", r6("share"))


@query(
    "distribution_comparison",
    with_views(
        f"""base AS (SELECT observed_severity AS severity, COUNT(*) / SUM(COUNT(*)) OVER () AS s
          FROM hazard_events WHERE observed_severity <> 'MINOR' GROUP BY 1),
        recent AS (SELECT predicted_severity AS severity, COUNT(*) / SUM(COUNT(*)) OVER () AS s
          FROM hazard_events WHERE predicted_severity <> 'EXTREME' GROUP BY 1)
        SELECT b.severity, {sql_round('b.s')} AS baseline_share, {sql_round('coalesce(r.s, 0)')} AS recent_share,
          {sql_round('abs(coalesce(r.s, 0) - b.s)')} AS drift FROM base b LEFT JOIN recent r ON b.severity = r.severity""",
        "hazard_events",
    ),
)
def distribution_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Classes missing on either side: absent recent classes count 0, unknown ones are left out."""
    rows = hazard_events(spark, sf)
    base = rows.where("observed_severity <> 'MINOR'").groupBy(F.col("observed_severity").alias("severity")).count()
    new = rows.where("predicted_severity <> 'EXTREME'").groupBy(F.col("predicted_severity").alias("severity")).count()
    found = drift.compare_distributions(
        drift.baseline_shares(new, weight="count"), drift.baseline_shares(base, weight="count")
    )
    return found.select("severity", *[r6(c).alias(c) for c in ("baseline_share", "recent_share", "drift")])


# --- sequences -----------------------------------------------------------------------------------------

TYPES = ["Wildfire Warning", "earthquake", "Hurricane", "Flash Flood", "Unusual Event"]


def hazard_bins(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.hourly_bins(hazard_events(spark, sf), "event_type", TYPES)


_TYPE_SQL = ", ".join(
    f"COUNT(*) FILTER (WHERE event_type = '{t}') AS t{i}, AVG(value) FILTER (WHERE event_type = '{t}') AS a{i}"
    for i, t in enumerate(TYPES)
)
_BINS = f"""own AS (SELECT event_type, date_trunc('hour', ts) AS h, COUNT(*) AS n, SUM(value) AS s, MIN(value) AS lo,
    MAX(value) AS hi, MAX(severity_rank) AS top FROM hazard_events GROUP BY ALL),
  per AS (SELECT date_trunc('hour', ts) AS h, {_TYPE_SQL} FROM hazard_events GROUP BY ALL),
  spans AS (SELECT event_type, MIN(h) AS a, MAX(h) AS b FROM own GROUP BY event_type),
  grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM spans),
  bins AS (SELECT g.event_type, g.h, coalesce(n, 0)::DOUBLE AS n, coalesce(s, 0)::DOUBLE AS s,
    coalesce(s / n, 0)::DOUBLE AS av, coalesce(lo, 0)::DOUBLE AS lo, coalesce(hi, 0)::DOUBLE AS hi,
    {', '.join(f'coalesce(t{i}, 0)::DOUBLE AS t{i}, coalesce(a{i}, 0)::DOUBLE AS a{i}' for i in range(5))},
    coalesce(top, 0) AS top
    FROM grid g LEFT JOIN own o ON g.event_type = o.event_type AND g.h = o.h LEFT JOIN per p ON g.h = p.h)"""
_READINGS = ["n", "s", "av", "lo", "hi", *[f"t{i}" for i in range(5)], *[f"a{i}" for i in range(5)]]
_W24 = "OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query(
    "hourly_readings",
    with_views(
        f"""{_BINS} SELECT event_type, {sql_stamp('h')} AS hour, {', '.join(f'{sql_round(r)} AS {r}' for r in _READINGS)},
        CAST(top AS INTEGER) AS top FROM bins""",
        "hazard_events",
    ),
)
def hourly_readings(spark: SparkSession, sf: str) -> DataFrame:
    bins = hazard_bins(spark, sf)
    names = [c for c in bins.columns if c.startswith("r_")]
    return bins.select(
        "event_type",
        stamp("hour").alias("hour"),
        *[r6(c).alias(n) for c, n in zip(names, _READINGS, strict=True)],
        F.col("top_rank").alias("top"),
    )


_WEIGHTED = [
    f"list_sum(list_transform(list({r}) {_W24}, lambda x, i: x * i * {j + 1}))" for j, r in enumerate(_READINGS)
]


@query(
    "sensor_sequences",
    with_views(
        f"""{_BINS}, q AS (SELECT event_type, h, COUNT(*) {_W24} AS n_steps, first_value(n) {_W24} AS oldest,
          {', '.join(f'{w} AS w{j}' for j, w in enumerate(_WEIGHTED))} FROM bins)
        SELECT event_type, {sql_stamp('h')} AS hour, CAST(n_steps AS BIGINT) AS n_steps, oldest AS oldest_count,
          floor(({' + '.join(f'w{j}' for j in range(15))}) * 1000 + 0.37) / 1000 AS weighted_total FROM q""",
        "hazard_events",
    ),
)
def sensor_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences condensed to a total weighted by step and reading position.

    Averages of cents often end in 5, so the cut-off is kept away from the half.
    """
    rows = sequences.assemble(hazard_bins(spark, sf), "event_type")
    weighted = F.aggregate(
        F.transform(
            "sequence",
            lambda step, i: F.aggregate(
                F.transform(step, lambda x, j: x * (i + 1) * (j + 1)), F.lit(0.0), lambda acc, x: acc + x
            ),
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return rows.select(
        "event_type",
        stamp("hour").alias("hour"),
        "n_steps",
        F.col("sequence")[0][0].alias("oldest_count"),
        (F.floor(weighted * 1000 + 0.37).cast("double") / 1000).alias("weighted_total"),
    )


_STEP_LABELS = ", ".join(
    f"""CASE WHEN MAX(top) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) > top
      THEN 1 ELSE 0 END AS y{k}h"""
    for k in (1, 3, 6)
)


@query(
    "sequence_labels",
    with_views(f"{_BINS} SELECT event_type, {sql_stamp('h')} AS hour, {_STEP_LABELS} FROM bins", "hazard_events"),
)
def sequence_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences.step_labels(hazard_bins(spark, sf), "event_type")
    return rows.select("event_type", stamp("hour").alias("hour"), "y1h", "y3h", "y6h")


# --- reuse ---------------------------------------------------------------------------------------------

TWO_DAYS = 172_800
_REUSE = f"""o AS (SELECT sensor_id, event_type, seq, epoch_us(ts) AS t,
    ROW_NUMBER() OVER (PARTITION BY sensor_id, event_type ORDER BY ts, seq) AS rn FROM hazard_events),
  f AS (SELECT sensor_id, event_type, seq, rn, t AS put, seq AS src FROM o WHERE rn = 1
    UNION ALL
    SELECT o.sensor_id, o.event_type, o.seq, o.rn,
      CASE WHEN o.t - f.put <= CAST({TWO_DAYS} AS BIGINT) * 1000000 THEN f.put ELSE o.t END,
      CASE WHEN o.t - f.put <= CAST({TWO_DAYS} AS BIGINT) * 1000000 THEN f.src ELSE o.seq END
    FROM f JOIN o ON o.sensor_id = f.sensor_id AND o.event_type = f.event_type AND o.rn = f.rn + 1)"""


def marked_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", "sensor_id", "event_type", "ts", "value")
    return reuse.mark_reuse(rows, ["sensor_id", "event_type"], event_id="seq", ttl_seconds=TWO_DAYS)


@query(
    "prediction_reuse",
    with_views(
        f"{_REUSE} SELECT seq, src AS source_id, seq <> src AS reused FROM f", "hazard_events", recursive=True
    ),
)
def prediction_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return marked_events(spark, sf).select("seq", "source_id", "reused")


@query(
    "reuse_stats",
    with_views(
        f"""{_REUSE} SELECT COUNT(*) FILTER (WHERE seq <> src) AS hits, COUNT(*) FILTER (WHERE seq = src) AS misses,
        (SELECT COUNT(*) FROM o WHERE rn = 1) AS size,
        {sql_round('COUNT(*) FILTER (WHERE seq <> src) / COUNT(*)')} AS hit_rate,
        {TWO_DAYS}::DOUBLE AS default_ttl_seconds FROM f""",
        "hazard_events",
        recursive=True,
    ),
)
def reuse_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = reuse.reuse_stats(marked_events(spark, sf), ["sensor_id", "event_type"], TWO_DAYS)
    return stats.withColumn("hit_rate", r6("hit_rate"))


@query(
    "shared_predictions",
    with_views(
        f"""{_REUSE} SELECT f.seq, f.src AS source_id, s.observed_severity AS severity FROM f
        JOIN hazard_events s ON s.seq = f.src""",
        "hazard_events",
        recursive=True,
    ),
)
def shared_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with the severity its source row was given."""
    marked = marked_events(spark, sf)
    fresh = marked.where(~F.col("reused")).select("seq")
    scored = hazard_events(spark, sf).select("seq", F.col("observed_severity").alias("severity")).join(fresh, "seq", "left_semi")
    return reuse.share_predictions(marked, scored, "seq").select("seq", "source_id", "severity")
