"""Stream jobs run over the whole event table, compared with the batch results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hazardflow import dims, session
from hazardflow.checks import monitoring
from hazardflow.checks.fixtures import HAZARD_EVENTS, hazard_events, table, with_views
from hazardflow.checks.history import _REUSE, TWO_DAYS, _drift_sql, _UNIFORM
from hazardflow.checks.registry import query, r6, sql_round, sql_stamp, stamp
from hazardflow.checks.requests import answer_rows, answers_sql, as_requests, fixed_escalation, fixed_severity
from hazardflow.operators import metrics
from hazardflow.sources.sinks import keyed_messages
from hazardflow.streaming import jobs, state


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a file stream, as hazard events; all files that are there come in one micro-batch."""
    schema = table(spark, sf, "events").schema
    # A pattern matches the table both as one file and as a folder of files.
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    return spark.sql(HAZARD_EVENTS.replace("FROM events", "FROM {src}"), src=raw)


def _finished(
    spark: SparkSession, stream: DataFrame, purpose: str, mode: str = "append", empty_batches: bool = True
) -> DataFrame:
    """Run the stream to its end into the shared folder and read what it wrote."""
    folder = session.shared_dir(spark, purpose)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode)
    )
    jobs.run_available(spark, writer, empty_batches=empty_batches)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _newest(spark: SparkSession, stream: DataFrame, purpose: str, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream that emits changed rows to its end; the last version of every row."""
    folder = session.shared_dir(spark, purpose)
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/version={number}"))
    )
    jobs.run_available(spark, writer)
    schema = StructType([*stream.schema.fields, StructField("version", LongType())])
    versions = spark.read.schema(schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("l"))
    return newest.select(*keys, "l.*")


@query(
    "stream_rates",
    with_views(
        f"""w AS (SELECT source, time_bucket(INTERVAL 1 MINUTE, ts) AS b, COUNT(*) AS n, SUM(latency_ms) AS t,
          COUNT(*) FILTER (WHERE latency_ms <= 250) AS le_250 FROM hazard_events GROUP BY 1, 2)
        SELECT source, {sql_stamp('b')} AS window_start, n, {sql_round('t', 4)} AS total_ms, le_250 FROM w""",
        "hazard_events",
    ),
)
def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """One-minute windows per source, the open ones too: every micro-batch writes the windows it changed, the last one counts."""
    rates = jobs.rate_stream(event_stream(spark, sf), keys=["source"], lateness=None)
    done = _newest(spark, rates, "rates", "update", ["source", "window_start"])
    total = F.floor(F.col("total_ms") * 10000 + 0.5).cast("double") / 10000
    return done.select("source", stamp("window_start").alias("window_start"), "n", total.alias("total_ms"), "le_250")


# Bucket counts of the five panes of each window.
_SLID = f"""p AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS b, COUNT(*) AS n, {monitoring._LE} FROM hazard_events GROUP BY 1),
  w AS (SELECT b - k * INTERVAL 1 MINUTE AS b, SUM(n) AS n, {', '.join(f'SUM(le{i}) AS le{i}' for i in range(len(dims.LATENCY_BOUNDS)))}
    FROM p, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY 1)"""
_SLID_ROWS = f"""SELECT {sql_stamp('b')} AS window_start, n::BIGINT AS observations, {monitoring._sql_quantile(0.5)} AS p50,
  {monitoring._sql_quantile(0.95)} AS p95, {monitoring._sql_quantile(0.99)} AS p99 FROM w"""


def _slid(found: DataFrame) -> DataFrame:
    return found.select(stamp("window_start").alias("window_start"), "observations", *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


@query("sliding_quantiles", with_views(f"{_SLID} {_SLID_ROWS}", "hazard_events"))
def sliding_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute windows that begin every minute, from shared one-minute panes."""
    return _slid(metrics.sliding_quantiles(monitoring.triage_log(spark, sf)))


@query(
    "stream_quantiles",
    with_views(
        f"""{_SLID} {_SLID_ROWS} WHERE epoch_ms(b) + 300000 <= (SELECT MAX(epoch_ms(ts)) FROM hazard_events) - 600000""",
        "hazard_events",
    ),
)
def stream_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows from the stream, those that the watermark has closed."""
    return _slid(_finished(spark, jobs.quantile_stream(event_stream(spark, sf)), "quantiles"))


@query(
    "stream_bounded_batches",
    with_views("SELECT seq % 4 AS part, COUNT(*) AS n, 1::BIGINT AS parts_in_batch FROM hazard_events GROUP BY 1", "hazard_events"),
)
def stream_bounded_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Events landed as four files and read one file a micro-batch: rows per file, and files per batch."""
    folder = session.shared_dir(spark, "bounded")
    landed = hazard_events(spark, sf).select("seq", (F.col("seq") % 4).alias("part"))
    landed.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{folder}/in")
    schema = "seq bigint, part bigint"
    stream = jobs.bounded_batches(spark.readStream.schema(schema), files=1).parquet(f"{folder}/in")
    counts = stream.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    writer = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.parquet(f"{folder}/out/{number}"))
    )
    jobs.run_available(spark, writer)
    done = spark.read.schema("part bigint, n bigint, batch bigint").parquet(f"{folder}/out/*")
    per_batch = done.groupBy("batch").agg(F.count(F.lit(1)).alias("parts_in_batch"))
    return done.join(per_batch, "batch").select("part", "n", "parts_in_batch")


@query(
    "stream_reuse",
    with_views(
        f"{_REUSE} SELECT seq AS id, src AS source_id, seq <> src AS reused FROM f", "hazard_events", recursive=True
    ),
)
def stream_reuse(spark: SparkSession, sf: str) -> DataFrame:
    state.use_rocksdb(spark)
    events = event_stream(spark, sf)
    marked = state.reuse_stream(events, ["sensor_id", "event_type"], ttl_seconds=TWO_DAYS)
    return _finished(spark, marked, "reuse", empty_batches=False)


@query(
    "stream_drift",
    f"""SELECT source AS key, seq AS id, replace(metric_name, 'severity_distribution_', '') AS severity_class,
    drift_magnitude, severity FROM ({_drift_sql(['source'], 1000, _UNIFORM)})""",
)
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    state.use_rocksdb(spark)
    uniform = dict.fromkeys(dims.SEVERITIES, 0.25)
    alerts = _finished(spark, state.drift_stream(event_stream(spark, sf), uniform, "source"), "drift")
    return alerts.withColumn("drift_magnitude", r6("drift_magnitude"))


@query("stream_triage", answers_sql(TWO_DAYS, clears=True))
def stream_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Requests through the whole job to keyed JSON messages, with held answers and rows that empty them; read back."""
    state.use_rocksdb(spark)
    requests = as_requests(event_stream(spark, sf))
    answers = jobs.triage_stream(
        requests, fixed_severity(), fixed_escalation(), TWO_DAYS, clear="is_clear", prior="prior_24h_event_count"
    )
    written = _finished(spark, keyed_messages(answers), "triage", empty_batches=False)
    schema = StructType([f for f in answers.schema.fields])
    return answer_rows(written.select(F.from_json("value", schema).alias("v")).select("v.*"))


@query("stream_feeds", monitoring._NORMALIZED)
def stream_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """The landed files of all three feeds as one stream of events."""
    events = jobs.feed_stream(spark, *monitoring.landed_feeds(spark, sf))
    return monitoring._normal_rows(_finished(spark, events, "feed-events"))


@query(
    "stream_feed_health",
    with_views(
        f"""SELECT source, {sql_stamp('MAX(polled_at)')} AS polled_at, COUNT(*) AS feed_polls
        FROM (SELECT source, ts AS polled_at FROM hazard_events) GROUP BY source""",
        "hazard_events",
    ),
)
def stream_feed_health(spark: SparkSession, sf: str) -> DataFrame:
    """Each event counted as a poll of its source; the table of last polls is rewritten per micro-batch."""
    polls = event_stream(spark, sf).select("source", F.col("ts").alias("polled_at"))
    newest = _newest(spark, state.feed_health_stream(polls), "health", "complete", ["source"])
    return newest.select("source", stamp("polled_at").alias("polled_at"), "feed_polls")
