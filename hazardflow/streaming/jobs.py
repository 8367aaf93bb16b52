"""Stateless and windowed stream jobs: feed ingestion, triage, rates and batching options."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from hazardflow import dims
from hazardflow.functions.decisions import sequence_or_zeros
from hazardflow.operators.boosting import Trees
from hazardflow.operators.metrics import sliding_quantiles
from hazardflow.operators.sequence_training import SequenceModel
from hazardflow.plans.triage import KEY, enriched, keyed, responses, triage
from hazardflow.sources.committed import CommittedTable, upsert_batches
from hazardflow.sources.feeds import normalize, read_cap_feed, read_seismic, read_warnings
from hazardflow.sources.sinks import keyed_messages
from hazardflow.streaming.state import answer_stream

POLL = "60 seconds"  # fixed value: how often landed feed files are looked for
LATENESS = "10 minutes"


def feed_stream(spark: SparkSession, cap: str | None, seismic: str | None, warnings: str | None) -> DataFrame:
    """The landed feeds as one stream of events; a feed that brings nothing does not hold up the others."""
    return normalize(
        None if cap is None else read_cap_feed(spark, cap, stream=True),
        None if seismic is None else read_seismic(spark, seismic, stream=True),
        None if warnings is None else read_warnings(spark, warnings, stream=True),
    )


def bounded_batches(reader: DataStreamReader, files: int | None = None, offsets: int | None = None) -> DataStreamReader:
    """Limit the work per micro-batch, by files or by topic offsets; the trigger sets the waiting time."""
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", offsets)
    return reader


def as_requests(events: DataFrame) -> DataFrame:
    """Normalized feed events with the column names of triage requests; events without a point on the globe are left out.

    The clock of the event's own place decides the time-of-day feature. See ``unplaced`` for the rest.
    """
    placed = events.where(on_globe())
    return placed.select(
        "event_id",
        "source",
        "event_type",
        F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        "ts",
        "_local_ts",
        F.create_map().cast("map<string,double>").alias("additional_features"),
    )


def on_globe() -> Column:
    """Both coordinates there and in range; NaN and infinities are not."""
    return F.coalesce(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0), F.lit(False))


def unplaced(events: DataFrame) -> DataFrame:
    """The events that ``as_requests`` leaves out, with the reason, for the quarantine."""
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    reason = F.when(missing, F.lit("point missing")).otherwise(F.lit("point out of range"))
    return events.where(~on_globe()).withColumn("problems", F.array(reason))


def triage_rows(
    requests: DataFrame, model: Trees | None, escalation: SequenceModel | None = None
) -> tuple[DataFrame, DataFrame]:
    """Responses of valid requests and the rejected rest; stateless, so it runs alike on tables and streams."""
    extra = "additional_features"
    prior = F.try_element_at(extra, F.lit("prior_24h_event_count"))
    sequence = "sensor_sequence" if "sensor_sequence" in requests.columns else None
    return triage(requests.withColumn("_prior", prior), model, escalation, "_local_ts", "_prior", extra, sequence)


def triage_messages(
    requests: DataFrame, model: Trees | None, escalation: SequenceModel | None = None
) -> DataFrame:
    """Keyed JSON results, ready for a topic."""
    answers, _ = triage_rows(requests, model, escalation)
    return keyed_messages(answers)


def triage_stream(
    requests: DataFrame,
    model: Trees | None,
    escalation: SequenceModel | None = None,
    seconds: int = dims.REUSE_TTL_SECONDS,
    clear: str | None = None,
    extra: str | None = "additional_features",
    prior: str | None = None,
) -> DataFrame:
    """Responses of valid requests whose answers are held and shared within ``seconds``: the whole job as one stream.

    A row with ``clear`` true is no request: it empties all that is held, from its time on. ``prior`` names the count of
    events before, which else comes from the request's own map.
    """
    given = F.lit(False) if clear is None else F.coalesce(F.col(clear), F.lit(False))
    count = F.try_element_at(F.col(extra), F.lit("prior_24h_event_count")) if prior is None else F.col(prior)
    good, _ = enriched(requests.withColumns({"_prior": count, "_clear": given}).where("not _clear"), "_local_ts", "_prior", extra)
    good = keyed(good)
    none = F.lit(None).cast("array<double>")
    has_sequence = escalation is not None and "sensor_sequence" in requests.columns
    flat = F.flatten(sequence_or_zeros(F.col("sensor_sequence"))) if has_sequence else none
    rows = good.select(
        KEY, "event_id", "ts", F.array(*dims.MODEL_FEATURES).alias("features"), flat.alias("sequence"),
        "estimated_affected_population", "composite_risk_score", F.lit(False).alias("clear"),
    )
    if clear is not None:
        # Read from the same stream, so that an emptying row keeps its place among the requests.
        tombs = requests.where(F.coalesce(F.col(clear), F.lit(False)))
        rows = rows.unionByName(tombs.select("event_id", "ts", F.lit(True).alias("clear")), allowMissingColumns=True)
    answers = answer_stream(rows, KEY, model, escalation, seconds)
    return responses(answers, F.col("p3h"))


def rate_stream(
    events: DataFrame,
    ts: str = "ts",
    window: str = "1 minute",
    slide: str | None = None,
    keys: list[str] | None = None,
    lateness: str | None = LATENESS,
) -> DataFrame:
    """Events and latency totals per window; rows later than the allowed lateness are dropped.

    Without a lateness no row is ever late: run it in ``update`` mode and keep the last row of each window; state then grows
    by one row per window and key. ``ts`` may be wall-clock time, which is read as UTC because watermarks need an instant.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed if lateness is None else timed.withWatermark(ts, lateness)
    span = F.window(ts, window) if slide is None else F.window(ts, window, slide)
    grouped = timed.groupBy(*(keys or []), span.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("latency_ms").alias("total_ms"),
        *[F.count_if(F.col("latency_ms") <= b).alias(f"le_{b:.0f}") for b in dims.LATENCY_BOUNDS],
    )
    return grouped.select(
        *(keys or []), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        *[c for c in grouped.columns if c not in {"w", *(keys or [])}],
    )


def quantile_stream(
    events: DataFrame, ts: str = "ts", window: str = "5 minutes", slide: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Latency quantiles of sliding windows, each once, when the watermark has passed its end.

    State is one row of bucket counts for each open pane and window. Rows later than ``lateness`` are dropped and counted
    (``late_rows``).
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return sliding_quantiles(timed, ts, window=window, slide=slide)


def late_rows(progress: list[dict]) -> int:
    """Rows dropped as late, from the progress reports of a query."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for report in progress for op in report.get("stateOperators", [])
    )


def distinct_within(events: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """The simple form of reuse: later rows of a key within the limit are dropped instead of answered."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl)
    return timed.dropDuplicatesWithinWatermark(keys)


STATUS = "source string, item_count bigint, polled_at timestamp"


def upsert_status(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds a micro-batch of polls into the small status table (``status_table``)."""

    def timed(current: DataFrame, polls: DataFrame) -> DataFrame:
        return merge(current, polls.withColumn("polled_at", F.col("polled_at").cast("timestamp")))

    return upsert_batches(path, STATUS, timed)


def status_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed status table."""
    return CommittedTable(spark, path, STATUS, replaces=True).read()


def poll(writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream that looks for new files at the polling interval until it is stopped."""
    return writer.trigger(processingTime=POLL).start()


def run_available(spark: SparkSession, writer: DataStreamWriter, seconds: int = 600, empty_batches: bool = True) -> list[dict]:
    """Run a stream over everything that is there, stop, and return its progress reports.

    ``empty_batches=False`` is for operators on the cluster's clock, which would ask for another batch without end; those on
    event time need the empty batch that follows a watermark.
    """
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(empty_batches).lower())
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream not finished after {seconds} seconds")
    return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
