"""The triage job: events in, routed responses out.

Without reuse it is one projection without a shuffle. With reuse, events of equal processed inputs share an answer within a
time limit, and only those that nothing answers yet reach the models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardflow import dims
from hazardflow.functions.decisions import channels, escalation_likely, feature_key, sequence_or_zeros
from hazardflow.operators import ranges
from hazardflow.operators.boosting import Trees
from hazardflow.operators.enrich import feature_vector, geo_risk, given_inputs, quality_checked, raw_inputs
from hazardflow.operators.models import score_escalation, score_severity
from hazardflow.operators.reuse import mark_reuse
from hazardflow.operators.sequence_training import SequenceModel

KEY = "_key"
BROADCAST_ROWS = 50_000  # names of so many scored rows are sent to every task; more are looked up in a shuffled hash table


def enriched(
    events: DataFrame, local_ts: str = "ts", prior: str = "prior_24h_event_count", extra: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid events with geographic risk, model features and processed inputs; and rejected ones with reasons."""
    featured = feature_vector(geo_risk(events), local_ts=local_ts, prior=prior)
    return quality_checked(featured, raw_inputs(extra=extra), given_inputs(extra=extra))


def keyed(good: DataFrame) -> DataFrame:
    """Add the key under which answers are shared: a digest of the processed inputs."""
    return good.withColumn(KEY, feature_key([f"in_{n}" for n in dims.INPUT_NAMES]))


def predicted(good: DataFrame, model: Trees | None, escalation: SequenceModel | None, sequence: str | None) -> DataFrame:
    """Add ``severity``, ``confidence`` and ``p3h``; a missing or wrongly shaped sequence is scored as one of zeros."""
    scored = score_severity(good, model)
    if escalation is None:
        return scored.withColumn("p3h", F.lit(None).cast("double"))
    given = F.lit(None).cast("array<array<double>>") if sequence is None else F.col(sequence)
    return score_escalation(scored.withColumn("sequence", sequence_or_zeros(given)), escalation)


def responses(scored: DataFrame, p3h: Column | None = None) -> DataFrame:
    """The response fields of scored rows.

    Processing time is a property of a run, not of a row; read it from query progress.
    """
    probability = F.lit(None).cast("double") if p3h is None else p3h
    return scored.select(
        "event_id",
        "severity",
        "confidence",
        escalation_likely(probability).alias("escalation_likely"),
        probability.alias("escalation_probability_3h"),
        channels(F.col("severity")).alias("recommended_channels"),
        F.col("estimated_affected_population").alias("affected_population_estimate"),
        F.col("composite_risk_score").alias("risk_score"),
    )


def answered_once(
    good: DataFrame, model: Trees | None, escalation: SequenceModel | None, sequence: str | None, seconds: int,
    ts: str = "ts", epoch: str | None = None, parts: int | None = None,
) -> DataFrame:
    """``predicted`` with answers shared within ``seconds``, and ``source_id``, the event whose answer each row takes.

    Rows of different values of ``epoch`` share nothing: a new epoch empties all that is held.
    """
    keys, rest = [KEY, *([epoch] if epoch else [])], ["estimated_affected_population", "composite_risk_score"]
    all_rows, own = keyed(good), [*keys, "event_id", ts]
    marked = ranges.stored(mark_reuse(all_rows.select(*own, *rest), keys, ts, "event_id", seconds, parts), "triage-marked")
    # Features and sequences are no part of what is sorted and stored: only rows that are scored take them along.
    scored = ranges.stored(marked.where("not reused").select(*own), "triage-scored")
    scored = scored.hint("broadcast" if scored.count() <= BROADCAST_ROWS else "shuffle_hash")
    wide = all_rows.select(*own, *dims.MODEL_FEATURES, *([sequence] if sequence else []))
    fresh = predicted(wide.join(scored, own, "left_semi"), model, escalation, sequence)
    answers = fresh.select(F.col("event_id").alias("source_id"), "severity", "confidence", "p3h")
    return marked.join(answers, "source_id")


def triage(
    events: DataFrame,
    model: Trees | None,
    escalation: SequenceModel | None = None,
    local_ts: str = "ts",
    prior: str = "prior_24h_event_count",
    extra: str | None = None,
    sequence: str | None = None,
    reuse_seconds: int | None = None,
    ts: str = "ts",
) -> tuple[DataFrame, DataFrame]:
    """Responses of valid events, and the quarantined events with reasons.

    With ``reuse_seconds`` (0: the default limit), events of equal processed inputs share an answer; event ids must then
    be unique.
    """
    good, bad = enriched(events, local_ts, prior, extra)
    if reuse_seconds is None:
        scored = predicted(good, model, escalation, sequence)
    else:
        scored = answered_once(good, model, escalation, sequence, reuse_seconds, ts)
    return responses(scored, F.col("p3h")), bad


def routing_load(rows: DataFrame, severity: str = "severity", ts: str = "ts") -> DataFrame:
    """Daily notification load per severity and channel with mean risk and affected people.

    The load is aggregated per day and severity first; channels multiply only those few rows.
    """
    daily = rows.groupBy(F.to_date(ts).alias("day"), F.col(severity).alias("severity")).agg(
        F.count(F.lit(1)).alias("notifications"),
        F.avg("composite_risk_score").alias("mean_risk"),
        F.sum("estimated_affected_population").alias("affected_population"),
        F.count_if(F.size("quality_warnings") > 0).alias("with_warnings"),
    )
    routed = daily.withColumn("channel", F.explode(channels(F.col("severity"))))
    return routed.select(
        "day", "severity", "channel", "notifications", "mean_risk", "affected_population", "with_warnings"
    )


def channel_load(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Messages per channel."""
    per_severity = rows.groupBy(F.col(severity).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    per_channel = per_severity.select(F.explode(channels(F.col("severity"))).alias("channel"), "n")
    return per_channel.groupBy("channel").agg(F.sum("n").alias("messages"))
