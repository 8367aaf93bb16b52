"""Model training and scoring over the event tables, at the library's full settings.

A fit's numbers are its own, so SQL states what must hold of them: which rows come out, counts and labels of the
report, shares that sum to one, channels that match, the kept epoch. A fact is a column that must be true.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazardflow import dims, session
from hazardflow.checks.fixtures import hazard_events, with_views
from hazardflow.checks.history import _BINS, _STEP_LABELS, _W24, hazard_bins
from hazardflow.checks.registry import query, r6, sql_round, sql_stamp, stamp
from hazardflow.functions.decisions import channels
from hazardflow.operators import enrich, evaluation, models, sequences
from hazardflow.sources.tables import read_sequences


def featured(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.feature_vector(enrich.geo_risk(hazard_events(spark, sf)))
    return rows.select("event_id", F.col("observed_severity").alias("label_severity"), *dims.MODEL_FEATURES)


@cache
def _severity_folder(application: str, sf: str) -> str:
    """Folder of the model fitted to four fifths of the events; one fit for each session and table."""
    spark = SparkSession.active()
    train, _ = evaluation.train_test(featured(spark, sf))
    folder = session.shared_dir(spark, "severity-model")
    models.save_model(models.train_severity(train, label="label_severity", row_id="event_id"), folder)
    return folder


def severity_model(spark: SparkSession, sf: str) -> models.Trees:
    return models.load_model(_severity_folder(spark.sparkContext.applicationId, sf))


def _between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


_SPLIT = "CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT) % 5"


@query(
    "severity_training",
    with_views(
        f"""held AS (SELECT observed_severity AS label FROM hazard_events WHERE {_SPLIT} = 0),
        n AS (SELECT COUNT(*) AS total, (SELECT COUNT(*) FROM hazard_events) - COUNT(*) AS fitted FROM held)
        SELECT s AS class, coalesce((SELECT COUNT(*) FROM held WHERE label = s), 0) AS support, fitted AS fitted_rows,
          {models.TREES * len(models.CLASSES)}::BIGINT AS trees, true AS in_range, true AS better_than_guessing
        FROM n, unnest({dims.SEVERITIES}) AS u(s)
        UNION ALL SELECT c, total, fitted, {models.TREES * len(models.CLASSES)}, true, true
        FROM n, unnest(['accuracy', 'macro avg', 'weighted avg']) AS u(c)""",
        "hazard_events",
    ),
)
def severity_training(spark: SparkSession, sf: str) -> DataFrame:
    """Report on the events kept out of the fit: exact supports, and scores that beat the most frequent class."""
    fitted = severity_model(spark, sf)
    _, test = evaluation.train_test(featured(spark, sf))
    report = evaluation.classification_report(models.score_severity(test, fitted), "label_severity", "severity")
    largest = F.max(F.when(F.col("class").isin(dims.SEVERITIES), F.col("support"))).over(Window.partitionBy(F.lit(1)))
    total, accuracy = (F.max(F.when(F.col("class") == "accuracy", F.col(c))).over(Window.partitionBy(F.lit(1))) for c in ("support", "precision"))
    scores = [_between(c, 0, 1) for c in ("precision", "recall", "f1")]
    return report.select(
        "class",
        "support",
        F.lit(fitted.rows).cast("bigint").alias("fitted_rows"),
        F.lit(len(fitted.feature)).cast("bigint").alias("trees"),
        (scores[0] & scores[1] & scores[2]).alias("in_range"),
        (accuracy * total > largest).alias("better_than_guessing"),
    )


def _scored_facts(scored: DataFrame) -> DataFrame:
    """One row for each event with what must hold of its prediction."""
    share = F.aggregate("probabilities", F.lit(0.0), lambda acc, p: acc + p)
    weight = F.aggregate(F.map_values("feature_importance"), F.lit(0.0), lambda acc, p: acc + p)
    at = F.array_position(F.array(*[F.lit(c) for c in models.CLASSES]), F.col("severity")).cast("int")
    return scored.select(
        "event_id",
        (F.abs(share - 1) < 1e-9).alias("shares_sum"),
        ((F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("confident"),
        (F.element_at("probabilities", at) == F.col("confidence")).alias("most_likely"),
        ((F.size("feature_importance") == len(dims.MODEL_FEATURES)) & (F.abs(weight - 1) < 1e-9)).alias("weighted"),
        (F.col("channels") == channels(F.col("severity"))).alias("routed"),
    )


_SCORED_SQL = with_views(
    "SELECT event_id, true AS shares_sum, true AS confident, true AS most_likely, true AS weighted, true AS routed FROM hazard_events",
    "hazard_events",
)


@query("severity_scoring", _SCORED_SQL)
def severity_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_facts(models.score_severity(featured(spark, sf), severity_model(spark, sf)))


@query(
    "severity_scoring_distinct",
    with_views("SELECT event_id, true AS same_severity, true AS same_confidence FROM hazard_events", "hazard_events"),
)
def severity_scoring_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring each distinct vector once gives what scoring every row gives."""
    fitted = severity_model(spark, sf)
    shared = models.score_distinct(featured(spark, sf), fitted).select("event_id", "severity", "confidence")
    plain = models.score_severity(featured(spark, sf), fitted)
    plain = plain.select("event_id", F.col("severity").alias("own"), F.col("confidence").alias("own_confidence"))
    return shared.join(plain, "event_id").select(
        "event_id", (F.col("severity") == F.col("own")).alias("same_severity"),
        (F.col("confidence") == F.col("own_confidence")).alias("same_confidence"),
    )


@query(
    "feature_importances",
    with_views(
        f"""SELECT COUNT(*) AS events, {len(dims.MODEL_FEATURES)}::BIGINT AS features, true AS sum_is_one, true AS in_order,
        'magnitude_or_wind_speed' AS first FROM hazard_events""",
        "hazard_events",
    ),
)
def feature_importances(spark: SparkSession, sf: str) -> DataFrame:
    """The label follows the value of an event, so the magnitude leads; the five largest are in order."""
    fitted = severity_model(spark, sf)
    total = models.feature_importances(spark, fitted).agg(
        F.count("*").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"),
        F.max_by("feature", "importance").alias("first"),
    )
    top = [r["importance"] for r in models.feature_importances(spark, fitted, top=5).collect()]
    in_order = len(top) == 5 and top == sorted(top, reverse=True)
    events = hazard_events(spark, sf).agg(F.count("*").alias("events"))
    return events.join(total).withColumn("in_order", F.lit(in_order)).select("events", "features", "sum_is_one", "in_order", "first")


def _sequence_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bins = sequences.step_labels(hazard_bins(spark, sf), "event_type")
    rows = sequences.full_sequences(sequences.assemble(bins, "event_type"))
    rows = rows.select("event_type", "hour", "sequence", *[f"y{h}h" for h in models.HORIZONS])
    return evaluation.time_split(rows, "hour")


@cache
def _escalation_folder(application: str, sf: str) -> str:
    spark = SparkSession.active()
    train, held = _sequence_sets(spark, sf)
    folder = session.shared_dir(spark, "escalation-model")
    models.save_model(models.train_escalation(train, held), folder)
    return folder


def escalation_model(spark: SparkSession, sf: str) -> models.SequenceModel:
    return models.load_escalation(_escalation_folder(spark.sparkContext.applicationId, sf))


# Full sequences with their labels, and the first hour of the last fifth of their rows.
_SETS = f"""{_BINS}, labeled AS (SELECT event_type, h, COUNT(*) {_W24} AS steps, {_STEP_LABELS} FROM bins),
  whole AS (SELECT * FROM labeled WHERE steps = 24),
  hours AS (SELECT h, SUM(COUNT(*)) OVER (ORDER BY h) AS c, SUM(COUNT(*)) OVER () AS t FROM whole GROUP BY h),
  cut AS (SELECT MIN(h) + INTERVAL 1 HOUR AS h FROM hours WHERE c >= 0.8::DOUBLE * t),
  held AS (SELECT whole.* FROM whole, cut WHERE whole.h >= cut.h)"""


@query(
    "sequence_table",
    with_views(
        f"""{_BINS}, labeled AS (SELECT event_type, h, COUNT(*) {_W24} AS steps, {_STEP_LABELS} FROM bins)
        SELECT steps = 24 AS valid, y3h::DOUBLE AS y, COUNT(*) AS n FROM labeled GROUP BY ALL""",
        "hazard_events",
    ),
)
def sequence_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labeled sequences written as a training table and read back."""
    bins = sequences.step_labels(hazard_bins(spark, sf), "event_type")
    rows = sequences.assemble(bins, "event_type")
    path = session.shared_dir(spark, "sequences")
    rows.select(F.col("sequence").cast("array<array<float>>").alias("seq"), F.col("y3h").cast("float").alias("y")).write.parquet(path)
    table = read_sequences(spark, path)
    return table.groupBy("valid", F.col("y").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "escalation_training",
    with_views(
        f"""{_SETS} SELECT k::INTEGER AS horizon,
          SUM(CASE k WHEN 1 THEN y1h WHEN 3 THEN y3h ELSE y6h END)::BIGINT AS positives,
          SUM(1 - CASE k WHEN 1 THEN y1h WHEN 3 THEN y3h ELSE y6h END)::BIGINT AS negatives,
          20::BIGINT AS epochs, true AS best_kept, true AS in_range
        FROM held, unnest([1, 3, 6]) AS u(k) GROUP BY k""",
        "hazard_events",
    ),
)
def escalation_training(spark: SparkSession, sf: str) -> DataFrame:
    """Validation AUC and precision per horizon after training on the earlier hours, and the epoch that was kept."""
    fitted = escalation_model(spark, sf)
    _, held = _sequence_sets(spark, sf)
    scored = models.score_escalation(held, fitted)
    long = scored.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon"), F.col(f"p{h}h").alias("score"), F.col(f"y{h}h").alias("label"))
                    for h in models.HORIZONS
                ]
            )
        ).alias("e")
    ).select("e.*")
    metrics = evaluation.auc(long, "score", "label", ["horizon"]).join(
        evaluation.threshold_metrics(long, "score", "label", 0.5, ["horizon"]).drop("positives"), "horizon"
    )
    best = fitted.losses.index(min(fitted.losses)) == fitted.best_epoch
    return metrics.select(
        "horizon", "positives", "negatives", F.lit(len(fitted.losses)).cast("bigint").alias("epochs"),
        F.lit(best).alias("best_kept"),
        (F.coalesce(_between("auc", 0, 1), F.lit(True)) & _between("precision", 0, 1) & _between("recall", 0, 1)).alias("in_range"),
    )


@query(
    "escalation_scoring",
    with_views(
        f"""{_SETS} SELECT event_type, {sql_stamp('h')} AS hour, true AS in_range, true AS likely_by_3h, true AS mean_of_three
        FROM held""",
        "hazard_events",
    ),
)
def escalation_scoring(spark: SparkSession, sf: str) -> DataFrame:
    _, held = _sequence_sets(spark, sf)
    scored = models.score_escalation(held, escalation_model(spark, sf))
    inside = [(F.col(f"p{h}h") > 0) & (F.col(f"p{h}h") < 1) for h in models.HORIZONS]
    mean = (F.col("p1h") + F.col("p3h") + F.col("p6h")) / 3
    return scored.select(
        "event_type",
        stamp("hour").alias("hour"),
        (inside[0] & inside[1] & inside[2]).alias("in_range"),
        (F.col("escalation_likely") == (F.col("p3h") >= dims.ESCALATION_THRESHOLD)).alias("likely_by_3h"),
        (F.abs(F.col("escalation_confidence") - mean) < 1e-12).alias("mean_of_three"),
    )


def threshold_model(batch: pd.DataFrame) -> pd.DataFrame:
    """A user model: severity by magnitude share alone."""
    score = batch["magnitude_or_wind_speed"]
    severity = pd.cut(score, [-float("inf"), 0.175, 0.4, 0.75, float("inf")], right=False, labels=dims.SEVERITIES[::-1])
    return pd.DataFrame({"event_id": batch["event_id"], "severity": severity.astype(str), "score": score})


_USER_SCORE = "least(CASE WHEN event_type = 'earthquake' THEN m / 10 ELSE m / 200 END, 1)"


def _user_model_sql() -> str:
    return with_views(
        f"""x AS (SELECT event_id, {_USER_SCORE} AS s FROM
          (SELECT *, coalesce(magnitude, 0::DOUBLE) AS m FROM hazard_events))
        SELECT event_id, CASE WHEN s >= 0.75 THEN 'EXTREME' WHEN s >= 0.4 THEN 'SEVERE' WHEN s >= 0.175 THEN 'MODERATE'
          ELSE 'MINOR' END AS severity, {sql_round('s')} AS score FROM x""",
        "hazard_events",
    )


@query("user_model", _user_model_sql())
def user_model(spark: SparkSession, sf: str) -> DataFrame:
    registry = models.UserModels()
    registry.register_model("v1", threshold_model, "event_id string, severity string, score double")
    rows = featured(spark, sf).select("event_id", "magnitude_or_wind_speed")
    return registry.apply("v1", rows).withColumn("score", r6("score"))
