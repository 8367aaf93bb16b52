"""Model evaluation: reports, confusion matrix, threshold metrics, AUC, loss and replayable splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardflow import dims
from hazardflow.functions.times import chunk, micros
from hazardflow.operators.ranks import RANGE_ROWS, running_totals

CLIP = 1e-7


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def pair_counts(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    rows: DataFrame, label: str, prediction: str, classes: list[str] = dims.SEVERITIES
) -> DataFrame:
    """One row per label with a count column per predicted class."""
    return (
        pair_counts(rows, label, prediction)
        .groupBy("label")
        .agg(*[F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(c) for c in classes])
    )


def classification_report(
    rows: DataFrame, label: str, prediction: str, classes: list[str] = dims.SEVERITIES
) -> DataFrame:
    """Per-class precision, recall, f1 and support, then accuracy, macro and weighted averages.

    Only the label x prediction counts are used after one aggregation; a zero denominator gives 0.
    """
    pairs = pair_counts(rows, label, prediction)
    wide = pairs.agg(
        *[F.sum(F.when((F.col("label") == c) & (F.col("prediction") == c), F.col("n")).otherwise(0)).alias(f"tp_{c}") for c in classes],
        *[F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"pp_{c}") for c in classes],
        *[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"ap_{c}") for c in classes],
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"),
    )
    per_class = {}
    for c in classes:
        precision = _ratio(F.col(f"tp_{c}"), F.col(f"pp_{c}"))
        recall = _ratio(F.col(f"tp_{c}"), F.col(f"ap_{c}"))
        f1 = _ratio(F.lit(2.0) * precision * recall, precision + recall)
        per_class[c] = (precision, recall, f1)

    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def mean(i: int, weighted: bool) -> Column:
        if weighted:
            parts = [per_class[c][i] * F.col(f"ap_{c}") for c in classes]
            return _ratio(reduce(Column.__add__, parts), F.col("total"))
        return reduce(Column.__add__, [per_class[c][i] for c in classes]) / F.lit(float(len(classes)))

    accuracy = _ratio(F.col("hits"), F.col("total"))
    entries = [entry(c, *per_class[c], F.col(f"ap_{c}")) for c in classes]
    entries.append(entry("accuracy", accuracy, accuracy, accuracy, F.col("total")))
    entries.append(entry("macro avg", *[mean(i, False) for i in range(3)], F.col("total")))
    entries.append(entry("weighted avg", *[mean(i, True) for i in range(3)], F.col("total")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def threshold_metrics(
    rows: DataFrame, score: str, label: str, threshold: float = 0.5, keys: list[str] | None = None
) -> DataFrame:
    """Precision and recall when scores at or above the threshold count as positive."""
    flagged = F.col(score) >= F.lit(threshold)
    counts = rows.groupBy(*(keys or [])).agg(
        F.count_if(flagged & (F.col(label) == 1)).alias("true_positives"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    return counts.withColumns(
        {
            "precision": _ratio(F.col("true_positives"), F.col("flagged")),
            "recall": _ratio(F.col("true_positives"), F.col("positives")),
        }
    )


def auc(
    rows: DataFrame, score: str, label: str, keys: list[str] | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in order, ties counting half.

    Rows are reduced to one per distinct score; negatives below a score come from running totals over score
    ranges, so no single task orders all scores.
    """
    keys = keys or []
    counted = rows.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(counted, keys, score, ["neg"], range_rows)
    below = (F.col("cum_neg") - F.col("neg")).cast("double") + F.col("neg") / F.lit(2.0)
    totals = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("double") * below).alias("_ordered"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return totals.withColumn("auc", F.when(pairs > 0, F.col("_ordered") / pairs)).drop("_ordered")


def log_loss(rows: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Mean binary cross-entropy with probabilities kept off 0 and 1."""
    p = F.greatest(F.least(F.col(score), F.lit(1.0 - CLIP)), F.lit(CLIP))
    y = F.col(label).cast("double")
    loss = -(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))
    return rows.groupBy(*(keys or [])).agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def split_name(event_id: Column, folds: int = 5) -> Column:
    """``test`` for one fold in ``folds`` by a digest of the id, so every run splits the same way."""
    fold = F.conv(F.substring(F.md5(event_id.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(folds)
    return F.when(fold == 0, "test").otherwise("train")


def train_test(rows: DataFrame, event_id: str = "event_id", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    tagged = rows.withColumn("_split", split_name(F.col(event_id), folds))
    return (
        tagged.where(F.col("_split") == "train").drop("_split"),
        tagged.where(F.col("_split") == "test").drop("_split"),
    )


def time_cutoff(rows: DataFrame, ts: str, share: float = 0.8, slice_seconds: int = 3600) -> int:
    """Microsecond time by which about ``share`` of the rows have passed, to the end of a time slice.

    Only the counts per slice are ordered; the result is a single number.
    """
    slices = rows.groupBy(chunk(micros(F.col(ts)), slice_seconds).alias("_slice")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("_slice")
    running = slices.select(
        "_slice", F.sum("n").over(order).alias("c"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("t")
    )
    row = running.where(F.col("c") >= F.lit(share) * F.col("t")).agg(F.min("_slice").alias("s")).first()
    return 0 if row["s"] is None else (row["s"] + 1) * slice_seconds * 1_000_000


def time_split(rows: DataFrame, ts: str, share: float = 0.8, slice_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """The earliest rows for training and the rest for validation, cut between time slices."""
    cutoff = time_cutoff(rows, ts, share, slice_seconds)
    early = micros(F.col(ts)) < F.lit(cutoff)
    return rows.where(early), rows.where(~early)
