"""Training, saving, loading and scoring on the small tables."""

import glob
import math
import os
import random
import shutil

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardflow import dims, session
from hazardflow.checks.modeling import _sequence_sets, featured
from hazardflow.operators import boosting, models, sequence_training
from hazardflow.streaming import jobs


@pytest.fixture(scope="module")
def fitted(spark, small):
    return models.train_severity(featured(spark, small), label="label_severity", trees=40, depth=2)


def test_scores(spark, small, fitted):
    rows = models.score_severity(featured(spark, small), fitted)
    found = rows.select("severity", "confidence", "probabilities", "channels").collect()
    assert {r.severity for r in found} <= set(dims.SEVERITIES) and len({r.severity for r in found}) > 1
    for r in found:
        assert 0 <= r.confidence <= 1
        assert sum(r.probabilities) == pytest.approx(1.0)
        assert r.channels == dims.CHANNELS[r.severity]


def test_missing_features_read_zero(spark, small, fitted):
    rows = featured(spark, small).select("event_id", "magnitude_or_wind_speed")
    zeros = featured(spark, small).withColumns(
        {n: F.lit(0.0) for n in dims.MODEL_FEATURES if n != "magnitude_or_wind_speed"}
    )
    short = models.score_severity(rows, fitted).select("event_id", "severity")
    full = models.score_severity(zeros, fitted).select("event_id", "severity")
    assert short.exceptAll(full).count() == 0


def test_distinct_scoring_equals_plain(spark, small, fitted):
    rows = featured(spark, small)
    plain = models.score_severity(rows, fitted).select("event_id", "severity", "confidence")
    shared = models.score_distinct(rows, fitted).select("event_id", "severity", "confidence")
    assert shared.exceptAll(plain).count() == 0 and shared.count() == plain.count()


def test_save_and_load(spark, small, fitted, tmp_path):
    path = str(tmp_path / "model")
    assert models.load_model(path) is None
    models.save_model(fitted, path)
    rows = featured(spark, small)
    again = models.score_severity(rows, models.load_model(path)).select("event_id", "severity")
    assert again.exceptAll(models.score_severity(rows, fitted).select("event_id", "severity")).count() == 0


def test_importances(spark, fitted):
    rows = models.feature_importances(spark, fitted).collect()
    assert len(rows) == len(dims.MODEL_FEATURES) and sum(r.importance for r in rows) == pytest.approx(1.0)
    assert rows == sorted(rows, key=lambda r: (-r.importance, r.feature))
    assert models.feature_importances(spark, fitted, top=5).count() == 5


def test_importance_map_in_scored_rows(spark, small, fitted):
    found = models.score_severity(featured(spark, small), fitted).select("feature_importance").first()[0]
    assert found == {r.feature: r.importance for r in models.feature_importances(spark, fitted).collect()}


def plain_boosting(values, labels, n_classes, trees, step, depth):
    """Softmax boosting over the distinct values themselves, row by row, in plain Python."""
    rows, features = range(len(values)), range(len(values[0]))
    prior = [math.log(max(labels.count(k) / len(labels), 1e-7)) for k in range(n_classes)]
    margins = [prior[:] for _ in rows]

    def shares(m):
        powers = [math.exp(x - max(m)) for x in m]
        return [p / sum(powers) for p in powers]

    for _ in range(trees):
        p = [shares(m) for m in margins]
        for k in range(n_classes):
            residual = [(labels[i] == k) - p[i][k] for i in rows]
            leaves = [list(rows)]
            for _ in range(depth):
                split = []
                for leaf in leaves:
                    best, cut = 0.0, None
                    for f in features:
                        for v in sorted({values[i][f] for i in leaf})[:-1]:
                            left = [residual[i] for i in leaf if values[i][f] <= v]
                            right = [residual[i] for i in leaf if values[i][f] > v]
                            gain = len(left) * len(right) / len(leaf) * (sum(left) / len(left) - sum(right) / len(right)) ** 2
                            if gain > best * (1 + 1e-9) + 1e-9:
                                best, cut = gain, (f, v)
                    split += [leaf] if cut is None else [
                        [i for i in leaf if values[i][cut[0]] <= cut[1]], [i for i in leaf if values[i][cut[0]] > cut[1]]
                    ]
                leaves = split
            for leaf in leaves:
                top, under = sum(residual[i] for i in leaf), sum(p[i][k] * (1 - p[i][k]) for i in leaf)
                for i in leaf:
                    margins[i][k] += step * (n_classes - 1) / n_classes * top / under
    return [shares(m) for m in margins]


def test_boosting_against_plain_code(spark):
    """Few distinct values, so that bins are the values; every row takes part in every round."""
    rng = random.Random(3)
    values = [[float(rng.randrange(5)), float(rng.randrange(4))] for _ in range(120)]
    labels = [int(a > 2) + int(b > 1 and a < 4 and rng.random() < 0.8) for a, b in values]
    frame = spark.createDataFrame([(i, *v, y) for i, (v, y) in enumerate(zip(values, labels))], "id long, a double, b double, y int")
    model = boosting.train(frame, ["a", "b"], "y", F.col("id"), ["x", "y", "z"], 6, 0.3, 2, 1.0, 1)
    found = frame.select("id", model.probabilities(F.array("a", "b")).alias("p")).orderBy("id").collect()
    wanted = plain_boosting(values, labels, 3, 6, 0.3, 2)
    for row, shares in zip(found, wanted):
        assert row.p == pytest.approx(shares, abs=1e-5)


def test_rows_may_be_dealt_to_any_number_of_tasks(spark, small, fitted):
    """The fit does not depend on which task holds a row, and follows the seed."""
    rows = featured(spark, small)
    again = models.train_severity(rows, label="label_severity", trees=2, depth=2, row_id="event_id", n_workers=2)
    alone = models.train_severity(rows, label="label_severity", trees=2, depth=2, row_id="event_id")
    other = models.train_severity(rows, label="label_severity", trees=2, depth=2, row_id="event_id", seed=7)
    assert again.dump() == alone.dump() != other.dump()


def test_larger_fits_wait_for_no_barrier(spark, small, monkeypatch):
    """Above a small table the fit is jobs over kept blocks, and the model is the one that a single task makes."""
    rows = featured(spark, small)
    alone = models.train_severity(rows, label="label_severity", trees=2, depth=3, row_id="event_id")
    monkeypatch.setattr(boosting, "ALONE_ROWS", 100)
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 1)
    monkeypatch.setattr(boosting.workers, "fit", None)
    many = models.train_severity(rows, label="label_severity", trees=2, depth=3, row_id="event_id")
    assert many.dump() == alone.dump()


def test_rows_are_cut_into_blocks_of_one_size():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 20000), (20000, 24580))]
    tables = list(boosting._tables(iter(batches)))
    assert [len(t) for t in tables] == [8192, 8192, 8192, 4]
    assert [n for t in tables for n in t["n"].to_pylist()] == list(range(24580))


@pytest.mark.parametrize("most", [64, 1])
def test_larger_fits_keep_rows_in_local_files(spark, small, monkeypatch, most):
    """Jobs get the names of folders instead of rows, nothing goes to the shared folder, and lost files are made again."""
    rows = featured(spark, small)
    alone = models.train_severity(rows, label="label_severity", trees=3, depth=3, row_id="event_id")
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 1)
    monkeypatch.setattr(boosting, "MOST_SUMS", most)
    before = set(glob.glob(f"{session_folder(spark)}/**", recursive=True))
    seen, lost = [], iter([[], [0], [0, 1]])
    plain = boosting._Spread.spreads

    def spreads(self, fit):
        own = self.folders.collect()
        assert all(isinstance(folder, str) and "blockmgr" in folder for folder in own)
        seen.extend(own)
        for i in next(lost):
            shutil.rmtree(own[i])
        return plain(self, fit)

    monkeypatch.setattr(boosting._Spread, "spreads", spreads)
    many = models.train_severity(rows, label="label_severity", trees=3, depth=3, row_id="event_id", n_workers=2)
    assert many.dump() == alone.dump()
    assert len(set(seen)) == 4 and not any(os.path.exists(os.path.dirname(folder)) for folder in seen)
    assert set(glob.glob(f"{session_folder(spark)}/**", recursive=True)) == before


def session_folder(spark) -> str:
    session.ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def test_sums_of_a_level_against_plain_code():
    """Features of one and many bins, classes that share a number, nodes without a split; only the wanted children count."""
    rng = np.random.default_rng(4)
    bins_of, n_classes, n = [1, 64, 3, 64, 64], 5, 3000
    bins = np.stack([rng.integers(0, b, n) for b in bins_of], axis=1).astype(np.uint8)
    layout = boosting._Layout.of(bins_of)
    assert sorted(f for g in layout.groups for f in g) == [1, 2, 3, 4] and max(layout.sizes()) <= boosting.GROUP_BINS
    held = {f"codes{g}": c for g, c in enumerate(layout.codes(bins))}
    label, ids = rng.integers(0, n_classes, n).astype("u1"), rng.integers(-(2**62), 2**62, n)
    shard = boosting._kept(iter([held | {"label": label, "id": ids}]), layout, n_classes)
    for depth in (1, 4, 6):
        feature = rng.integers(1, 5, (n_classes, 2**depth - 1))
        feature[rng.random(feature.shape) < 0.1] = -1
        bin_of = np.where(feature >= 0, rng.integers(0, 64, feature.shape) % (np.array(bins_of)[feature] - 1), 0)
        fit = boosting._Fit(1, depth, feature, bin_of)
        first = np.concatenate([[0], np.cumsum(bins_of)])
        shard.margins[0][:] = rng.normal(size=(n_classes, n))
        margins = shard.margins[0].copy()
        value = rng.normal(size=(n_classes, 2**depth))
        root = shard.start([0.0] * n_classes, 1, (fit, value), 0.8, 7)
        drawn = boosting._drawn(ids, 1, 0.8, 7)
        for k in range(n_classes):
            node = np.zeros(n, dtype=int)
            for level in range(depth):
                f, b = (x[k][2**level - 1 + node] for x in (feature, bin_of))
                node = 2 * node + ((f >= 0) & (bins[np.arange(n), f] > b))
            margins[k] += value[k][node]
        p = np.exp(margins) / np.exp(margins).sum(axis=0)
        assert shard.margins[1] == pytest.approx(margins)
        spreads = shard.spreads(fit)
        wanted = rng.random((n_classes, 2 ** (depth - 1))) < 0.5
        sums = shard.sums(fit, depth - 1, wanted) if depth > 1 else root
        for k in range(n_classes):
            node = np.zeros(n, dtype=int)
            for level in range(depth):
                own = drawn & (wanted[k][node] if depth > 1 else True)
                if level == depth - 1:
                    for f, (low, high) in enumerate(zip(first, first[1:])):
                        for parent in range(sums.shape[2]):
                            of = own & (node // 2 == parent)
                            assert (sums[1, k, parent, low:high] == np.bincount(bins[of, f], minlength=high - low)).all()
                            weight = np.bincount(bins[of, f], ((label == k) - p[k])[of], high - low)
                            assert sums[0, k, parent, low:high] / boosting.UNIT == pytest.approx(weight, abs=1e-3)
                f, b = (x[k][2**level - 1 + node] for x in (feature, bin_of))
                node = 2 * node + ((f >= 0) & (bins[np.arange(n), f] > b))
            under = np.bincount(node[drawn], (p[k] * (1 - p[k]))[drawn], 2**depth)
            assert spreads[k] / boosting.UNIT == pytest.approx(under, abs=1e-3)


def test_scoring_tables_are_made_once(fitted, monkeypatch):
    """Batches of rows share the tables of a model, and equal rows get what each would get alone."""
    rng = np.random.default_rng(2)
    values = rng.random((300, len(fitted.features))).round(1)
    first = fitted.shares(values)
    monkeypatch.setattr(boosting.np, "full", None)
    assert (fitted.shares(values[::-1])[::-1] == first).all()
    assert all((fitted.shares(values[i : i + 1])[0] == first[i]).all() for i in range(20))
    assert boosting.Trees.read(fitted.dump()) == fitted


def test_odd_training_rows(spark):
    """Nulls and NaN read 0, unknown labels are left out, one class or no rows still give a model."""
    schema = "a double, b double, severity string"
    rows = [(None, float("nan"), "MINOR"), (1.0, 2.0, "MINOR"), (1.0, 2.0, "OTHER"), (1.0, 2.0, None)]
    for given in (rows, []):
        model = models.train_severity(spark.createDataFrame(given, schema), ["a", "b"], trees=2, depth=3)
        found = models.score_severity(spark.createDataFrame(rows, schema), model, ["a", "b"]).collect()
        assert all(sum(r.probabilities) == pytest.approx(1.0) for r in found)
        if given:
            assert {r.severity for r in found} == {"MINOR"} and model.rows == 2
    with pytest.raises(ValueError, match="depth"):
        models.train_severity(spark.createDataFrame(rows, schema), ["a", "b"], depth=9)


def test_untrained(spark, small):
    row = models.score_severity(featured(spark, small), None).first()
    assert (row.severity, row.confidence, row.channels) == ("MODERATE", 0.0, dims.CHANNELS["MODERATE"])


def test_escalation(spark, small):
    train, held = _sequence_sets(spark, small)
    best = models.train_escalation(train, held, epochs=3)
    assert len(best.losses) == 3 and best.losses[best.best_epoch] == min(best.losses)
    scored = models.score_escalation(held, best)
    for r in scored.select("p1h", "p3h", "p6h", "escalation_likely", "escalation_confidence").collect():
        assert r.escalation_likely == (r.p3h >= 0.65)
        assert r.escalation_confidence == pytest.approx((r.p1h + r.p3h + r.p6h) / 3)
    requests = spark.createDataFrame(
        [("full", [[1.0] * 15] * 24), ("short", [[1.0] * 15]), ("none", None), ("zeros", [[0.0] * 15] * 24)],
        "event_id string, sensor_sequence array<array<double>>",
    ).selectExpr(
        "*", "'fog' AS event_type", "0.0D AS magnitude", "1.0D AS latitude", "2.0D AS longitude",
        "TIMESTAMP_NTZ '2024-01-01 12:00:00' AS _local_ts", "map('elevation_meters', 5.0D) AS additional_features",
    )
    answers, rejected = jobs.triage_rows(requests, None, best)
    p3h = {r.event_id: r.escalation_probability_3h for r in answers.collect()}
    assert rejected.count() == 0
    assert p3h["short"] == p3h["none"] == p3h["zeros"] != p3h["full"]
    none = models.score_escalation(held, None).first()
    assert none.p3h is None and none.escalation_likely is False and none.escalation_confidence is None


def test_user_models(spark, small):
    registry = models.UserModels()
    registry.register_model("v1", lambda b: pd.DataFrame({"n": [len(b)]}), "n long")
    assert registry.apply("v1", featured(spark, small)).agg(F.sum("n")).first()[0] == 1000
    with pytest.raises(ValueError, match="not found"):
        registry.apply("v2", featured(spark, small))


def plain_adamw(x, y, epochs, order, held_x, held_y):
    """The optimizer step by step on one output; weights by epoch."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1
    x, held_x = (x - mean) / scale, (held_x - mean) / scale
    w, b = np.zeros(x.shape[1]), 0.0
    m, v, t, losses = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0, []
    for epoch in range(epochs):
        rate = 1e-3 * (1 + math.cos(math.pi * epoch / epochs)) / 2
        for low in range(0, len(x), 64):
            rows = order[epoch][low : low + 64]
            wrong = 1 / (1 + np.exp(-(x[rows] @ w + b))) - y[rows]
            g = np.append(wrong @ x[rows], wrong.sum()) / len(rows)
            norm = math.sqrt((g**2).sum())
            g = g * min(1, 1 / (norm + 1e-6))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w * (1 - rate * 1e-4) - change[:-1], b * (1 - rate * 1e-4) - change[-1]
        p = np.clip(1 / (1 + np.exp(-(held_x @ w + b))), 1e-7, 1 - 1e-7)
        losses.append(float(-(held_y * np.log(p) + (1 - held_y) * np.log(1 - p)).mean()))
    return losses


def test_sequence_training_against_plain_code(spark):
    rng = np.random.default_rng(8)
    x = rng.random((210, 6)).round(3)
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    rows = [([[float(a) for a in r[:3]], [float(a) for a in r[3:]]], float(t)) for r, t in zip(x, y)]
    schema = "sequence array<array<double>>, y3h double"
    train, held = spark.createDataFrame(rows[:150], schema), spark.createDataFrame(rows[150:], schema)
    fitted = sequence_training.train(train, held, (3,), 6, epochs=4, seed=5)
    hashed = train.withColumn("x", F.flatten("sequence")).select(F.xxhash64("x", "y3h").alias("id")).collect()
    by_id = np.argsort([r.id for r in hashed], kind="stable")
    draws = np.random.default_rng([5, 0])
    order = [draws.permutation(150) for _ in range(4)]
    wanted = plain_adamw(x[:150][by_id], y[:150][by_id], 4, order, x[150:], y[150:])
    assert fitted.losses == pytest.approx(wanted, abs=1e-9) and fitted.best_epoch == int(np.argmin(wanted))
    two = sequence_training.train(train, held, (3,), 6, epochs=2, seed=5, n_workers=2)
    assert two.losses[-1] < 0.6931 and two.mean == pytest.approx(fitted.mean)


def test_odd_sequences(spark, tmp_path):
    """Other shapes and missing readings are neither learned nor scored; models survive saving."""
    good = [[float(i + j) for j in range(15)] for i in range(24)]
    rows = [(good, 1.0, 0.0, 1.0), ([[1.0]], 1.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0), ([[None] * 15] * 24, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "sequence array<array<double>>, y1h double, y3h double, y6h double")
    for held in (frame, frame.limit(0)):
        fitted = models.train_escalation(frame, held, epochs=2)
        found = models.score_escalation(frame, fitted).collect()
        assert [r.p3h is None for r in found] == [False, True, True, True]
    path = str(tmp_path / "escalation")
    assert models.load_escalation(path) is None
    models.save_model(fitted, path)
    assert models.load_escalation(path) == fitted
