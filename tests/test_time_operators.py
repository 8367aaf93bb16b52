"""Sliced operators against plain loops, at several slice widths and with one hot key."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.functions import quality
from hazardflow.functions.search import edges_below
from hazardflow.operators import drift, enrich, evaluation, history, ranges, ranks, registry, reuse


def event_rows(n=1500, span=40 * 3600, seed=3):
    """Half of the rows belong to one key; some times repeat."""
    rng = random.Random(seed)
    keys = ["hot", "hot", "hot", "a", "b", "c"]
    return [(rng.choice(keys), i, rng.randrange(span), rng.randint(1, 4)) for i in range(n)]


@pytest.fixture(scope="module")
def events(spark):
    rows = event_rows()
    frame = spark.createDataFrame(rows, "k string, id long, s int, rank int").withColumn("ts", F.timestamp_seconds("s"))
    return rows, frame.cache()


@pytest.mark.parametrize("width", [600, 3600, 86400])
def test_prior_count(events, width):
    rows, frame = events
    found = {r.id: r.prior_count for r in history.prior_event_count(frame, ["k"], chunk_seconds=width).collect()}
    for key, i, s, _ in rows[:300]:
        assert found[i] == sum(1 for k, _, t, _ in rows if k == key and s - 86400 <= t < s)
    assert len(found) == len(rows)


def test_prior_count_needs_a_dividing_width(events):
    with pytest.raises(ValueError, match="divide"):
        history.prior_event_count(events[1], ["k"], chunk_seconds=7000)


@pytest.mark.parametrize("width", [60, 3600, 10**6])
def test_gap_and_average(events, width):
    rows, frame = events
    gaps = history.hours_since_last(frame, ["k"], event_id="id", chunk_seconds=width)
    both = history.historical_average(gaps, ["k"], "rank", event_id="id", chunk_seconds=width)
    found = {r.id: (r.hours_since_last, r.historical_severity_avg) for r in both.collect()}
    seen: dict = {}
    for key, i, s, rank in sorted(rows, key=lambda r: (r[2], r[1])):
        last, total, n = seen.get(key, (None, 0, 0))
        assert found[i][0] == pytest.approx(720.0 if last is None else (s - last) / 3600)
        assert found[i][1] == pytest.approx(2.0 if n == 0 else total / n)
        seen[key] = (s, total + rank, n + 1)


@pytest.mark.parametrize("width", [300, 3600, 10**6])
def test_escalation_labels(events, width):
    rows, frame = events
    found = {r.id: r for r in history.escalation_labels(frame, ["k"], "rank", chunk_seconds=width).collect()}
    for key, i, s, rank in rows[:300]:
        for h in (1, 3, 6):
            higher = any(k == key and s < t <= s + h * 3600 and q > rank for k, _, t, q in rows)
            assert found[i][f"escalated_{h}h"] == int(higher)


def plain_reuse(rows, ttl):
    """(source, reused) by id of rows (key, id, time) in a loop."""
    held, found = {}, {}
    for key, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in held or s - held[key][0] > ttl:
            held[key] = (s, i)
        found[i] = (held[key][1], held[key][1] != i)
    return found


@pytest.mark.parametrize(("ttl", "parts"), [(300, None), (300, 7), (17, 3), (5, 12), (7200, 5), (40000, 9)])
def test_reuse_matches_a_loop(events, ttl, parts):
    rows, frame = events
    marked = reuse.mark_reuse(frame, ["k"], event_id="id", ttl_seconds=ttl, parts=parts)
    found = {r.id: (r.source_id, r.reused) for r in marked.collect()}
    assert found == plain_reuse([r[:3] for r in rows], ttl)


def test_reuse_of_a_burst(spark):
    """Half of one key's rows in one second, in ranges that lie inside one limit; small Arrow batches."""
    rng = random.Random(11)
    rows = [("k", i, 10**9 + rng.randrange(10**6) if i % 2 else rng.randrange(4 * 10**9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, id long, us long").withColumn("ts", F.timestamp_micros("us"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for ttl, parts in ((1, 11), (60, 8), (900, 4)):
            marked = reuse.mark_reuse(frame, ["k"], event_id="id", ttl_seconds=ttl, parts=parts)
            found = {r.id: (r.source_id, r.reused) for r in marked.collect()}
            assert found == plain_reuse(rows, ttl * 10**6)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_reuse_across_several_columns_and_types(spark):
    """Keys of any type and names that the operator uses itself."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.randrange(2) * 0.5, f"{i:04}", rng.randrange(3000)) for i in range(400)]
    frame = spark.createDataFrame(rows, "us string, upto double, id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    marked = reuse.mark_reuse(frame, ["us", "upto"], event_id="id", ttl_seconds=50, parts=5)
    found = {r.id: (r.source_id, r.reused) for r in marked.collect()}
    assert found == plain_reuse([((a, b), i, s) for a, b, i, s in rows], 50)


def test_reuse_stays_linear(spark):
    """Four times the scored rows of one key cost at most twice as much a row."""
    import time

    seconds = {}
    for n in (8_000, 8_000, 32_000):
        frame = spark.range(n).withColumn("k", F.lit("k")).withColumn("ts", F.timestamp_seconds(F.col("id") * 301))
        start = time.perf_counter()
        assert reuse.mark_reuse(frame, ["k"], event_id="id", parts=8).where("reused").count() == 0
        seconds[n] = time.perf_counter() - start
    assert seconds[32_000] / 32_000 <= 2 * seconds[8_000] / 8_000


@pytest.mark.parametrize("parts", [1, 4])
def test_next_above(spark, parts):
    rng = random.Random(4)
    asked = [(rng.choice("ab"), rng.randrange(60), i) for i in range(200)]
    given = {(rng.choice("ab"), rng.randrange(60)) for _ in range(25)}
    queries = spark.createDataFrame(asked, "k string, at long, row long")
    targets = spark.createDataFrame(list(given), "k string, value long")
    found = {r.row: r.found for r in ranges.next_above(queries, targets, ["k"], parts).collect()}
    assert found == {i: min((v for key, v in given if key == k and v > at), default=None) for k, at, i in asked}


def test_reuse_limit_is_not_extended(spark):
    times = [0, 100, 300, 301, 602, 902, 903]
    rows = spark.createDataFrame([("k", t) for t in times], "k string, id long").withColumn("ts", F.timestamp_seconds("id"))
    for limit in (300, 0):  # 0 means the default
        found = {r.id: r.reused for r in reuse.mark_reuse(rows, ["k"], event_id="id", ttl_seconds=limit).collect()}
        assert [found[t] for t in times] == [False, True, True, False, False, True, False]


def test_reuse_periodic_key(spark):
    """Chains from different entries never meet, so every step of every range counts."""
    rows = spark.range(2000).withColumn("k", F.lit("k")).withColumn("ts", F.timestamp_seconds(F.col("id") * 7))
    marked = reuse.mark_reuse(rows, ["k"], event_id="id", ttl_seconds=100, parts=6)
    fresh = sorted(r.id for r in marked.where(~F.col("reused")).collect())
    assert fresh == list(range(0, 2000, 15))


def test_reuse_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, id long, ts timestamp")
    stats = reuse.reuse_stats(reuse.mark_reuse(empty, ["k"], event_id="id"), ["k"]).first()
    assert (stats.hits, stats.misses, stats.hit_rate, stats["size"]) == (0, 0, 0.0, 0)


BASE = {"EXTREME": 0.1, "SEVERE": 0.2, "MODERATE": 0.3, "MINOR": 0.4}


def labels(counts):
    return [c for c, n in zip(BASE, counts, strict=True) for _ in range(n)]


@pytest.mark.parametrize(
    ("recent", "expected"),
    [
        (labels([1, 2, 3, 4]), []),
        (labels([0, 0, 3, 7]), [("MINOR", "WARNING")]),
        (labels([0, 0, 2, 8]), [("MINOR", "CRITICAL")]),
        (labels([0, 0, 0, 9]), []),
        (labels([1, 2, 3, 1]) + ["OTHER"] * 3, [("MINOR", "CRITICAL")]),
    ],
)
def test_drift_goldens(spark, recent, expected):
    rows = spark.createDataFrame([(i, label) for i, label in enumerate(recent)], "id long, predicted_severity string")
    rows = rows.withColumn("ts", F.timestamp_seconds("id"))
    found = drift.prediction_drift(rows, BASE, event_id="id", window=10, block_rows=10).collect()
    assert [(r.metric_name.removeprefix("severity_distribution_"), r.severity) for r in found] == expected


def test_drift_without_baseline(events):
    _, frame = events
    predictions = frame.withColumn("predicted_severity", F.lit("MINOR"))
    found = drift.prediction_drift(predictions, {}, ["k"], event_id="id")
    assert found.count() == 0 and "drift_magnitude" in found.columns


@pytest.mark.parametrize(("width", "block"), [(60, 20), (3600, 33), (10**6, 5000)])
def test_drift_matches_a_loop(events, width, block):
    rows, frame = events
    names = ["EXTREME", "SEVERE", "MODERATE", "MINOR"]
    predictions = frame.withColumn("predicted_severity", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rank")))
    found = drift.prediction_drift(
        predictions, BASE, ["k"], event_id="id", window=20, chunk_seconds=width, block_rows=block
    )
    got = {r.id: (r.metric_name, round(r.drift_magnitude, 9), r.severity) for r in found.collect()}
    wanted, last = {}, {}
    for key, i, _, rank in sorted(rows, key=lambda r: (r[2], r[1])):
        window = last.setdefault(key, [])
        window.append(names[rank - 1])
        del window[:-20]
        if len(window) == 20:
            drifts = {c: abs(window.count(c) / 20 - share) for c, share in BASE.items()}
            worst = max(drifts, key=drifts.get)
            if drifts[worst] >= 0.15:
                level = "CRITICAL" if drifts[worst] >= 0.30 else "WARNING"
                wanted[i] = (f"severity_distribution_{worst}", round(drifts[worst], 9), level)
    assert got == wanted


def test_zero_baseline_gives_no_shares(spark):
    counts = spark.createDataFrame([("A", 0), ("B", 0)], "severity string, n long")
    assert drift.baseline_shares(counts).count() == 0


def test_ranks_without_keys(spark):
    rows = spark.range(101).withColumn("v", F.col("id").cast("double"))
    found = ranks.exact_quantiles(rows, [], "v", (0.5, 0.95), range_rows=10).first()
    assert (found.p50, found.p95) == (50.0, 95.0)


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e-9])
def test_ranges_hold_equal_shares(spark, scale):
    """No range holds over twice its share, for any size of values, with half of the rows close together."""
    rows = spark.range(4000).withColumn("v", F.when(F.col("id") % 2 == 0, F.rand(3)).otherwise(F.rand(4) * 1e-6) * scale)
    edges = ranks.range_edges(rows, ["v"], 40)["v"]
    counts = rows.groupBy(edges_below(F.col("v"), edges).alias("r")).count().collect()
    assert len(counts) == 40 and max(r["count"] for r in counts) <= 2 * 4000 / 40


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 37])
def test_edges_below(spark, n):
    rng = random.Random(n)
    edges = sorted(rng.sample(range(100), n))
    values = [*range(-1, 101), None]
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    found = rows.select("v", edges_below(F.col("v"), edges).alias("n"), edges_below(F.col("v"), edges, True).alias("m")).collect()
    for r in found:
        assert r.n == (None if r.v is None else sum(e < r.v for e in edges))
        assert r.m == (None if r.v is None else sum(e <= r.v for e in edges))


def test_quantiles_of_columns_at_once(spark):
    rng = random.Random(6)
    data = [(rng.random(), rng.choice([None, 1e12 * rng.random()]), rng.randrange(3), None) for _ in range(500)]
    rows = spark.createDataFrame(data, "a double, b double, c int, d double")
    found = {r.name: (r.p25, r.p50) for r in ranks.column_quantiles(rows, ["a", "b", "c", "d"], (0.25, 0.5), range_rows=40).collect()}
    assert set(found) == {"a", "b", "c"}
    for i, name in enumerate("abc"):
        values = [float(r[i]) for r in data if r[i] is not None]
        assert found[name] == pytest.approx(tuple(np.quantile(values, [0.25, 0.5])))
    scaled = enrich.fit_scaling(rows, ["a", "d"], quality.Scaling.ROBUST)
    assert scaled.where("d is not null").count() == 0 and scaled.count() == 500


def test_auc_in_many_ranges(spark):
    rng = random.Random(9)
    data = [(round(rng.random(), 2) * 1e-3, int(rng.random() < 0.4)) for _ in range(400)]
    rows = spark.createDataFrame(data, "score double, label int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    wanted = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluation.auc(rows, "score", "label", range_rows=7).first().auc == pytest.approx(wanted)


def test_outcomes_count_rows_without_latency(spark):
    rows = spark.createDataFrame(
        [("v1", "MINOR", 0.5, 10.0), ("v1", "MINOR", 0.7, None), ("v1", "SEVERE", None, 20.0), ("v2", "EXTREME", 1.0, None)],
        "served_version string, severity string, confidence double, latency_ms double",
    )
    found = {r.served_version: r for r in registry.compare_outcomes(rows).collect()}
    assert (found["v1"].requests, found["v1"].minor, found["v1"].severe) == (3, 2, 1)
    assert found["v1"].mean_confidence == pytest.approx(0.6) and found["v1"].p95_latency_ms == pytest.approx(19.5)
    assert found["v2"].requests == 1 and found["v2"].p95_latency_ms is None


def test_auc_edges(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.9, 0), (0.5, 1)], "score double, label int")
    assert evaluation.auc(rows, "score", "label").first().auc == pytest.approx((1 + 0.5 + 1 + 0) / 4)
    assert evaluation.auc(rows.where("label = 1"), "score", "label").first().auc is None


def test_report_without_predictions_of_a_class(spark):
    rows = spark.createDataFrame([("MINOR", "MODERATE"), ("MINOR", "MINOR")], "l string, p string")
    report = {r["class"]: r for r in evaluation.classification_report(rows, "l", "p").collect()}
    assert (report["EXTREME"].precision, report["EXTREME"].recall, report["EXTREME"].f1) == (0.0, 0.0, 0.0)
    assert report["MINOR"].recall == 0.5 and report["accuracy"].f1 == 0.5


# --- model versions ------------------------------------------------------------------------------------


def registry_log(spark, rows):
    columns = "version string, model_type string, traffic_weight double, is_active boolean, seq long"
    frame = spark.createDataFrame([(v, "classifier", w, a, i) for i, (v, w, a) in enumerate(rows)], columns)
    return frame.withColumn("registered_at", F.timestamp_seconds("seq"))


def test_register_and_promote(spark):
    versions = registry.register(registry_log(spark, [("a", 0.0, True), ("b", 20.0, True)]))
    assert {r.version: (r.traffic_weight, r.is_default) for r in versions.collect()} == {"a": (100.0, True), "b": (20.0, False)}
    promoted = {r.version: (r.traffic_weight, r.is_default) for r in registry.promote(versions, "b", 30.0).collect()}
    assert promoted == {"a": (70.0, False), "b": (30.0, True)}
    with pytest.raises(Exception, match="version x not found"):
        registry.promote(versions, "x").collect()


def test_reregistration_loses_the_first_weight(spark):
    versions = registry.register(registry_log(spark, [("a", 0.0, True), ("b", 20.0, True), ("a", 5.0, True)]))
    assert {r.version: (r.traffic_weight, r.position) for r in versions.collect()} == {"a": (5.0, 1), "b": (20.0, 2)}


@pytest.mark.parametrize(
    "weights", [[60.0, 30.0, 10.0], [100.0, 20.0], [0.0, 50.0], [33.333333, 33.333333], [10.0], [0.07, 0.29, 0.57]]
)
def test_points_follow_the_weights(spark, weights):
    versions = registry.register(registry_log(spark, [(f"v{i}", w, True) for i, w in enumerate(weights)]))
    versions = versions.withColumn("traffic_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("position").cast("int")))
    points = [i / 7 for i in range(701)] + [math.fsum(weights[: i + 1]) for i in range(len(weights))]
    line = spark.createDataFrame([(p,) for p in points], "u double")
    for r in line.withColumn("version", registry.version_at(F.col("u"), versions)).collect():
        total, chosen = 0.0, f"v{len(weights) - 1}"
        for i, w in enumerate(weights):
            total += w
            if r.u <= total:
                chosen = f"v{i}"
                break
        assert r.version == chosen


def test_no_active_version(spark):
    versions = registry.register(registry_log(spark, [("a", 0.0, False)]))
    events = spark.createDataFrame([("e",)], "event_id string")
    assert registry.assign_versions(events, versions).first().assigned_version is None
    good, bad = registry.serve_versions(events, versions, force=None)
    assert (good.count(), bad.count()) == (0, 1)
