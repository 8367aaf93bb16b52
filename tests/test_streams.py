"""Streams over split files give what the batch operators give on the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow import dims
from hazardflow.checks import load
from hazardflow.checks.fixtures import HAZARD_EVENTS, hazard_events
from hazardflow.operators import drift, feeds, reuse
from hazardflow.operators.enrich import geo_risk
from hazardflow.plans.triage import responses
from hazardflow.sources import sinks
from hazardflow.sources import committed
from hazardflow.streaming import jobs, state
from test_feeds import BOX, ENTRY, cap_file, seismic_file, warning_file


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The small event table as four files, in time order, and each file's name in landing order."""
    folder = tmp_path_factory.mktemp("parts")
    events = spark.read.parquet(f"{small}/events.parquet")
    bounds = events.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low = None
    for i, high in enumerate([*bounds, None]):
        part = events
        part = part if low is None else part.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.coalesce(1).write.parquet(str(folder / f"part={i}"))
        low = high
    return str(folder)


def split_stream(spark, parts):
    """One file per micro-batch, oldest first."""
    schema = spark.read.parquet(f"{parts}/part=0").schema
    reader = jobs.bounded_batches(spark.readStream, files=1).schema(schema)
    return spark.sql(HAZARD_EVENTS.replace("FROM events", "FROM {src}"), src=reader.parquet(f"{parts}/part=*"))


def finish(spark, frame, folder, mode="append", empty_batches=False):
    writer = (
        frame.writeStream.format("parquet")
        .option("path", str(folder / "out"))
        .option("checkpointLocation", str(folder / "checkpoint"))
        .outputMode(mode)
    )
    progress = jobs.run_available(spark, writer, 120, empty_batches)
    return spark.read.schema(frame.schema).parquet(str(folder / "out")), progress


def test_triage_stream_equals_batch(spark, small, parts, tmp_path):
    def messages(events):
        scored = geo_risk(events).withColumns({"severity": F.col("observed_severity"), "confidence": F.lit(1.0)})
        return sinks.keyed_messages(responses(scored))

    found, progress = finish(spark, messages(split_stream(spark, parts)), tmp_path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, messages(hazard_events(spark, small)).collect()))
    assert sum(p["numInputRows"] > 0 for p in progress) == 4


def test_reuse_stream_equals_batch(spark, small, parts, tmp_path):
    state.use_rocksdb(spark)
    keys = ["sensor_id", "event_type"]
    stream = state.reuse_stream(split_stream(spark, parts), keys, ttl_seconds=86400)
    found, _ = finish(spark, stream, tmp_path)
    batch = reuse.mark_reuse(hazard_events(spark, small), keys, event_id="seq", ttl_seconds=86400)
    expected = batch.select(F.col("seq").alias("id"), "source_id", "reused")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def mixed(spark, table, folder, files=24):
    """A table's rows dealt out to files at random."""
    dealt = spark.read.parquet(table).orderBy(F.xxhash64("event_id", F.lit(files))).repartition(files)
    dealt.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_reuse", "stream_drift", "stream_rates"])
def test_same_answer_for_any_file_layout(spark, tmp_path, name):
    """One file and 24 files of randomly mixed rows."""
    sf = "/root/testdata/sf0.01"
    query = load().QUERIES[name]
    one = sorted(map(tuple, query(spark, sf).collect()))
    many = sorted(map(tuple, query(spark, mixed(spark, f"{sf}/events.parquet", tmp_path)).collect()))
    assert one == many and len(one) > 100


def test_disorder_across_batches_loses_no_row(spark, small, tmp_path):
    """Late rows are answered, by themselves or by a row at most the limit older, and never by a later one."""
    state.use_rocksdb(spark)
    folder = mixed(spark, f"{small}/events.parquet", tmp_path, files=6)
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    reader = jobs.bounded_batches(spark.readStream, files=1).schema(schema).parquet(f"{folder}/events.parque[t]")
    events = spark.sql(HAZARD_EVENTS.replace("FROM events", "FROM {src}"), src=reader)
    marked = state.reuse_stream(events, ["sensor_id", "event_type"], ttl_seconds=86400)
    found, progress = finish(spark, marked, tmp_path / "out")
    assert sum(p["numInputRows"] > 0 for p in progress) == 6
    times = {r.seq: r.us for r in hazard_events(spark, small).select("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()}
    rows = found.collect()
    assert sorted(r.id for r in rows) == sorted(times)
    assert all(0 <= times[r.id] - times[r.source_id] <= 86_400_000_000 for r in rows)
    assert any(r.reused for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_reuse_steps_equal_row_by_row(seed):
    rng = np.random.default_rng(seed)
    n, limit = 60, 50
    times = np.sort(rng.integers(0, 800, n))
    ids, clears = np.arange(n), rng.random(n) < 0.1
    put, source = (None, None) if seed % 3 == 0 else (int(rng.integers(0, 400)), 999)
    want, p, s = [], put, source
    for i in range(n):
        if p is not None and put is not None and times[i] < put:
            want.append(i)
        elif clears[i]:
            p = s = None
            want.append(i)
        else:
            if p is None or times[i] - p > limit:
                p, s = int(times[i]), i
            want.append(s)
    got, *after = state.reuse_sources(ids, times, clears, limit, put, source)
    assert got[~clears].tolist() == np.array(want)[~clears].tolist() and after == [p, s]


def test_drift_windows_equal_counts():
    rng = np.random.default_rng(1)
    codes, shares = rng.integers(-1, 4, 200), np.array([0.1, 0.2, 0.3, 0.4])
    got = state.window_drifts(codes, shares, 30)
    for i in range(171):
        own = codes[i : i + 30]
        assert np.allclose(got[i], [abs((own == c).mean() - shares[c]) for c in range(4)])
    assert state.window_drifts(codes[:10], shares, 30).shape == (0, 4)


def test_reuse_stream_invalidation(spark, tmp_path):
    state.use_rocksdb(spark)
    rows = [(1, 100, False), (2, 110, False), (3, 120, True), (4, 130, False), (5, 140, False)]
    frame = spark.createDataFrame(rows, "seq long, s int, gone boolean").withColumn("ts", F.timestamp_seconds("s"))
    frame.withColumn("k", F.lit("k")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, s int, gone boolean, ts timestamp, k string").parquet(str(tmp_path / "in"))
    found, _ = finish(spark, state.reuse_stream(source, ["k"], invalidate="gone"), tmp_path)
    assert {r.id: r.source_id for r in found.collect()} == {1: 1, 2: 1, 4: 4, 5: 4}


def test_drift_stream_equals_batch(spark, small, parts, tmp_path):
    state.use_rocksdb(spark)
    uniform = dict.fromkeys(dims.SEVERITIES, 0.25)
    found, _ = finish(spark, state.drift_stream(split_stream(spark, parts), uniform, "source", window=50), tmp_path)
    batch = drift.prediction_drift(hazard_events(spark, small), uniform, ["source"], event_id="seq", window=50)
    expected = {(r.source, r.seq, r.metric_name.rsplit("_", 1)[1], round(r.drift_magnitude, 9), r.severity) for r in batch.collect()}
    assert {(r.key, r.id, r.severity_class, round(r.drift_magnitude, 9), r.severity) for r in found.collect()} == expected


def test_rates_and_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    columns = "seq long, s int, latency_ms double"
    # Rows are late by the limit the batch before them had already reached.
    files = [
        [(1, 1, 1.0), (2, 70, 5.0), (3, 5000, 9.0)],
        [(5, 5030, 2.0)],
        [(4, 30, 2.0), (6, 9000, 1.0)],
    ]
    for name, rows in enumerate(files):
        frame = spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_seconds("s"))
        frame.coalesce(1).write.parquet(str(source / f"part={name}"))
    reader = spark.readStream.schema(f"{columns}, ts timestamp").option("maxFilesPerTrigger", 1)
    rates = jobs.rate_stream(reader.parquet(str(source / "part=*")))
    found, progress = finish(spark, rates, tmp_path, empty_batches=True)
    assert {(r.window_start.minute, r.n, r.total_ms, r.le_1) for r in found.collect()} == {
        (0, 1, 1.0, 1), (1, 1, 5.0, 0), (23, 2, 11.0, 0)
    }
    assert jobs.late_rows(progress) == 1


def test_distinct_within_limit(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10), ("a", 100), ("b", 100)], "k string, s int")
    rows.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, s int, ts timestamp").parquet(str(tmp_path / "in"))
    found, _ = finish(spark, jobs.distinct_within(source, ["k"]), tmp_path)
    assert sorted(r.k for r in found.collect()) == ["a", "b"]


def test_feed_stream_to_messages(spark, tmp_path):
    """Landed files of three feeds through normalization and triage to keyed messages."""
    cap, quakes, warnings = cap_file(tmp_path / "c"), seismic_file(tmp_path / "q"), warning_file(tmp_path / "w")
    cap_file(tmp_path / "c", "more.xml", [ENTRY.format(id="late", polygon=BOX, sent="2024-05-01T01:00:00Z")])
    events = jobs.feed_stream(spark, cap, quakes, warnings)
    assert events.isStreaming
    found, _ = finish(spark, jobs.triage_messages(jobs.as_requests(events), None), tmp_path)
    assert {r.key for r in found.collect()} == {"good", "late", "q0", "q1", "w1"}


def test_status_upsert(spark, parts, tmp_path):
    polls = split_stream(spark, parts).select("source", F.lit(1).cast("long").alias("item_count"), F.col("ts").alias("polled_at"), "seq")
    writer = (
        polls.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(jobs.upsert_status(str(tmp_path / "status"), feeds.merge_status))
    )
    jobs.run_available(spark, writer)
    assert len(list((tmp_path / "status" / "data").iterdir())) == 2
    last = jobs.status_table(spark, str(tmp_path / "status"))
    events = spark.read.parquet(f"{parts}/part=*")
    assert last.count() == 3
    assert last.agg(F.max("polled_at").cast("string")).first()[0] == events.agg(F.max("ts").cast("string")).first()[0]


def test_a_batch_run_twice_gives_no_second_row(spark, tmp_path):
    """Messages and status: replays, failed attempts and many versions."""
    path = str(tmp_path / "messages")
    rows = spark.createDataFrame([("a", "{}"), ("b", "{}")], "key string, value string")
    write = committed.append_batches(path)
    for batch in (0, 1, 1, 0):
        write(rows, batch)
    table = committed.CommittedTable(spark, path, rows.schema)
    assert table.read().count() == 4 and not table.write(rows, 1) and list(table.commits()) == [0, 1]
    rows.write.parquet(f"{path}/data/{2:015}-lost")  # an attempt that ended before its commit
    assert table.read().count() == 4 and table.write(rows, 2) and table.read().count() == 6


def test_status_versions_stay_bounded(spark, tmp_path):
    path = str(tmp_path / "status")
    write = jobs.upsert_status(path, feeds.merge_status)
    assert jobs.status_table(spark, path).count() == 0
    for batch in range(6):
        polls = spark.createDataFrame([("noaa", batch + 1, batch, batch)], "source string, item_count long, t long, seq long")
        polls = polls.withColumn("polled_at", F.timestamp_seconds("t"))
        write(polls, batch)
        if batch == 3:
            polls.drop("t", "seq").write.parquet(f"{path}/data/{4:015}-lost")
        for again in (batch, 0):
            write(polls.withColumn("item_count", F.lit(99).cast("long")), again)
        assert [r.item_count for r in jobs.status_table(spark, path).collect()] == [batch + 1]
        assert len(list((tmp_path / "status" / "data").iterdir())) <= 3
    assert len(list((tmp_path / "status" / "data").iterdir())) == 2


def test_feed_health(spark, parts, tmp_path):
    polls = split_stream(spark, parts).select("source", F.col("ts").alias("polled_at"))
    kept = []
    writer = (
        state.feed_health_stream(polls).writeStream.outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(lambda batch, _: kept.append({r.source: r.feed_polls for r in batch.collect()}))
    )
    jobs.run_available(spark, writer)
    assert sum(kept[-1].values()) == spark.read.parquet(f"{parts}/part=*").count()
