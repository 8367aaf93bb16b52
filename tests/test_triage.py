"""The triage job as tables and as a stream: held answers, emptying rows, and what reaches the models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hazardflow import dims
from hazardflow.checks.fixtures import hazard_events
from hazardflow.checks.requests import as_requests, fixed_escalation, fixed_severity
from hazardflow.operators import models, ranges
from hazardflow.plans import triage
from hazardflow.session import shared_dir
from hazardflow.streaming import jobs, state

SECONDS = 172_800


def run_stream(spark, rows, files, tmp_path, **options):
    """The stream over the rows dealt to files, one file a micro-batch, in time order."""
    folder = tmp_path / f"in-{files}"
    for i, part in enumerate(rows if files is None else rows.randomSplit([1.0] * files, 3)):
        part.coalesce(1).write.parquet(str(folder / f"f={i}"))
    state.use_rocksdb(spark)
    stream = spark.readStream.schema(rows[0].schema if files is None else rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "f=*"))
    answers = jobs.triage_stream(stream, fixed_severity(), fixed_escalation(), SECONDS, prior="prior_24h_event_count", **options)
    out = str(tmp_path / f"out-{files}")
    writer = answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c")
    jobs.run_available(spark, writer.outputMode("append"), empty_batches=False)
    return spark.read.schema(answers.schema).parquet(out)


@pytest.fixture(scope="module")
def requests(spark, small):
    return as_requests(hazard_events(spark, small)).cache()


def test_stream_equals_tables(spark, requests, tmp_path):
    batch, _ = triage.triage(
        requests, fixed_severity(), fixed_escalation(), "_local_ts", extra="additional_features",
        sequence="sensor_sequence", reuse_seconds=SECONDS,
    )
    found = run_stream(spark, requests, 1, tmp_path)
    columns = [c for c in batch.columns if c != "recommended_channels"]
    wanted = {r.event_id: r for r in batch.select(columns).collect()}
    rows = found.select(columns).collect()
    assert len(rows) == len(wanted) > 0
    for row in rows:
        assert row[1:2] == wanted[row.event_id][1:2]
        assert row.confidence == pytest.approx(wanted[row.event_id].confidence)
        assert row.escalation_probability_3h == pytest.approx(wanted[row.event_id].escalation_probability_3h)


def test_answers_are_held_across_batches_and_emptied(spark, requests, tmp_path):
    """Three files in time order: a request, one that is served, and after an emptying row one that is not."""
    first = requests.where("seq % 4 = 1").limit(1)
    base = F.timestamp_seconds(F.lit(1_700_000_000))

    def at(name, seconds, value, clear=False):
        steps = F.array_repeat(F.array(F.lit(value), *[F.lit(0.0)] * 14), 24)
        changed = {"event_id": F.lit(name), "ts": (base + F.expr(f"interval {seconds} seconds")).cast("timestamp_ntz")}
        return first.withColumns({**changed, "sensor_sequence": steps, "is_clear": F.lit(clear)})

    files = [
        at("a", 0, 0.0), at("b", 60, 9.0), at("c", 70, 9.0, clear=True), at("d", 80, 5.0), at("e", 90, 0.0), at("late", 75, 3.0),
    ]
    found = {r.event_id: r for r in run_stream(spark, files, None, tmp_path, clear="is_clear").collect()}
    p = {name: row.escalation_probability_3h for name, row in found.items()}
    assert set(found) == {"a", "b", "d", "e", "late"}
    assert p["a"] == p["b"] != p["d"] == p["e"]  # b takes a's answer; the clearing row makes d scored anew
    assert p["late"] not in (p["a"], p["d"])  # older than what is held: scored by itself


def test_only_fresh_rows_reach_the_models(spark, requests):
    """The models see the rows that answer, each once."""
    good, _ = triage.enriched(requests, "_local_ts", "prior_24h_event_count")
    answered = triage.answered_once(good, fixed_severity(), None, None, SECONDS)
    rows = answered.select("event_id", "source_id", "severity", "confidence").collect()
    assert len(rows) == good.count() and 0 < len({r.source_id for r in rows}) < len(rows)
    alone = {r.event_id: r for r in triage.predicted(good, fixed_severity(), None, None).collect()}
    for r in rows:
        assert (r.severity, r.confidence) == (alone[r.source_id].severity, alone[r.source_id].confidence)


def test_models_inputs_are_not_stored_with_the_marks(spark, requests, monkeypatch):
    """Sequences and features reach no stored table, and both ways of finding the scored rows give the same."""
    kept, stored = [], ranges.stored
    monkeypatch.setattr(ranges, "stored", lambda df, purpose: kept.append(df.columns) or stored(df, purpose))
    good, _ = triage.enriched(requests, "_local_ts", "prior_24h_event_count", "additional_features")
    given = fixed_severity(), fixed_escalation(), "sensor_sequence", SECONDS
    few = triage.answered_once(good, *given).select("event_id", "source_id", "severity", "confidence", "p3h")
    monkeypatch.setattr(triage, "BROADCAST_ROWS", 0)
    many = triage.answered_once(good, *given).select(*few.columns)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == good.count()
    assert not {"sensor_sequence", *dims.MODEL_FEATURES} & {c for columns in kept for c in columns}


def test_least_of_strings_is_sorted_in_bounded_tasks(spark, monkeypatch):
    """Rows are dealt by their number before they are sorted, null and heavy keys included."""
    monkeypatch.setattr(ranges, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, null, if(id < 900, 'a', 'b')) AS k", "id % 2 AS us", "CAST(id AS STRING) AS id")
    found = ranges.least(rows, ["k", "us"], "id")
    wanted = rows.groupBy("k", "us").agg(F.min("id").alias("id"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.rindex("SortAggregate") :]
    assert "REPARTITION_BY_NUM" in before and "_share" in before and found.rdd.getNumPartitions() == 10


def test_untrained_and_empty(spark, requests):
    answers, _ = triage.triage(requests.limit(5), None, reuse_seconds=0)
    assert {(r.severity, r.confidence, r.escalation_likely) for r in answers.collect()} == {("MODERATE", 0.0, False)}
    assert triage.triage(requests.limit(0), fixed_severity(), reuse_seconds=60)[0].count() == 0


def test_fixed_models_are_saved_and_loaded(spark, requests):
    """What a folder gives back scores alike."""
    folder = shared_dir(spark, "model")
    models.save_model(fixed_severity(), folder)
    good, _ = triage.enriched(requests, "_local_ts", "prior_24h_event_count")
    pair = [models.score_severity(good, m).select("event_id", "severity", "confidence") for m in (fixed_severity(), models.load_model(folder))]
    assert pair[0].exceptAll(pair[1]).count() == 0
    assert set(dims.MODEL_FEATURES) == set(models.load_model(folder).features)
