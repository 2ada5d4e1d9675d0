"""The live job must give what the batch job gives on the same rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rollmark.operators.attendance import attendance_from_events
from rollmark.operators.presence import closed_sessions, open_sessions, presence_events
from rollmark.operators.temporal import current_state, stabilise
from rollmark.plans import fixtures as fx
from rollmark.schemas import OBSERVATIONS, column_names
from rollmark.sources.readers import observation_stream, read_detection_log
from rollmark.policies import PRESENCE, TEMPORAL, preset
from rollmark.streaming.archive import read_archive, replace_rows
from rollmark.streaming.jobs import (
    attendance_sink,
    fault,
    forget_last_batch,
    read_audits,
    read_sessions,
    read_stream_states,
    run_attendance_stream,
    run_detection_log,
    stop_attendance_stream,
    tick,
)

KEPT = ["stream_id", "frame_index", "event_seq", "identity", "event_type", "previous_state", "new_state", "session_id"]


#: The smallest table has ten times fewer events than the registered queries' stretch is made for.
SETTINGS = (preset(TEMPORAL, "balanced", scale=18_000), preset(PRESENCE, "balanced", scale=18_000, max_session_duration_seconds=60_000.0))


def _rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


LATENESS = 4 * 86_400.0
WHOLE = [*KEPT, "ts", "reason", "started_at", "last_seen_at", "observation_count", "interruption_count"]


def _observations(spark, small):
    return fx.observations(spark, small).withColumn("quality_score", F.lit(None).cast("double"))


def _arrive(observations, folder, files=3):
    """Rows in files by a time of arrival that is up to the lateness after their own, then a clock row."""
    delay = F.pmod(F.xxhash64("event_id"), F.lit(int(LATENESS * 1e6)))
    rows = observations.withColumn("at", F.unix_micros("ts") + delay).persist()
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    for k in range(files):
        part = rows.where(F.floor((F.col("at") - first) * files / (last - first + 1)) == k)
        part.select(*column_names(OBSERVATIONS)).coalesce(1).write.mode("append").parquet(folder)
    tick(rows.sparkSession, folder, F.timestamp_micros(F.lit(last + 30 * 86_400_000_000)))


def _run(spark, folder, settings, lateness=LATENESS, **options):
    job = run_attendance_stream(observation_stream(spark, f"{folder}/in", 1), *settings, f"{folder}/out", f"{folder}/cp", lateness=lateness, **options)
    job.awaitTermination(300)
    assert job.exception() is None


def test_stream_equals_batch_in_any_order(spark, small, tmp_path):
    observations = _observations(spark, small)
    temporal, presence = (dict(x) for x in SETTINGS)
    presence["max_session_duration_seconds"] = 600_000.0
    folder = str(tmp_path)
    _arrive(observations, f"{folder}/in")
    _run(spark, folder, (temporal, presence))
    smoothed = stabilise(observations.select(*column_names(OBSERVATIONS)), temporal)
    batch = presence_events(smoothed, presence).persist()
    expected = _rows(batch, *WHOLE)
    assert len(expected) > 100

    def compare():
        assert _rows(spark.read.parquet(f"{folder}/out/events"), *WHOLE) == expected
        columns = ["identity", "date", "first_check_in", "last_check_out", "session_count", "status"]
        table = spark.read.parquet(f"{folder}/out/attendance")
        assert _rows(table, *columns) == _rows(attendance_from_events(batch), *columns)
        kept = ["session_id", "state", "started_at", "ended_at", "duration_seconds", "observation_count", "interruption_count"]
        both = closed_sessions(batch).select(*kept).unionByName(open_sessions(batch).select(*kept))
        assert _rows(read_sessions(spark, f"{folder}/out"), *kept) == _rows(both, *kept)
        assert read_audits(spark, f"{folder}/out").count() == closed_sessions(batch).count()

    compare()
    states = ["stream_id", "current_stable_identity", "consecutive_stable_count", "challenger_identity"]
    assert _rows(read_stream_states(spark, f"{folder}/cp"), *states) == _rows(current_state(smoothed), *states)
    forget_last_batch(spark, f"{folder}/cp")
    _run(spark, folder, (temporal, presence))
    compare()

    # a stop closes what is open, once
    at = observations.agg(F.max("ts")).scalar()
    still = open_sessions(batch).count()
    assert still > 0
    tables = []
    for moment in (at, at + F.expr("INTERVAL 1 DAY")):
        stop_attendance_stream(spark, f"{folder}/cp", f"{folder}/out", moment)
        tables.append([_rows(spark.read.parquet(f"{folder}/out/{t}"), *c) for t, c in (("events", WHOLE), ("attendance", ["identity", "date", "last_check_out"]))])
        tables[-1].append(_rows(read_sessions(spark, f"{folder}/out"), "session_id", "state", "ended_at", "reason"))
    assert tables[0] == tables[1]
    ended = read_sessions(spark, f"{folder}/out")
    assert ended.where("ended_at IS NULL").count() == 0
    assert ended.where("reason = 'session closed due to runtime_shutdown'").count() == still


def test_graces_end_without_frames(spark, tmp_path):
    """Two streams: one falls silent in grace, the other one's clock ends its session on time."""
    start = datetime(2024, 5, 1, 10)
    seen = [("a", k + 1, k, "Ann") for k in range(12)] + [("a", 13 + k, 12 + k, None) for k in range(5)]
    seen += [("b", k + 1, k * 2, "Bob") for k in range(40)]
    rows = [(s, i, start + timedelta(seconds=t), n, n, 0.9, 0.2, n is not None, "good", None) for s, i, t, n in seen]
    folder = str(tmp_path)
    spark.createDataFrame(rows, OBSERVATIONS).coalesce(1).write.parquet(f"{folder}/in")
    tick(spark, f"{folder}/in", F.lit(start + timedelta(seconds=79)).cast("timestamp"))
    settings = preset(TEMPORAL, "balanced"), preset(PRESENCE, "balanced")
    _run(spark, folder, settings, 2.0, grace_timeout=True)
    events = spark.read.parquet(f"{folder}/out/events")
    lost = events.where("event_type = 'GRACE_STARTED' AND identity = 'Ann'").collect()
    ended = events.where("event_type = 'SESSION_ENDED'").collect()
    grace = settings[1]["grace_period_seconds"]
    assert len(lost) == 1
    assert [(e.identity, (e.ts - lost[0].ts).total_seconds(), e.frame_index) for e in ended] == [("Ann", grace, 17)]


def test_late_rows_go_aside(spark, small, tmp_path):
    rows = _observations(spark, small).select(*column_names(OBSERVATIONS))
    folder = str(tmp_path)
    rows.where("frame_index > 20").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _run(spark, folder, SETTINGS, 10.0)
    rows.where("frame_index <= 20").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _run(spark, folder, SETTINGS, 10.0)
    late = spark.read.parquet(f"{folder}/out/late")
    assert late.count() == rows.where("frame_index <= 20").count()


def test_archive_replaces_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id STRING, n INT"
    replace_rows(spark.createDataFrame([("a", 1), ("b", 1)], schema), path, "id", 0, buckets=2)
    for _ in range(2):  # the second time is a replay
        replace_rows(spark.createDataFrame([("b", 2), ("c", 2)], schema), path, "id", 2, buckets=2)
        assert sorted(map(tuple, read_archive(spark, path, schema).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    replace_rows(spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], schema), path, "id", 4, buckets=2)
    replace_rows(spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], schema), path, "id", 6, buckets=2)
    assert sorted(map(tuple, read_archive(spark, path, schema).collect())) == [("a", 4), ("b", 4), ("c", 4)]
    assert not list((tmp_path / "t").glob("bucket=*/version=0"))
    assert read_archive(spark, str(tmp_path / "none"), schema).collect() == []


def test_detection_log(spark, small, tmp_path):
    rows = fx.observations(spark, small).withColumn("quality_score", F.lit(None).cast("double"))
    rows = rows.select(*column_names(OBSERVATIONS))
    rows.write.parquet(str(tmp_path / "in"))
    run_detection_log(
        observation_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")
    ).awaitTermination(300)
    assert read_detection_log(spark, str(tmp_path / "log")).count() == rows.where("recognized").count()


def test_faulty_rows_are_named(spark):
    rows = spark.createDataFrame(
        [("s", 1, None, None, None, 0.1, 0.2, True, "good", None), (None, 1, None, None, None, 0.1, 0.2, True, "good", None)],
        OBSERVATIONS,
    )
    assert sorted(r.error for r in fault(rows).collect()) == ["missing stream", "missing time"]


def test_a_micro_batch_is_computed_and_reported_once(spark, tmp_path):
    """the steps of the sink run over the written batch, not over all partitions of the stream's plan."""
    start = datetime(2024, 1, 1)
    rows = [
        (f"s{i % 3}", i, 0, start + timedelta(hours=i), f"P{i % 2}", "SESSION_ENDED" if i % 2 else "SESSION_STARTED", "a", "b", f"k{i}", "r", start, start, 1, 0)
        for i in range(40)
    ]
    kind = (
        "stream_id string, frame_index bigint, event_seq int, ts timestamp, identity string, event_type string, previous_state string, "
        "new_state string, session_id string, reason string, started_at timestamp, last_seen_at timestamp, observation_count int, interruption_count int"
    )
    batch = spark.createDataFrame(rows, kind).repartition(60, "frame_index")
    context = spark.sparkContext
    context.setJobGroup("sink", "sink")
    try:
        attendance_sink(f"{tmp_path}/out", 0.0)(batch, 0)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("sink") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)) is not None)
    assert read_sessions(spark, f"{tmp_path}/out").count() == 40
    assert tasks < 400, tasks
    assert not (tmp_path / "out" / "staged" / "batch-0").exists()
