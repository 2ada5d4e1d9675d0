"""Live jobs: observations to presence events to the attendance table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from rollmark import schemas
from rollmark.functions.scalars import is_named, seconds_between, session_key
from rollmark.operators.attendance import ENDED, attendance_from_events
from rollmark.operators.presence import ABSENT, GRACE, PRESENT
from rollmark.sources.writers import write_attendance
from rollmark.streaming.archive import read_archive, replace_rows
from rollmark.streaming.processor import LATE, OUTPUT, PresenceProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of this stream are no observations: their time moves the clock, so that silent streams go on.
CLOCK = "*"
#: How far a row may be behind the newest one of all streams, in seconds.
LATENESS = 10.0
#: Spans of event time into which waiting rows are dealt, for each stretch of the lateness.
SPANS = 4
SESSIONS = (
    "session_id STRING, stream_id STRING, identity STRING, started_at TIMESTAMP, last_seen_at TIMESTAMP, ended_at TIMESTAMP, "
    "state STRING, duration_seconds DOUBLE, observation_count INT, interruption_count INT, reason STRING, as_of TIMESTAMP"
)
AUDITS = (
    "session_id STRING, identity STRING, date DATE, started_at TIMESTAMP, ended_at TIMESTAMP, duration_seconds DOUBLE, "
    "observation_count INT, interruption_count INT, closure_reason STRING"
)


def fault(observations: DataFrame) -> DataFrame:
    """Add ``error``: why a row cannot take part, NULL for good rows."""
    checks = [
        (F.col("stream_id").isNull(), "missing stream"),
        (F.col("ts").isNull(), "missing time"),
        (F.col("frame_index").isNull(), "missing frame number"),
        (F.col("recognized").isNull(), "missing recognition result"),
    ]
    return observations.withColumn("error", F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def live_events(
    observations: DataFrame,
    temporal: Mapping[str, float],
    presence: Mapping[str, float],
    lateness: float = LATENESS,
    grace_timeout: bool = False,
) -> DataFrame:
    """Presence events of a stream of observations, one state per ``stream_id``.

    A row is folded when the watermark, ``lateness`` seconds behind the newest row of all streams, has
    passed its span of event time, so rows within the lateness may come in any order. A row older than
    the watermark is emitted as a ``LATE`` row and changes nothing. A frame without a recognition result
    counts as an unrecognised one. Rows without a stream, a time or a frame number can't be placed and
    are left out; ``run_fault_log`` keeps all faulty rows. With ``grace_timeout`` a session ends when it
    has been in grace for the whole period, whether or not a frame comes; without, on the next frame.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    clock = F.col("stream_id") == CLOCK
    placed = observations.where(F.col("stream_id").isNotNull() & F.col("ts").isNotNull() & (clock | F.col("frame_index").isNotNull()))
    placed = placed.withWatermark("ts", f"{int(round(lateness * 1000))} milliseconds")
    # the condition names the time, so that it stays behind the watermark and clock rows move it
    placed = placed.where(F.when(F.col("ts").isNotNull(), ~clock))
    # Spark drops late rows by the end of their window before a stateful operator sees them: an endless one keeps them
    good = placed.select(
        F.window("ts", "365000 days").alias("era"),
        "stream_id",
        "frame_index",
        F.unix_micros("ts").alias("us"),
        "identity",
        "best_candidate",
        F.coalesce("recognized", F.lit(False)).alias("recognized"),
        F.coalesce("quality_status", F.lit("none")).alias("quality_status"),
    )
    span_ms = max(1, int(round(lateness * 1000)) // SPANS)
    raw = good.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=PresenceProcessor(temporal, presence, span_ms, grace_timeout),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return _events(raw)


def _events(raw: DataFrame) -> DataFrame:
    """Rows of ``OUTPUT`` as presence events."""
    started = F.timestamp_micros("started_us")
    return raw.select(
        "stream_id",
        "frame_index",
        "event_seq",
        F.timestamp_micros("us").alias("ts"),
        "identity",
        "event_type",
        "previous_state",
        "new_state",
        F.when(started.isNotNull(), session_key(F.col("stream_id"), F.col("identity"), started)).alias("session_id"),
        "reason",
        started.alias("started_at"),
        F.timestamp_micros("last_seen_us").alias("last_seen_at"),
        "observation_count",
        "interruption_count",
    )


def _log(events: DataFrame, version: int, path: str, mode: str = "overwrite") -> None:
    """Write a micro-batch under its own number, so that a replay replaces it."""
    (
        events.withColumns({"date": F.to_date("ts"), "batch": F.lit(version)})
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "batch")
        .parquet(path)
    )


def sessions_of(events: DataFrame) -> DataFrame:
    """The sessions that events tell of, each as of its latest event."""
    last = F.max_by(
        F.struct("stream_id", "identity", "started_at", "last_seen_at", "ts", "new_state", "observation_count", "interruption_count", "event_type", "reason"),
        F.struct("frame_index", "event_seq"),
    )
    latest = events.where("session_id IS NOT NULL").groupBy("session_id").agg(last.alias("_s")).select("session_id", "_s.*")
    closed = F.col("event_type") == ENDED
    return latest.select(
        "session_id",
        "stream_id",
        "identity",
        "started_at",
        "last_seen_at",
        F.when(closed, F.col("ts")).alias("ended_at"),
        F.col("new_state").alias("state"),
        seconds_between(F.col("started_at"), F.col("ts")).alias("duration_seconds"),
        "observation_count",
        "interruption_count",
        F.when(closed, F.col("reason")).alias("reason"),
        F.col("ts").alias("as_of"),
    )


def audits_of(sessions: DataFrame) -> DataFrame:
    """Audit rows of the closed sessions of named identities."""
    closed = sessions.where(F.col("ended_at").isNotNull() & is_named(F.col("identity")))
    return closed.select(
        "session_id",
        "identity",
        F.to_date("started_at").alias("date"),
        "started_at",
        "ended_at",
        "duration_seconds",
        "observation_count",
        "interruption_count",
        F.col("reason").alias("closure_reason"),
    )


def _update(events: DataFrame, version: int, output: str, min_present_seconds: float) -> None:
    """Bring the attendance of the days, the sessions and the audits up to logged events."""
    spark = events.sparkSession
    days = events.select(F.to_date("ts").alias("date")).distinct()
    if days.isEmpty():
        return
    log = spark.read.parquet(f"{output}/events").join(days, "date", "left_semi")
    write_attendance(attendance_from_events(log.drop("date", "batch"), min_present_seconds), f"{output}/attendance")
    sessions = sessions_of(events)
    replace_rows(sessions, f"{output}/sessions", "session_id", version)
    replace_rows(audits_of(sessions), f"{output}/audits", "session_id", version)


@contextmanager
def _staged(rows: DataFrame, path: str, spark: SparkSession) -> Iterator[DataFrame]:
    """``rows`` written once and read from there by ``spark``, until the end.

    Each task over a cached micro-batch sends the driver the metrics of the whole stateful plan, and
    the session of a stream runs every shuffle with all its partitions. Tasks over the files do neither.
    """
    rows.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def attendance_sink(output: str, min_present_seconds: float = 0.0, spark: SparkSession | None = None):
    """``foreachBatch`` function: log the events, then redo the attendance of the days they touch, sessions and audits.

    The first two replace whole partitions with content that depends on the log alone, the last two
    write versions from the ones before, so a restarted batch changes nothing it had already done.
    The tables are made in the session ``spark``, or in the stream's own if none is given.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with _staged(batch, f"{output}/staged/batch-{batch_id}", spark or batch.sparkSession) as rows:
            late = F.col("event_type") == LATE
            _log(rows.where(~late), 2 * batch_id, f"{output}/events")
            _log(rows.where(late), 2 * batch_id, f"{output}/late")
            _update(rows.where(~late), 2 * batch_id, output, min_present_seconds)

    return write


def run_attendance_stream(
    observations: DataFrame,
    temporal: Mapping[str, float],
    presence: Mapping[str, float],
    output: str,
    checkpoint: str,
    min_present_seconds: float = 0.0,
    available_now: bool = True,
    lateness: float = LATENESS,
    grace_timeout: bool = False,
) -> StreamingQuery:
    """Start the live job; its tables are ``events``, ``late``, ``attendance``, ``sessions`` and ``audits`` under ``output``.

    Rows newer than the watermark wait; ``tick`` moves it on when no more rows come.
    """
    writer = (
        live_events(observations, temporal, presence, lateness, grace_timeout)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(attendance_sink(output, min_present_seconds, observations.sparkSession))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tick(spark: SparkSession, path: str, at: Column) -> None:
    """Add a clock row to the folder that a job reads: it is ``at`` now in every stream."""
    row = spark.range(1).select(F.lit(CLOCK).alias("stream_id"), at.alias("ts"))
    others = {name: F.lit(None) for name in schemas.column_names(schemas.OBSERVATIONS) if name not in row.columns}
    kinds = dict(part.split() for part in schemas.OBSERVATIONS.split(", "))
    row = row.withColumns(others).select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])
    row.write.mode("append").parquet(path)


def read_sessions(spark: SparkSession, output: str) -> DataFrame:
    """All sessions of the live job, open and closed."""
    return read_archive(spark, f"{output}/sessions", SESSIONS)


def read_audits(spark: SparkSession, output: str) -> DataFrame:
    return read_archive(spark, f"{output}/audits", AUDITS)


def _last_batch(spark: SparkSession, checkpoint: str) -> int:
    """Number of the last micro-batch that was finished, -1 if there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    names = [status.getPath().getName() for status in found or []]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def forget_last_batch(spark: SparkSession, checkpoint: str) -> None:
    """Take the last micro-batch for unfinished, as after a crash behind its writes: the next start does it again."""
    jvm = spark._jvm
    name = str(_last_batch(spark, checkpoint))
    for file in (f"{checkpoint}/commits/{name}", f"{checkpoint}/commits/.{name}.crc"):
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def closing_events(spark: SparkSession, checkpoint: str, at: Column, reason: str = "runtime_shutdown") -> DataFrame:
    """An event that ends each session open in the state of a job that isn't running, at a given time."""
    rows = spark.read.format("statestore").option("stateVarName", "stream").load(checkpoint)
    tracker = "struct<created:bigint,state:string,started:bigint,last_seen:bigint,seen:int,interruptions:int>"
    parsed = F.from_json("value.state", f"frame bigint, seq int, live map<string,{tracker}>")
    state = rows.select(F.col("key.stream_id").alias("stream_id"), parsed.alias("s"))
    live = state.select("stream_id", "s.frame", "s.seq", F.explode("s.live").alias("identity", "t")).where(F.col("t.state").isin(PRESENT, GRACE))
    turn = F.row_number().over(Window.partitionBy("stream_id").orderBy("t.created", "identity"))
    raw = live.select(
        "stream_id",
        F.col("frame").alias("frame_index"),
        (F.col("seq") + turn - 1).alias("event_seq"),
        F.unix_micros(at).alias("us"),
        "identity",
        F.lit(ENDED).alias("event_type"),
        F.col("t.state").alias("previous_state"),
        F.lit(ABSENT).alias("new_state"),
        F.lit(f"session closed due to {reason}").alias("reason"),
        F.col("t.started").alias("started_us"),
        F.col("t.last_seen").alias("last_seen_us"),
        F.col("t.seen").alias("observation_count"),
        F.col("t.interruptions").alias("interruption_count"),
    )
    return _events(raw)


def stop_attendance_stream(
    spark: SparkSession, checkpoint: str, output: str, at: Column, reason: str = "runtime_shutdown", min_present_seconds: float = 0.0
) -> None:
    """End all sessions of a job that has been stopped, once: a second stop changes nothing.

    The closing events are logged behind the last micro-batch, and the tables are brought up to them. A
    session that was closed already is left alone, so a stop that broke off is finished by another one.
    Start the next job with a new checkpoint: the old one still holds the sessions as open.
    """
    version = 2 * _last_batch(spark, checkpoint) + 1
    closing = closing_events(spark, checkpoint, at, reason)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/events")
    begun = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if begun:
        log = spark.read.parquet(f"{output}/events")
        closing = closing.join(log.where(F.col("event_type") == ENDED).select("session_id"), "session_id", "left_anti").select(*closing.columns)
    with _staged(closing, f"{output}/staged/stop-{version}", spark) as rows:
        if not rows.isEmpty():
            _log(rows, version, f"{output}/events", "append")
        elif not begun:
            return
        logged = spark.read.parquet(f"{output}/events").where(F.col("batch") == version).drop("date", "batch")
        _update(logged, version, output, min_present_seconds)


def run_detection_log(observations: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append (name, time) of every recognised row as CSV, without sessions."""
    lines = observations.where("recognized").select(
        F.col("identity").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")
    )
    return (
        lines.writeStream.format("csv")
        .option("header", True)
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_fault_log(observations: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append every faulty row with its error, whole, to a side table."""
    return (
        fault(observations)
        .where("error IS NOT NULL")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stream_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current state of each stream, read from the job's state store."""
    rows = spark.read.format("statestore").option("stateVarName", "stream").load(checkpoint)
    state = F.col("value.state")
    return rows.select(
        F.col("key.stream_id").alias("stream_id"),
        F.get_json_object(state, "$.holder.stable").alias("current_stable_identity"),
        F.get_json_object(state, "$.count").cast("bigint").alias("consecutive_stable_count"),
        F.get_json_object(state, "$.holder.unknowns").cast("bigint").alias("consecutive_unknown_count"),
        F.get_json_object(state, "$.holder.challenger").alias("challenger_identity"),
        F.get_json_object(state, "$.holder.challenges").cast("bigint").alias("challenger_count"),
    )
