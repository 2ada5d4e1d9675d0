"""Daily attendance from presence events or sessions, audits, summaries and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollmark.functions.scalars import (
    duration_status,
    is_named,
    journal_check_out,
    journal_minutes,
    round_half_even,
    seconds_between,
)

RECORD_COLUMNS = [
    "record_id",
    "identity",
    "date",
    "first_check_in",
    "last_check_out",
    "total_dwell_seconds",
    "session_count",
    "status",
    "last_confidence_score",
    "created_at",
    "updated_at",
]
AUDIT_COLUMNS = [
    "session_id",
    "identity",
    "date",
    "started_at",
    "ended_at",
    "duration_seconds",
    "observation_count",
    "interruption_count",
    "closure_reason",
]
ENTRY, ENDED, RESUMED = "ENTRY_CONFIRMED", "SESSION_ENDED", "PRESENCE_RESUMED"


def _record_id() -> Column:
    return F.sha2(F.concat_ws("#", F.col("identity"), F.col("date").cast("string")), 256)


def first_per_session(events: DataFrame) -> DataFrame:
    """Keep the first event of each (session, type); events without a session all stay."""
    others = [c for c in events.columns if c not in ("session_id", "event_type")]
    first = F.min_by(F.struct(*others), F.struct("ts", "frame_index", "event_seq"))
    keyed = (
        events.where("session_id IS NOT NULL")
        .groupBy("session_id", "event_type")
        .agg(first.alias("_e"))
        .select("session_id", "event_type", "_e.*")
    )
    return keyed.unionByName(events.where("session_id IS NULL").select(*keyed.columns))


def _relevant(events: DataFrame) -> DataFrame:
    """Entries, resumes and first closes of named identities, with date and arrival order."""
    columns = ["session_id", "event_type", "identity", "ts", "frame_index", "event_seq", "reason"]
    named = events.where(is_named(F.col("identity")) & F.col("event_type").isin(ENTRY, ENDED, RESUMED)).select(*columns)
    closes = F.col("event_type") == ENDED
    kept = named.where(~closes).unionByName(first_per_session(named.where(closes)).select(*columns))
    return kept.select(
        "*", F.to_date("ts").alias("date"), F.struct("ts", "frame_index", "event_seq", "event_type").alias("_at")
    )


def attendance_from_events(events: DataFrame, min_present_seconds: float = 0.0) -> DataFrame:
    """One record per (identity, date); dwell spans from first check-in to the last close.

    A repeated close of a session counts once. All parts are partial aggregations, so a hot
    (identity, date) is combined in the tasks before it is shuffled.
    """
    kind, main = F.col("event_type"), F.col("event_type").isin(ENTRY, ENDED)
    by_entry = (kind == ENTRY) & F.col("session_id").isNotNull()
    daily = (
        _relevant(events)
        .groupBy("identity", "date")
        .agg(
            F.min_by(F.struct("ts", by_entry.alias("counted")), F.when(main, F.col("_at"))).alias("_first"),
            F.max(F.when(main, F.col("_at"))).alias("_last"),
            F.max(F.when(kind == ENDED, F.col("ts"))).alias("last_check_out"),
            F.max(F.when(kind == RESUMED, F.col("_at"))).alias("_resumed"),
            F.count_distinct(F.when(kind == ENTRY, F.col("session_id"))).alias("_entries"),
        )
        .where(F.col("_last").isNotNull())
    )
    dwell = F.coalesce(seconds_between(F.col("_first.ts"), F.col("last_check_out")), F.lit(0.0))
    open_status = F.lit("IN_PROGRESS" if min_present_seconds > 0 else "PRESENT")
    base = F.when(F.col("_last.event_type") == ENTRY, open_status).otherwise(
        duration_status(dwell, min_present_seconds)
    )
    reopened = F.coalesce(F.col("_resumed") > F.col("_last"), F.lit(False)) & (base != "PRESENT")
    return daily.select(
        _record_id().alias("record_id"),
        "identity",
        "date",
        F.col("_first.ts").alias("first_check_in"),
        "last_check_out",
        dwell.alias("total_dwell_seconds"),
        (F.col("_entries") + F.when(F.col("_first.counted"), 0).otherwise(1)).alias("session_count"),
        F.when(reopened, F.lit("IN_PROGRESS")).otherwise(base).alias("status"),
        F.lit(1.0).alias("last_confidence_score"),
        F.col("_first.ts").alias("created_at"),
        F.when(reopened, F.col("_resumed.ts")).otherwise(F.col("_last.ts")).alias("updated_at"),
    )


def audit_from_events(events: DataFrame) -> DataFrame:
    """Audit row per first close of a session, measured from the day's first check-in."""
    relevant = _relevant(events).where(F.col("event_type").isin(ENTRY, ENDED))
    first = relevant.groupBy("identity", "date").agg(F.min("ts").alias("_first"))
    named = F.coalesce("session_id", F.concat(F.lit("session_"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    return (
        relevant.where(F.col("event_type") == ENDED)
        .join(first, ["identity", "date"])
        .select(
            named.alias("session_id"),
            "identity",
            "date",
            F.col("_first").alias("started_at"),
            F.col("ts").alias("ended_at"),
            seconds_between(F.col("_first"), F.col("ts")).alias("duration_seconds"),
            F.lit(1).alias("observation_count"),
            F.lit(0).alias("interruption_count"),
            F.coalesce(F.nullif("reason", F.lit("")), F.lit("session_ended")).alias("closure_reason"),
        )
    )


def attendance_from_sessions(sessions: DataFrame, min_present_seconds: float = 0.0) -> DataFrame:
    """One record per (identity, start date); dwell and sessions are summed."""
    out = F.coalesce("ended_at", "last_seen_at")
    daily = (
        sessions.where(is_named(F.col("identity")))
        .groupBy("identity", F.to_date("started_at").alias("date"))
        .agg(
            F.min("started_at").alias("first_check_in"),
            F.max(out).alias("last_check_out"),
            F.sum("duration_seconds").alias("total_dwell_seconds"),
            F.count(F.lit(1)).alias("session_count"),
        )
    )
    return daily.select(
        _record_id().alias("record_id"),
        "identity",
        "date",
        "first_check_in",
        "last_check_out",
        "total_dwell_seconds",
        "session_count",
        duration_status(F.col("total_dwell_seconds"), min_present_seconds).alias("status"),
        F.lit(1.0).alias("last_confidence_score"),
        F.col("first_check_in").alias("created_at"),
        F.col("last_check_out").alias("updated_at"),
    )


def audit_from_sessions(sessions: DataFrame, closure_reason: str = "normal_exit") -> DataFrame:
    """Audit rows with the sessions' own times and counts."""
    return sessions.select(
        "session_id",
        "identity",
        F.to_date("started_at").alias("date"),
        "started_at",
        F.coalesce("ended_at", "last_seen_at").alias("ended_at"),
        "duration_seconds",
        "observation_count",
        "interruption_count",
        F.lit(closure_reason).alias("closure_reason"),
    )


def daily_summary(records: DataFrame) -> DataFrame:
    """Record counts by status and dwell totals per date."""
    status = F.col("status")
    return records.groupBy("date").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(status == "PRESENT").alias("total_present"),
        F.count_if(status == "IN_PROGRESS").alias("total_in_progress"),
        F.count_if(status == "PARTIAL").alias("total_partial"),
        F.sum("total_dwell_seconds").alias("total_dwell_seconds"),
        F.avg("total_dwell_seconds").alias("average_dwell_seconds"),
    )


def _listed(rows: DataFrame, date: str | None, identity: str | None, order: str) -> DataFrame:
    if date:
        rows = rows.where(F.col("date") == F.lit(date).cast("date"))
    if identity:
        rows = rows.where(F.col("identity") == identity)
    return rows.orderBy(order)


def list_records(records: DataFrame, date: str | None = None, identity: str | None = None) -> DataFrame:
    """Records of a date and/or identity by check-in; a date prunes partitions."""
    return _listed(records, date, identity, "first_check_in")


def list_audits(audits: DataFrame, date: str | None = None, identity: str | None = None) -> DataFrame:
    return _listed(audits, date, identity, "started_at")


def find_record(records: DataFrame, identity: str, date: str) -> DataFrame:
    return records.where((F.col("identity") == identity) & (F.col("date") == F.lit(date).cast("date")))


def find_identity(rows: DataFrame, identity: str) -> DataFrame:
    """Rows of one identity: of the records, the audits or the enrolled identities."""
    return rows.where(F.col("identity") == identity)


def _upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys, except for the ``kept`` columns."""
    others = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*others).alias("_old"))
    right = new.select(*keys, F.struct(*others).alias("_new"))
    joined = left.join(right, list(keys), "full_outer")
    fresh, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    columns = []
    for name in old.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in kept:
            columns.append(F.when(known, F.col(f"_old.{name}")).otherwise(F.col(f"_new.{name}")).alias(name))
        else:
            columns.append(F.when(fresh, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}")).alias(name))
    return joined.select(*columns)


def upsert_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Attendance by (identity, date), keeping the first record id and creation time."""
    return _upsert(records, changes, ["identity", "date"], ["record_id", "created_at"])


def upsert_identities(identities: DataFrame, changes: DataFrame) -> DataFrame:
    """Enrolled identities by name, keeping the first creation time."""
    return _upsert(identities, changes, ["identity"], ["created_at"])


def replace_audits(audits: DataFrame, changes: DataFrame) -> DataFrame:
    """Audit rows by session id; the change with the latest end wins."""
    others = [c for c in audits.columns if c != "session_id"]
    latest = (
        changes.groupBy("session_id")
        .agg(F.max_by(F.struct(*others), F.struct("ended_at", "started_at")).alias("_a"))
        .select("session_id", "_a.*")
    )
    return audits.join(latest, "session_id", "left_anti").unionByName(latest.select(*audits.columns))


def cleared(table: DataFrame) -> DataFrame:
    """No rows of the same schema."""
    return table.where(F.lit(False))


def reconcile_identities(identities: DataFrame, template_counts: DataFrame, now: Column) -> DataFrame:
    """Metadata brought in line with the gallery: missing rows added, changed counts fixed."""
    counts = template_counts.select("identity", F.col("template_count").alias("_n"))
    missing = F.col("template_count").isNull()
    changed = F.col("_n").isNotNull() & ~F.col("_n").eqNullSafe(F.col("template_count"))
    return identities.join(counts, "identity", "full_outer").select(
        "identity",
        F.coalesce("_n", "template_count").alias("template_count"),
        F.when(missing, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(missing, F.lit("Imported from initial gallery")).otherwise(F.col("notes")).alias("notes"),
    )


def identity_history(identities: DataFrame, records: DataFrame) -> DataFrame:
    """Identity metadata beside each of its attendance records, one row per record."""
    return identities.join(records, "identity", "left")


def csv_export(records: DataFrame) -> DataFrame:
    """The nine export columns as text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    return records.select(
        "record_id",
        "identity",
        F.col("date").cast("string").alias("date"),
        F.date_format("first_check_in", iso).alias("first_check_in"),
        F.coalesce(F.date_format("last_check_out", iso), F.lit("")).alias("last_check_out"),
        F.format_string("%.2f", round_half_even("total_dwell_seconds", 2)).alias("total_dwell_seconds"),
        F.col("session_count").cast("string").alias("session_count"),
        "status",
        F.date_format("updated_at", iso).alias("updated_at"),
    )


def json_export(records: DataFrame) -> DataFrame:
    """One JSON object of eleven fields per record, in column ``json``."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    return records.select(
        F.to_json(
            F.struct(
                "record_id",
                "identity",
                F.col("date").cast("string").alias("date"),
                F.date_format("first_check_in", iso).alias("first_check_in"),
                F.date_format("last_check_out", iso).alias("last_check_out"),
                round_half_even("total_dwell_seconds", 2).alias("total_dwell_seconds"),
                "session_count",
                "status",
                round_half_even("last_confidence_score", 4).alias("last_confidence_score"),
                F.date_format("created_at", iso).alias("created_at"),
                F.date_format("updated_at", iso).alias("updated_at"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("json")
    )


def journal(records: DataFrame) -> DataFrame:
    """Rows of the attendance journal: times, minutes with one decimal, open ends named."""
    return records.select(
        "identity",
        "date",
        F.date_format("first_check_in", "yyyy-MM-dd'T'HH:mm:ss").alias("check_in"),
        journal_check_out(F.col("last_check_out")).alias("check_out"),
        journal_minutes(F.col("total_dwell_seconds")).alias("minutes"),
        "session_count",
        "status",
    )
