"""Public shapes of results: no vectors or file paths, values rounded at this edge only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollmark.functions.scalars import is_active, with_rounding

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def public_observations(observations: DataFrame) -> DataFrame:
    seconds = F.round(F.unix_micros("ts") / F.lit(1e6), 3)
    shown = observations.select(
        "stream_id",
        seconds.alias("timestamp"),
        "frame_index",
        "identity",
        "best_candidate",
        "similarity",
        "threshold",
        "recognized",
        "quality_status",
    )
    return with_rounding(shown, {"similarity": 4, "threshold": 4})


def public_stabilised(stabilised: DataFrame) -> DataFrame:
    return with_rounding(stabilised.drop("ts", "unknown_count"), {"confidence_score": 4})


def public_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_type",
        "identity",
        F.date_format("ts", ISO).alias("timestamp"),
        "previous_state",
        "new_state",
        "session_id",
        "reason",
    )


def public_sessions(sessions: DataFrame) -> DataFrame:
    shown = sessions.select(
        "session_id",
        "identity",
        *[F.date_format(c, ISO).alias(c) for c in ("started_at", "last_seen_at", "ended_at")],
        "state",
        is_active(F.col("state"), F.col("ended_at")).alias("is_active"),
        "duration_seconds",
        "observation_count",
        "interruption_count",
    )
    return with_rounding(shown, {"duration_seconds": 2})


def public_records(records: DataFrame) -> DataFrame:
    """Attendance records as they are shown: text dates and times, dwell at two places."""
    shown = records.select(
        "record_id",
        "identity",
        F.col("date").cast("string").alias("date"),
        *[F.date_format(c, ISO).alias(c) for c in ("first_check_in", "last_check_out")],
        "total_dwell_seconds",
        "session_count",
        "status",
        "last_confidence_score",
        *[F.date_format(c, ISO).alias(c) for c in ("created_at", "updated_at")],
    )
    return with_rounding(shown, {"total_dwell_seconds": 2, "last_confidence_score": 4})


def public_audits(audits: DataFrame) -> DataFrame:
    """Session audits as they are shown."""
    shown = audits.select(
        "session_id",
        "identity",
        F.col("date").cast("string").alias("date"),
        *[F.date_format(c, ISO).alias(c) for c in ("started_at", "ended_at")],
        "duration_seconds",
        "observation_count",
        "interruption_count",
        "closure_reason",
    )
    return with_rounding(shown, {"duration_seconds": 2})


def public_frames(results: DataFrame, stabilised: DataFrame, events: DataFrame) -> DataFrame:
    """One nested row per frame: recognition, smoothing result and the frame's presence events.

    A frame has at most two events per live identity, so the nested list stays short.
    """
    key = ["stream_id", "frame_index"]
    recognition = with_rounding(results, {"similarity": 4, "threshold": 4}).select(
        *key,
        F.date_format("ts", ISO).alias("timestamp"),
        F.struct(
            "identity", "best_candidate", "similarity", "threshold", "recognized", "quality_status"
        ).alias("recognition"),
    )
    temporal = public_stabilised(stabilised).select(
        *key,
        F.struct(
            "stable_identity",
            "state",
            "is_stable",
            "confidence_score",
            "observations_count",
            "consecutive_stable_count",
            "active_candidate",
        ).alias("temporal"),
    )
    listed = events.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("event_seq", "event_type", "identity", "previous_state", "new_state", "session_id", "reason")
            )
        ).alias("presence_events")
    )
    return recognition.join(temporal, key, "left").join(listed, key, "left").withColumn(
        "presence_events", F.coalesce("presence_events", F.array().cast(listed.schema["presence_events"].dataType))
    )
