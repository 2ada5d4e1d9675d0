"""Evaluation reports over the outputs of other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.functions.scalars import with_rounding
from rollmark.operators.metrics import ratio


def identification_report(results: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Known and unknown query rates and mean scores of a search, in one row.

    ``results`` is the output of ``gallery.search`` with ``true_identity``; a query is known
    when its true identity has a template.
    """
    names = enrolled.select(F.col("identity").alias("true_identity")).distinct().withColumn("_known", F.lit(True))
    marked = results.join(names, "true_identity", "left")
    known = F.coalesce("_known", F.lit(False))
    hit = known & (F.col("best_candidate") == F.col("true_identity"))
    facts = marked.agg(
        F.count_if(known).alias("known"),
        F.count_if(hit).alias("hits"),
        F.count_if(known & F.col("recognized")).alias("accepted"),
        F.avg(F.when(known, F.col("score"))).alias("known_mean"),
        F.count_if(~known).alias("unknown"),
        F.count_if(~known & ~F.col("recognized")).alias("rejected"),
        F.avg(F.when(~known, F.col("score"))).alias("unknown_mean"),
    )
    known_mean = F.coalesce("known_mean", F.lit(0.0))
    unknown_mean = F.coalesce("unknown_mean", F.lit(0.0))

    def percent(part: str, whole: str) -> Column:
        return ratio(F.col(part), F.col(whole)) * 100

    report = facts.select(
        F.col("known").alias("known_queries_evaluated"),
        percent("hits", "known").alias("known_correct_candidate_pct"),
        percent("accepted", "known").alias("known_accepted_pct"),
        known_mean.alias("known_avg_similarity"),
        F.col("unknown").alias("unknown_queries_evaluated"),
        percent("rejected", "unknown").alias("unknown_rejected_pct"),
        unknown_mean.alias("unknown_avg_similarity"),
        (known_mean - unknown_mean).alias("score_margin"),
    )
    shares = ["known_correct_candidate_pct", "known_accepted_pct", "unknown_rejected_pct"]
    means = ["known_avg_similarity", "unknown_avg_similarity", "score_margin"]
    return with_rounding(report, dict.fromkeys(shares, 2) | dict.fromkeys(means, 4))


def latency_profile(latencies: DataFrame, stages: Sequence[str], total: str) -> DataFrame:
    """Mean, min and max milliseconds per stage, and frames per second from the mean total."""
    long = latencies.unpivot([], [*stages, total] if total not in stages else list(stages), "stage", "ms")
    mean = F.avg("ms")
    return long.groupBy("stage").agg(
        mean.alias("mean_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.when((F.first("stage") == total) & (mean > 0), 1000.0 / mean).alias("fps"),
    )


def temporal_policy_report(stabilised: DataFrame, truth_col: str = "true_identity") -> DataFrame:
    """Accuracy, latency, recovery and false switches of each policy on labelled sequences.

    Rows are stabiliser outputs with ``mode``, ``stream_id``, ``frame_index`` (from 1),
    ``recognized``, the true identity, and a ``challenged`` flag on frames that show a wrong
    identity in passing.
    """
    correct = F.col("stable_identity").eqNullSafe(F.col(truth_col))
    per_stream = stabilised.groupBy("mode", "stream_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(correct).alias("correct"),
        F.min(F.when(F.col("is_stable"), F.col("frame_index"))).alias("first_stable"),
        F.count_if(~F.col("recognized")).alias("dropouts"),
        F.count_if(~F.col("recognized") & correct).alias("recovered"),
        F.count_if(F.col("challenged")).alias("blips"),
        F.count_if(F.col("challenged") & ~correct & F.col("stable_identity").isNotNull()).alias("switched"),
    )
    report = per_stream.groupBy("mode").agg(
        ratio(F.sum("correct"), F.sum("frames")).alias("accuracy"),
        F.coalesce(F.avg("first_stable"), F.lit(0.0)).alias("mean_stabilization_latency"),
        ratio(F.sum("recovered"), F.sum("dropouts")).alias("transient_recovery_rate"),
        ratio(F.sum("switched"), F.sum("blips")).alias("false_switch_rate"),
        F.sum("frames").alias("total_frames_evaluated"),
    )
    rates = dict.fromkeys(["accuracy", "transient_recovery_rate", "false_switch_rate"], 4)
    return with_rounding(report, rates | {"mean_stabilization_latency": 2})


def first_stable_frames(stabilised: DataFrame) -> DataFrame:
    """First stable frame of each stream, NULL if it never settles."""
    return stabilised.groupBy("stream_id").agg(
        F.min(F.when(F.col("is_stable"), F.col("frame_index"))).alias("first_stable_frame")
    )


def presence_policy_report(events: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Entry delay, recovery, continuity and false entries of each presence policy.

    ``events`` carry ``mode`` and ``false_entry``, whether an entry is of somebody who isn't there;
    ``first_seen`` has the first stable time per (mode, stream_id, identity), each of which is a run.
    Recovery is resumes over graces. A run with more than one entry has duplicate sessions; continuity
    is the share of runs without.
    """
    key = ["mode", "stream_id", "identity"]
    kind = F.col("event_type")
    per_identity = events.groupBy(*key).agg(
        F.min(F.when(kind == "ENTRY_CONFIRMED", F.col("ts"))).alias("entered_at"),
        F.count_if(kind == "ENTRY_CONFIRMED").alias("entries"),
        F.count_if(kind == "GRACE_STARTED").alias("graces"),
        F.count_if(kind == "PRESENCE_RESUMED").alias("resumes"),
        F.count_if(kind == "SESSION_ENDED").alias("ended"),
        F.count_if((kind == "ENTRY_CONFIRMED") & F.col("false_entry")).alias("false_entries"),
    )
    delay = (F.unix_micros("entered_at") - F.unix_micros("first_ts")) / F.lit(1e6)
    runs = F.count(F.lit(1))
    duplicates = ratio(F.count_if(F.col("entries") > 1), runs)
    report = (
        first_seen.join(per_identity, key, "left")
        .groupBy("mode")
        .agg(
            F.coalesce(F.avg(delay), F.lit(0.0)).alias("mean_entry_delay_seconds"),
            ratio(F.sum("resumes"), F.sum("graces")).alias("interruption_recovery_rate"),
            (F.lit(1.0) - duplicates).alias("session_continuity_rate"),
            duplicates.alias("duplicate_session_rate"),
            ratio(F.count_if(F.col("false_entries") > 0), runs).alias("false_entry_rate"),
            F.coalesce(F.sum("entries"), F.lit(0)).alias("sessions"),
            F.coalesce(F.sum("ended"), F.lit(0)).alias("ended_sessions"),
            runs.alias("identities_evaluated"),
        )
    )
    rates = ["interruption_recovery_rate", "session_continuity_rate", "duplicate_session_rate", "false_entry_rate"]
    return with_rounding(report, {"mean_entry_delay_seconds": 2} | dict.fromkeys(rates, 4))


def latest_per_stream(rows: DataFrame, n: int, order: str = "frame_index") -> DataFrame:
    """The last ``n`` rows of each stream; tasks trim streams before the shuffle."""
    newest = Window.partitionBy("stream_id").orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
