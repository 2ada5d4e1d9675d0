"""Registered queries: each maps (session, table folder) to a result over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollmark.functions import vectors as vec
from rollmark.functions import scalars as sca
from rollmark.operators import attendance as att
from rollmark.operators import calibration as cal
from rollmark.operators import dataset as dat
from rollmark.operators import enrollment as enr
from rollmark.operators import gallery as gal
from rollmark.operators import metrics as met
from rollmark.operators import pairs as prs
from rollmark.operators import presence as pre
from rollmark.operators import projections as pub
from rollmark.operators import quality as qua
from rollmark.operators import reports as rep
from rollmark.operators import temporal as tem
from rollmark.plans import fixtures as fx
from rollmark.policies import PRESENCE, TEMPORAL, resolve
from rollmark.schemas import OBSERVATIONS, column_names
from rollmark.session import ensure_checkpoint_dir, materialize
from rollmark.sources.readers import observation_stream
from rollmark.streaming.jobs import forget_last_batch, read_audits, read_sessions, run_attendance_stream, stop_attendance_stream, tick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Float results are compared at six places: summation order is free in both engines."""
    return df.withColumns({c: F.round(c, places) for c in cols})


# Verification metrics and calibration


@query("confusion_at_threshold")
def _confusion(spark, sf):
    result = met.confusion_at(fx.scored_pairs(spark, sf), 0.24, group_cols=["experiment_id"])
    return rounded(result, "accuracy", "far", "frr")


@query("threshold_sweep")
def _sweep(spark, sf):
    return cal.threshold_sweep(fx.scored_pairs(spark, sf))


@query("roc_curve")
def _roc(spark, sf):
    return rounded(met.roc_points(fx.scored_pairs(spark, sf)), "tpr", "fpr")


#: Small cells, so that hot groups are cut even on small tables.
SMALL_CELLS = 500


@query("roc_curve_continuous")
def _roc_continuous(spark, sf):
    points = met.roc_points(fx.continuous_pairs(spark, sf), drop_intermediate=False, rows_per_cell=SMALL_CELLS)
    return rounded(points, "tpr", "fpr")


@query("score_percentiles_continuous")
def _percentiles_continuous(spark, sf):
    return met.distribution_summary(fx.continuous_pairs(spark, sf), "raw_score", ["is_same"], rows_per_cell=SMALL_CELLS)


@query("roc_auc")
def _auc(spark, sf):
    return rounded(met.roc_auc(fx.scored_pairs(spark, sf)), "roc_auc")


@query("eer")
def _eer(spark, sf):
    return rounded(met.equal_error_rate(met.roc_points(fx.scored_pairs(spark, sf))), "eer", "eer_threshold")


@query("roc_distance")
def _roc_distance(spark, sf):
    flipped = fx.scored_pairs(spark, sf).withColumn("raw_score", F.round(2 - F.col("raw_score"), 4))
    area = met.roc_auc(flipped, ["fold"], met.DISTANCE)
    error = met.equal_error_rate(met.roc_points(flipped, met.DISTANCE, ["fold"]), met.DISTANCE, ["fold"])
    return rounded(area.join(error, "fold"), "roc_auc", "eer", "eer_threshold")


@query("optimal_threshold")
def _optimal(spark, sf):
    return rounded(met.optimal_threshold(fx.scored_pairs(spark, sf)), "optimal_threshold")


@query("fold_metrics")
def _folds(spark, sf):
    return met.fold_metrics(fx.scored_pairs(spark, sf))


@query("fold_score_stats")
def _fold_score_stats(spark, sf):
    return met.fold_score_stats(fx.scored_pairs(spark, sf))


@query("experiments_side_by_side")
def _side_by_side(spark, sf):
    return met.side_by_side(met.experiment_summary(fx.scored_pairs(spark, sf)))


@query("fold_summary")
def _fold_summary(spark, sf):
    return met.fold_summary(met.fold_metrics(fx.scored_pairs(spark, sf)))


@query("calibration_strategies")
def _strategies(spark, sf):
    return cal.calibration_strategies(fx.scored_pairs(spark, sf))


@query("identity_folds")
def _identity_folds(spark, sf):
    return cal.identity_folds(cal.pair_identities(fx.scored_pairs(spark, sf)), 5)


@query("threshold_stability")
def _stability(spark, sf):
    return cal.threshold_stability(fx.scored_pairs(spark, sf))


@query("score_stats")
def _score_stats(spark, sf):
    return rounded(met.score_stats(fx.scored_pairs(spark, sf)), "mean", "std", "min", "max", "median")


@query("score_percentiles")
def _percentiles(spark, sf):
    return met.distribution_summary(fx.scored_pairs(spark, sf), "raw_score", ["is_same"])


@query("score_histogram")
def _histogram(spark, sf):
    result = met.density_histogram(fx.scored_pairs(spark, sf), "raw_score", 50, ["is_same"])
    return rounded(result, "bin_start", "bin_end", "density")


@query("verification_summary")
def _verification(spark, sf):
    return met.verification_summary(fx.scored_pairs(spark, sf), 0.24)


@query("verification_report")
def _verification_report(spark, sf):
    return met.verification_report(fx.scored_pairs(spark, sf), 0.24)


@query("experiment_comparison")
def _experiments(spark, sf):
    return rounded(met.compare_experiments(fx.scored_pairs(spark, sf), 0.24), "accuracy", "far", "frr")


# Identity search


@query("gallery_search_cosine")
def _search(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    return rounded(gal.search(queries_df.select("query_id", "true_identity", "embedding"), templates), "score")


@query("gallery_search_blocks")
def _search_blocks(spark, sf):
    """The same search by the way of a gallery that is too large for a broadcast, in many blocks."""
    templates, queries_df = fx.gallery_roles(spark, sf)
    asked = queries_df.select("query_id", "true_identity", "embedding")
    return rounded(gal.search(asked, templates, broadcast_bytes=0, chunk_bytes=64 * 8 * 50), "score")


@query("gallery_quarantine")
def _quarantine(spark, sf):
    """Templates that a search leaves out: some vectors are cut short, spoilt or taken away here."""
    key, v = F.col("template_id"), F.col("embedding")
    spoilt = F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x.cast("double")))
    templates = fx.keyed_members(spark, sf).withColumnRenamed("key", "template_id")
    broken = F.when(key % 7 == 3, spoilt).when(key % 11 == 4, F.slice(v, 1, 63).cast("array<double>")).when(key % 13 != 5, v.cast("array<double>"))
    return gal.quarantined(templates.withColumn("embedding", broken))


@query("match_euclidean")
def _match_euclidean(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    return rounded(gal.match_euclidean(queries_df, templates, 1.2), "score")


@query("match_cosine_template")
def _match_cosine(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    return rounded(gal.match_cosine(queries_df, templates, 0.24), "score")


@query("nearest_centroid")
def _nearest_centroid(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    return rounded(gal.match_centroid(queries_df, gal.centres(templates)), "score")


@query("identity_centroids")
def _centroids(spark, sf):
    rows = vec.centroids(fx.keyed_members(spark, sf))
    spread = rows.select("identity", F.posexplode("embedding").alias("pos", "value"))
    return rounded(spread.withColumn("pos", F.col("pos").cast("bigint")), "value")


@query("gallery_validation")
def _validation(spark, sf):
    templates = fx.keyed_members(spark, sf).withColumnRenamed("key", "template_id")
    report = rounded(gal.validate(templates, 64), "min_norm", "max_norm", places=4)
    return report.withColumn("errors", F.array_join("errors", "; "))


@query("vector_report")
def _vector_report(spark, sf):
    return rounded(vec.vector_report(fx.keyed_members(spark, sf), 64), "min_norm", "max_norm", places=4)


@query("template_counts")
def _template_counts(spark, sf):
    return gal.template_counts(fx.gallery_roles(spark, sf)[0])


@query("gallery_summary")
def _gallery_summary(spark, sf):
    return gal.gallery_summary(fx.keyed_members(spark, sf))


@query("gallery_build_report")
def _build_report(spark, sf):
    rows = fx.keyed_members(spark, sf)
    return gal.build_report(rows.withColumn("embedding", F.when(F.col("key") % 11 != 0, F.col("embedding"))))


@query("gallery_add_remove")
def _add_remove(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    new = queries_df.select(
        (F.col("query_id") + 1).alias("template_id"), F.col("true_identity").alias("identity"), "embedding"
    )
    grown = gal.add_templates(templates, new, 64)
    return gal.template_counts(gal.remove_identity(grown, "id_3"))


@query("identification_report")
def _identification(spark, sf):
    templates, queries_df = fx.gallery_roles(spark, sf)
    enrolled = templates.where(F.col("identity") < "id_7")
    return rep.identification_report(gal.search(queries_df, enrolled), enrolled)


# Pairs and splits


@query("pair_scores")
def _pair_scores(spark, sf):
    scored = prs.score_pairs(fx.claimed_pairs(spark, sf), fx.keyed_members(spark, sf).select("key", "embedding"))
    return rounded(scored, "raw_score")


@query("genuine_pairs_capped")
def _genuine(spark, sf):
    return prs.genuine_pairs(fx.keyed_members(spark, sf), 150)


@query("impostor_pairs")
def _impostor(spark, sf):
    return prs.impostor_pairs(fx.keyed_members(spark, sf), 50_000)


@query("validation_pair_scores")
def _validation_pairs(spark, sf):
    members = fx.keyed_members(spark, sf)
    scored = materialize(prs.score_pairs(prs.validation_pairs(members, 150, 50_000), members.select("key", "embedding")))
    return rounded(met.score_stats(scored), "mean", "std", "min", "max", "median", places=5)


@query("banded_pairs")
def _banded(spark, sf):
    return prs.banded_pairs(fx.keyed_members(spark, sf))


@query("split_assignment")
def _splits(spark, sf):
    return prs.assign_splits(fx.keyed_members(spark, sf).select("identity", "key"))


@query("missing_cache_keys")
def _missing(spark, sf):
    wanted = fx.claimed_pairs(spark, sf).select(F.col("key1").alias("key"))
    return prs.missing_keys(wanted, fx.keyed_members(spark, sf))


@query("distinct_pair_keys")
def _distinct_keys(spark, sf):
    return prs.distinct_keys(fx.claimed_pairs(spark, sf))


@query("seeded_sample")
def _sample(spark, sf):
    return prs.seeded_sample(fx.claimed_pairs(spark, sf).distinct(), "claim", 300)


@query("capped_groups")
def _capped(spark, sf):
    rows = fx.claimed_pairs(spark, sf).select("claim", "key2").distinct()
    return prs.cap_per_group(rows, ["key2"], "claim", 5)


@query("unknown_probes")
def _probes(spark, sf):
    templates, _ = fx.gallery_roles(spark, sf)
    return prs.unknown_probes(fx.keyed_members(spark, sf), templates.where(F.col("identity") < "id_4"), 5)


# Quality


@query("quality_scores")
def _quality_scores(spark, sf):
    kept = ["face_width", "face_height", "face_area", "face_area_ratio", "alignment_quality", "pose_quality", "overall_quality"]
    scored = qua.quality_scores(fx.detections(spark, sf)).select("image_id", "det_idx", *kept)
    return rounded(scored, "face_area_ratio", "alignment_quality", "pose_quality", "overall_quality", places=5)


@query("quality_gate")
def _quality_gate(spark, sf):
    gated = qua.quality_gate(fx.detections(spark, sf), "strict")
    return gated.select("image_id", "det_idx", "quality_status", F.array_join("rejection_reasons", ",").alias("reasons"))


@query("primary_by_confidence")
def _primary_confidence(spark, sf):
    return qua.primary_detections(fx.detections(spark, sf)).select("image_id", "det_idx", "n_detections")


@query("primary_by_area")
def _primary_area(spark, sf):
    return qua.primary_detections(fx.detections(spark, sf), by="area").select("image_id", "det_idx", "n_detections")


@query("quality_distributions")
def _quality_distributions(spark, sf):
    return qua.metric_distributions(fx.image_quality(spark, sf))


@query("quality_pair_minima")
def _pair_minima(spark, sf):
    pairs = qua.pair_quality(fx.quality_pairs(spark, sf), fx.image_quality(spark, sf))
    return pairs.groupBy("is_same").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in qua.PAIR_MINIMA]
    )


@query("quality_correlation")
def _correlation(spark, sf):
    pairs = qua.pair_quality(fx.quality_pairs(spark, sf), fx.image_quality(spark, sf))
    return qua.quality_correlations(pairs)


@query("quality_trend")
def _trend(spark, sf):
    pairs = qua.pair_quality(fx.quality_pairs(spark, sf), fx.image_quality(spark, sf))
    return rounded(qua.quality_trend(pairs, "min_overall_quality"), "slope", "intercept", places=5)


@query("quality_mode_comparison")
def _mode_comparison(spark, sf):
    return qua.mode_comparison(fx.quality_pairs(spark, sf), fx.image_quality(spark, sf))


@query("detection_audit")
def _detection_audit(spark, sf):
    return qua.detection_audit(fx.images(spark, sf), fx.detections(spark, sf))


def _recognised(spark, sf):
    return qua.recognise(
        fx.images(spark, sf),
        fx.embedded_detections(spark, sf),
        fx.gallery_roles(spark, sf)[0],
        mode="lenient",
        multi_face_policy="reject",
    )


@query("recognition_outcomes")
def _recognition(spark, sf):
    return rounded(_recognised(spark, sf), "similarity", "overall_quality", places=5)


@query("recognition_tally")
def _recognition_tally(spark, sf):
    return qua.outcome_tally(_recognised(spark, sf))


def _requests(spark, sf):
    customer = F.col("o_custkey")
    name = F.when(customer % 29 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" C"), (customer % 50).cast("string")))
    requests = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        name.alias("identity"),
        F.col("o_orderkey").alias("image_id"),
        (customer % 37 != 0).alias("valid"),
    )
    found = fx.embedded_detections(spark, sf).withColumn("aligned", F.col("image_id") % 23 != 0)
    return enr.enrollment_outcomes(requests, found, "lenient")


@query("enrollment_outcomes")
def _enrollment(spark, sf):
    return rounded(_requests(spark, sf).drop("embedding"), "quality_score", places=5)


@query("enrollment_tally")
def _enrollment_tally(spark, sf):
    return enr.outcome_counts(_requests(spark, sf))


@query("enrolled_gallery")
def _enrolled_gallery(spark, sf):
    templates = fx.gallery_roles(spark, sf)[0]
    known = gal.template_counts(templates).select(
        "identity",
        "template_count",
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
        F.lit("seed").alias("notes"),
    )
    now = F.lit("2024-02-01").cast("timestamp")
    return enr.enroll(_requests(spark, sf), templates, known, 64, now)[1]


@query("extraction_tally")
def _extraction(spark, sf):
    return enr.extraction_tally(fx.images(spark, sf), fx.embedded_detections(spark, sf))


# Temporal smoothing and presence


@query("gap_segments")
def _gap_segments(spark, sf):
    rows = tem.gap_segments(fx.observations(spark, sf), fx.temporal_settings())
    return rows.select("stream_id", "frame_index", "gap_segment")


@query("window_consensus")
def _consensus(spark, sf):
    rows = tem.window_consensus(fx.observations(spark, sf), fx.temporal_settings())
    kept = ["stream_id", "frame_index", "leader", "leader_weight", "total_weight", "unknown_weight", "window_count"]
    return rounded(rows.select(*kept, "consensus_ratio"), "consensus_ratio")


@query("stable_identity")
def _stable(spark, sf):
    return rounded(fx.stabilised(spark, sf).drop("ts", "unknown_count"), "confidence_score")


@query("stabiliser_pass_through")
def _pass_through(spark, sf):
    return tem.pass_through(fx.observations(spark, sf)).drop("ts", "unknown_count")


@query("stabiliser_state")
def _state(spark, sf):
    return tem.current_state(fx.stabilised(spark, sf))


@query("first_stable_frames")
def _first_stable(spark, sf):
    return rep.first_stable_frames(fx.stabilised(spark, sf))


@query("presence_events")
def _presence_events(spark, sf):
    kept = ["stream_id", "frame_index", "identity", "event_type", "previous_state", "new_state", "session_id"]
    return fx.events_of(spark, sf).select(*kept, "observation_count", "interruption_count")


@query("presence_sessions")
def _sessions(spark, sf):
    closed = pre.closed_sessions(fx.events_of(spark, sf)).drop("last_seen_at", "reason")
    closed = rounded(closed, "duration_seconds", places=3)
    return closed.withColumns({c: F.unix_micros(c) for c in ("started_at", "ended_at")})


@query("active_sessions")
def _active(spark, sf):
    still = pre.open_sessions(fx.events_of(spark, sf)).drop("ended_at", "last_seen_at")
    still = rounded(still, "duration_seconds", places=3)
    return still.withColumns({c: F.unix_micros(c) for c in ("started_at", "state_since")})


@query("stopped_sessions")
def _stopped(spark, sf):
    events = fx.events_of(spark, sf)
    at = events.agg(F.max("ts")).scalar()
    return pre.stop_sessions(pre.open_sessions(events), at).select("session_id", "identity", "state", "reason")


@query("grace_sweep")
def _sweep_grace(spark, sf):
    events = fx.events_of(spark, sf)
    at = events.agg(F.timestamp_add("DAY", F.lit(2), F.max("ts"))).scalar()
    swept = pre.grace_sweep(pre.open_sessions(events), at, fx.presence_settings())
    return swept.select("session_id", "identity", "state")


@query("session_counts")
def _session_counts(spark, sf):
    events = fx.events_of(spark, sf)
    return pre.session_counts(pre.closed_sessions(events), pre.open_sessions(events))


@query("identity_states")
def _identity_states(spark, sf):
    asked = fx.table(spark, sf, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("identity"))
    return pre.identity_states(asked, fx.events_of(spark, sf))


@query("entry_counts")
def _entry_counts(spark, sf):
    window = fx.presence_settings()["entry_window_seconds"]
    stable = fx.stabilised(spark, sf).where("is_stable").withColumnRenamed("stable_identity", "identity")
    return pre.entry_counts(stable, window).select("stream_id", "frame_index", "identity", "entries_in_window")


@query("latest_events")
def _latest(spark, sf):
    return rep.latest_per_stream(fx.observations(spark, sf), 100).select("stream_id", "frame_index", "best_candidate")


@query("policy_temporal_eval")
def _temporal_eval(spark, sf):
    seen = materialize(fx.observations(spark, sf))
    wrong = F.col("recognized") & (F.col("identity") != F.col("true_identity"))
    labels = seen.select("stream_id", "frame_index", "true_identity", "recognized", wrong.alias("challenged"))
    smoothed = tem.stabilise_by_policy(seen, {mode: fx.temporal_settings(mode) for mode in TEMPORAL})
    runs = tem.pass_through(seen).withColumn("mode", F.lit("none")).unionByName(smoothed)
    kept = runs.select("mode", "stream_id", "frame_index", "stable_identity", "is_stable")
    return rep.temporal_policy_report(kept.join(labels, ["stream_id", "frame_index"]))


@query("policy_presence_eval")
def _presence_eval(spark, sf):
    seen = materialize(fx.observations(spark, sf))
    frames = materialize(tem.stabilise(seen, fx.temporal_settings()))
    stable = frames.where("is_stable").groupBy("stream_id", F.col("stable_identity").alias("identity"))
    firsts = stable.agg(F.min("ts").alias("first_ts")).select("*", F.explode(F.array(*[F.lit(m) for m in PRESENCE])).alias("mode"))
    events = pre.presence_events_by_policy(frames, {mode: fx.presence_settings(mode) for mode in PRESENCE})
    truth = seen.select("stream_id", "frame_index", "true_identity")
    marked = events.join(truth, ["stream_id", "frame_index"]).withColumn("false_entry", F.col("identity") != F.col("true_identity"))
    return rep.presence_policy_report(marked, firsts)


# Attendance


def _times(df: DataFrame, *cols: str) -> DataFrame:
    """Times as microseconds: both engines then compare plain numbers."""
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def _records(df: DataFrame) -> DataFrame:
    plain = _times(df, "first_check_in", "last_check_out", "created_at", "updated_at")
    plain = plain.withColumn("date", F.col("date").cast("string"))
    return rounded(plain, "total_dwell_seconds", places=3)


@query("attendance_span")
def _attendance_span(spark, sf):
    return _records(att.attendance_from_events(fx.presence_log(spark, sf), 1800.0))


@query("attendance_sum")
def _attendance_sum(spark, sf):
    return _records(att.attendance_from_sessions(fx.session_log(spark, sf), 6000.0))


@query("attendance_from_presence")
def _attendance_presence(spark, sf):
    return _records(att.attendance_from_events(fx.events_of(spark, sf), 1800.0))


@query("attendance_daily_summary")
def _daily(spark, sf):
    summary = att.daily_summary(att.attendance_from_events(fx.presence_log(spark, sf), 1800.0))
    summary = summary.withColumn("date", F.col("date").cast("string"))
    return rounded(summary, "total_dwell_seconds", "average_dwell_seconds", places=3)


@query("attendance_filter")
def _filter(spark, sf):
    return _records(att.list_records(att.attendance_from_sessions(fx.session_log(spark, sf)), "2024-01-05"))


@query("attendance_upsert")
def _upsert(spark, sf):
    old = att.attendance_from_events(fx.presence_log(spark, sf).where("ts < '2024-01-10'"))
    new = att.attendance_from_events(fx.presence_log(spark, sf).where("ts >= '2024-01-09'"))
    new = new.withColumn("record_id", F.concat(F.lit("new-"), "record_id"))
    merged = att.upsert_records(old, new)
    return _records(merged).select("identity", "date", "first_check_in", "session_count", "created_at", F.startswith("record_id", F.lit("new-")).alias("is_new"))


@query("session_audit")
def _audit(spark, sf):
    audits = att.audit_from_sessions(fx.session_log(spark, sf))
    audits = _times(audits, "started_at", "ended_at").withColumn("date", F.col("date").cast("string"))
    return rounded(audits, "duration_seconds", places=3)


@query("session_audit_span")
def _audit_span(spark, sf):
    audits = att.audit_from_events(fx.presence_log(spark, sf))
    audits = _times(audits, "started_at", "ended_at").withColumn("date", F.col("date").cast("string"))
    return rounded(audits, "duration_seconds", places=3)


@query("session_audit_replace")
def _audit_replace(spark, sf):
    audits = att.audit_from_sessions(fx.session_log(spark, sf))
    again = audits.where("observation_count > 5").withColumn("closure_reason", F.lit("corrected"))
    return att.replace_audits(audits, again).groupBy("closure_reason").agg(F.count(F.lit(1)).alias("n"))


@query("first_session_events")
def _first_events(spark, sf):
    return att.first_per_session(fx.presence_log(spark, sf)).select("session_id", "event_type", "identity", "frame_index")


@query("attendance_csv")
def _csv(spark, sf):
    exported = att.csv_export(att.attendance_from_sessions(fx.session_log(spark, sf)))
    return exported.select("record_id", "identity", "date", "total_dwell_seconds", "session_count", "status")


@query("attendance_journal")
def _journal(spark, sf):
    rows = att.journal(att.attendance_from_events(fx.presence_log(spark, sf), 1800.0))
    return rows.withColumn("date", F.col("date").cast("string"))


@query("identity_history")
def _history(spark, sf):
    people = fx.session_log(spark, sf).select("identity").distinct().withColumn("notes", F.lit("seed"))
    records = att.attendance_from_events(fx.presence_log(spark, sf)).select("identity", "date", "session_count")
    return att.identity_history(people, records).withColumn("date", F.col("date").cast("string"))


@query("identity_reconcile")
def _reconcile(spark, sf):
    early, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    known = fx.keyed_members(spark, sf).where("identity < 'id_8'").groupBy("identity").agg(
        (F.count(F.lit(1)) - F.when(F.col("identity") < "id_5", 1).otherwise(0)).alias("template_count"),
        early.alias("created_at"),
        early.alias("updated_at"),
        F.lit("seed").alias("notes"),
    )
    counts = gal.template_counts(fx.keyed_members(spark, sf))
    return _times(att.reconcile_identities(known, counts, now), "created_at", "updated_at")


# Dataset checks and configuration


@query("leakage_audit")
def _leakage(spark, sf):
    return dat.leakage_report(fx.document_splits(spark, sf))


@query("leaked_hashes")
def _leaked(spark, sf):
    return dat.leaked_hashes(fx.document_splits(spark, sf))


@query("split_counts")
def _split_counts(spark, sf):
    return dat.split_counts(fx.document_splits(spark, sf))


@query("sample_errors")
def _sample_errors(spark, sf):
    return dat.sample_errors(dat.split_counts(fx.document_splits(spark, sf)))


@query("dataset_summary")
def _dataset_summary(spark, sf):
    return dat.dataset_summary(fx.document_splits(spark, sf))


@query("resolutions")
def _resolutions(spark, sf):
    return dat.resolutions(fx.document_splits(spark, sf))


@query("policy_resolution")
def _policies(spark, sf):
    mode = F.when(F.col("s_nationkey") % 4 == 0, "FAST").when(F.col("s_nationkey") % 4 == 1, "stable").when(
        F.col("s_nationkey") % 4 == 2, "odd"
    )
    configs = fx.table(spark, sf, "supplier").select(
        "s_suppkey",
        mode.alias("mode"),
        F.when(F.col("s_suppkey") % 5 == 0, (F.col("s_suppkey") % 7).cast("int")).alias("window_size"),
    )
    return resolve(configs, TEMPORAL)


@query("latency_profile")
def _latency(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("recognition_ms"),
        (F.col("l_discount") * 10).alias("temporal_ms"),
        (F.col("l_quantity") + F.col("l_discount") * 10).alias("total_ms"),
    )
    return rounded(rep.latency_profile(rows, ["recognition_ms", "temporal_ms"], "total_ms"), "mean_ms", "min_ms", "max_ms", "fps", places=5)


@query("timestamp_cleanup")
def _cleanup(spark, sf):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(key % 5 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(key % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 5 == 3, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.unix_micros(sca.parse_timestamp(text)).alias("ts_us"),
        sca.parse_date(text).cast("string").alias("date"),
        sca.image_path(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), key % 9999).alias("path"),
    )


# Public projections


@query("public_observations")
def _public_observations(spark, sf):
    return pub.public_observations(fx.observations(spark, sf))


@query("public_sessions")
def _public_sessions(spark, sf):
    events = fx.events_of(spark, sf)
    shared = pre.closed_sessions(events).drop("reason")
    everyone = shared.unionByName(pre.open_sessions(events).drop("state_since"))
    kept = ["session_id", "identity", "state", "is_active", "duration_seconds", "observation_count", "interruption_count"]
    return pub.public_sessions(everyone).select(*kept)


@query("public_frames")
def _public_frames(spark, sf):
    seen, smoothed = fx.observations(spark, sf), materialize(fx.stabilised(spark, sf))
    events = pre.presence_events(smoothed, fx.presence_settings())
    frames = pub.public_frames(seen, smoothed, events)
    return frames.select(
        "stream_id",
        "frame_index",
        "recognition.best_candidate",
        "temporal.state",
        F.size("presence_events").alias("n_events"),
        F.array_join("presence_events.event_type", ",").alias("event_types"),
    )


# The live job, run once over the whole table


#: Seconds by which rows reach the live job late at most, and the files (one a trigger) they come in.
LIVE_LATENESS = 172_800.0
LIVE_FILES = 3
_LIVE: dict[tuple, str] = {}


def _live(spark: SparkSession, sf: str, grace_timeout: bool = False) -> str:
    """The folder of a live job over all observations, run once per application.

    Each row arrives up to the lateness after its time, so files overlap and rows are out of order; a
    clock row ends the run. Without timeouts the last micro-batch is then done twice.
    """
    key = (spark.sparkContext.applicationId, sf, grace_timeout)
    if key in _LIVE:
        return _LIVE[key]
    root = f"{ensure_checkpoint_dir(spark)}/live-{uuid4().hex}"
    seen = fx.observations(spark, sf).withColumn("quality_score", F.lit(None).cast("double"))
    delay = F.pmod(F.xxhash64("event_id"), F.lit(int(LIVE_LATENESS * 1e6)))
    arriving = materialize(seen.withColumn("_at", F.unix_micros("ts") + delay).select(*column_names(OBSERVATIONS), "_at"))
    first, last = arriving.agg(F.min("_at"), F.max("_at")).first()
    part = F.floor((F.col("_at") - F.lit(first)) * LIVE_FILES / F.lit(last - first + 1))
    for k in range(LIVE_FILES):
        arriving.where(part == k).drop("_at").coalesce(1).write.mode("append").parquet(f"{root}/in")
    tick(spark, f"{root}/in", F.timestamp_micros(F.lit(last) + 30 * 86_400_000_000))

    def run() -> None:
        source = observation_stream(spark, f"{root}/in", files_per_trigger=1)
        settings = (fx.temporal_settings(), fx.presence_settings())
        job = run_attendance_stream(
            source, *settings, f"{root}/out", f"{root}/state", 1800.0, lateness=LIVE_LATENESS, grace_timeout=grace_timeout
        )
        job.awaitTermination()

    run()
    if not grace_timeout:
        forget_last_batch(spark, f"{root}/state")
        run()
    _LIVE[key] = root
    return root


@query("live_presence_events")
def _live_events(spark, sf):
    kept = ["stream_id", "frame_index", "identity", "event_type", "previous_state", "new_state", "session_id"]
    events = spark.read.parquet(f"{_live(spark, sf)}/out/events")
    return events.select(*kept, "observation_count", "interruption_count")


@query("live_attendance")
def _live_attendance(spark, sf):
    return _records(spark.read.parquet(f"{_live(spark, sf)}/out/attendance"))


@query("live_sessions")
def _live_sessions(spark, sf):
    sessions = rounded(read_sessions(spark, f"{_live(spark, sf)}/out").drop("last_seen_at"), "duration_seconds", places=3)
    return _times(sessions, "started_at", "ended_at", "as_of")


@query("live_audits")
def _live_audits(spark, sf):
    audits = rounded(read_audits(spark, f"{_live(spark, sf)}/out"), "duration_seconds", places=3)
    return _times(audits.withColumn("date", F.col("date").cast("string")), "started_at", "ended_at")


@query("live_stopped_sessions")
def _live_stopped(spark, sf):
    """What stopping the job logs, twice, at the time of the last event and later."""
    root, out = _live(spark, sf), f"{ensure_checkpoint_dir(spark)}/live-{uuid4().hex}"
    at = spark.read.parquet(f"{root}/out/events").agg(F.max("ts")).scalar()
    for moment in (at, at + F.expr("INTERVAL 1 HOUR")):
        stop_attendance_stream(spark, f"{root}/state", out, moment)
    stopped = read_sessions(spark, out)
    return _times(stopped.select("session_id", "stream_id", "identity", "state", "ended_at", "reason"), "ended_at")


@query("live_grace_timeout")
def _live_timeout(spark, sf):
    """Closed sessions of a job in which a grace ends on time, whether or not a frame comes."""
    events = spark.read.parquet(f"{_live(spark, sf, True)}/out/events")
    return _times(pre.closed_sessions(events).select("session_id", "stream_id", "identity", "started_at", "ended_at", "reason"), "started_at", "ended_at")


# Single lookups and legacy matching


@query("nearest_sweep_row")
def _nearest_sweep(spark, sf):
    sweep = cal.threshold_sweep(fx.scored_pairs(spark, sf), group_cols=["experiment_id"])
    return cal.nearest_row(sweep, F.lit(0.2405), ["experiment_id"])


@query("legacy_detection_matches")
def _legacy_matches(spark, sf):
    found = fx.embedded_detections(spark, sf).groupBy("image_id").agg(
        F.collect_list(F.struct("det_idx", "embedding")).alias("detections")
    )
    return rounded(gal.match_detections(found, fx.gallery_roles(spark, sf)[0], 1.2), "score", places=5)


@query("file_flags")
def _file_flags(spark, sf):
    """Claims that name image files, flagged by whether the listing (one file per vector) has them."""
    def path(key: str):
        return sca.image_path(F.lit("V"), F.col(key))

    pairs = fx.claimed_pairs(spark, sf).select(
        "claim", path("key1").alias("image1_rel_path"), path("key2").alias("image2_rel_path")
    )
    listing = fx.keyed_members(spark, sf).select(path("key").alias("relative_path"))
    return dat.flag_existing(pairs, listing)
