"""Quality, attendance, pairs, dataset checks, sources and sinks on small fixtures."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rollmark.functions import quality as q
from rollmark.functions import scalars as sca
from rollmark.operators import attendance as att
from rollmark.operators import dataset as dat
from rollmark.operators import enrollment as enr
from rollmark.operators import ordering as order
from rollmark.operators import pairs as prs
from rollmark.operators import quality as qua
from rollmark.operators import reports as rep
from rollmark.policies import TEMPORAL, resolve
from rollmark.sources import readers, writers

DET = (
    "image_id BIGINT, det_idx INT, image_w INT, image_h INT, bbox STRUCT<top: INT, right: INT, bottom: INT, left: INT>, "
    "confidence DOUBLE, landmarks ARRAY<ARRAY<FLOAT>>, blur_score DOUBLE, brightness_score DOUBLE, contrast_score DOUBLE"
)
FRONTAL = [[45.0, 55.0], [75.0, 55.0], [60.0, 75.0], [48.0, 95.0], [72.0, 95.0]]
TILTED = [[45.0, 40.0], [75.0, 70.0], [60.0, 75.0], [48.0, 95.0], [72.0, 95.0]]
GOOD = (200, 200, (20, 120, 140, 20), 0.95)


def detection(image, idx=0, points=FRONTAL, blur=200.0, bright=128.0, contrast=50.0, conf=0.95, box=(20, 120, 140, 20)):
    return (image, idx, 200, 200, box, conf, points, blur, bright, contrast)


def at(hour, minute=0, day=17):
    return datetime(2026, 8, day, hour, minute, tzinfo=timezone.utc)


def test_box_and_landmark_scores(spark):
    rows = spark.createDataFrame([detection(1), detection(2, points=TILTED), detection(3, points=None)], DET)
    got = {r.image_id: r for r in qua.quality_scores(rows).collect()}
    assert (got[1].face_width, got[1].face_height, got[1].face_area, got[1].face_area_ratio) == (100, 120, 12000, 0.3)
    assert got[1].alignment_quality > 0.85 and got[1].pose_quality > 0.85
    assert got[2].alignment_quality < got[1].alignment_quality
    assert (got[3].alignment_quality, got[3].pose_quality) == (0.0, 0.0)


def test_gate_reasons_in_order(spark):
    bad = detection(2, points=None, blur=5.0, bright=10.0, contrast=3.0, conf=0.2, box=(0, 10, 10, 0))
    rows = spark.createDataFrame([detection(1), bad, detection(3, bright=250.0)], DET)
    got = {r.image_id: r for r in qua.quality_gate(rows).collect()}
    assert got[1].quality_status == "good" and got[1].rejection_reasons == []
    assert got[2].rejection_reasons == [
        "low_resolution", "face_too_small", "blurry", "underexposed", "low_contrast", "low_detection_confidence",
        "poor_alignment", "extreme_pose",
    ]
    assert got[3].rejection_reasons == ["overexposed"]
    off = {r.image_id: r.quality_status for r in qua.quality_gate(rows, enabled=False).collect()}
    assert set(off.values()) == {"good"}
    eased = qua.quality_gate(rows, max_brightness=255.0).where("image_id = 3").first()
    assert eased.quality_status == "good"


def test_box_helpers(spark):
    row = spark.range(1).select(
        q.clamp_box(F.struct(F.lit(-5).alias("top"), F.lit(300).alias("right"), F.lit(90).alias("bottom"), F.lit(10).alias("left")), F.lit(200), F.lit(100)).alias("c"),
        q.box_from_xywh(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("b"),
        q.ordered_landmarks(F.array(*[F.array(F.lit(x), F.lit(0.0)) for x in (9.0, 1.0, 5.0, 8.0, 2.0)])).alias("l"),
    ).first()
    assert tuple(row.c) == (0, 200, 90, 10) and tuple(row.b) == (2, 4, 6, 1)
    assert [p[0] for p in row.l] == [1.0, 9.0, 5.0, 2.0, 8.0]


def test_primary_rules(spark):
    rows = spark.createDataFrame([detection(1, 0, conf=0.7), detection(1, 1, conf=0.9, box=(0, 50, 50, 0)), detection(1, 2, conf=0.9)], DET)
    pick = lambda by: qua.primary_detections(rows, by).first()
    assert (pick("confidence").det_idx, pick("area").det_idx, pick("first").det_idx, pick("area").n_detections) == (1, 0, 0, 3)


def test_recognition_reasons(spark):
    found = spark.createDataFrame(
        [detection(1), detection(2, blur=1.0), detection(3, points=None), detection(4), detection(5), detection(5, 1)], DET
    )
    vector = F.when(F.col("image_id") == 4, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    found = found.withColumn("embedding", vector.cast("array<float>"))
    images = spark.createDataFrame([(i, i != 7) for i in range(1, 8)], "image_id BIGINT, valid BOOLEAN")
    templates = spark.createDataFrame([(1, "Alice", [1.0, 0.0])], "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>")
    got = {r.image_id: r for r in qua.recognise(images, found, templates, gate_enabled=True, multi_face_policy="reject").collect()}
    assert got[1].reason == "accepted" and got[1].identity == "Alice"
    assert got[2].reason == "quality_rejected: blurry"
    assert got[3].reason.startswith("quality_rejected: poor_alignment")
    assert got[4].reason == "below_threshold" and got[4].best_candidate == "Alice"
    assert got[5].reason == "multiple_faces_rejected"
    assert got[6].reason == "no_face_detected" and got[7].reason == "invalid_image"
    free = {r.image_id: r.reason for r in qua.recognise(images, found, templates, gate_enabled=False).collect()}
    assert free[3] == "missing_landmarks" and free[5] == "accepted"


def test_vectors_of_failed_detections_are_not_shuffled(spark, tmp_path):
    """What an image's primary detection is chosen from holds a verdict, not what it was judged by."""
    rows = [detection(1, 0, conf=0.7), detection(1, 1, conf=0.9, blur=1.0), detection(2, 0, conf=0.7, blur=1.0), detection(2, 1, conf=0.9), detection(3, points=None)]
    found = spark.createDataFrame(rows, DET).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    found.write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    images = spark.createDataFrame([(i, True) for i in (1, 2, 3)], "image_id BIGINT, valid BOOLEAN")
    templates = spark.createDataFrame([(1, "Alice", [1.0, 0.0])], "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>")
    outcomes = qua.recognise(images, found, templates)
    got = {r.image_id: (r.reason, r.identity) for r in outcomes.collect()}
    assert got == {1: ("quality_rejected: blurry", None), 2: ("accepted", "Alice"), 3: ("quality_rejected: poor_alignment, extreme_pose", None)}
    plan = outcomes._jdf.queryExecution().optimizedPlan().toString()
    chosen = next(line for line in plan.splitlines() if "min_by" in line)
    assert "embedding" in chosen and "landmarks" not in chosen and "bbox" not in chosen
    shuffled = plan[plan.index(chosen) + len(chosen):]
    assert "THEN embedding" in shuffled  # before the aggregate, not after it


def log(spark, rows):
    schema = "event_type STRING, identity STRING, ts TIMESTAMP, session_id STRING"
    df = spark.createDataFrame(rows, schema)
    return df.select("*", F.lit("s").alias("stream_id"), F.unix_seconds("ts").alias("frame_index"), F.lit(0).alias("event_seq"), F.lit("because").alias("reason"))


def test_first_entry_and_reentry(spark):
    one = att.attendance_from_events(log(spark, [("ENTRY_CONFIRMED", "Alice", at(9), "s1")])).first()
    assert (one.session_count, one.status, one.last_check_out) == (1, "PRESENT", None)
    two = att.attendance_from_events(log(spark, [("ENTRY_CONFIRMED", "Alice", at(9), "s1"), ("ENTRY_CONFIRMED", "Alice", at(14), "s2")])).collect()
    assert len(two) == 1 and two[0].session_count == 2 and two[0].first_check_in.hour == 9


def test_span_dwell_and_duplicate_close(spark):
    rows = [("ENTRY_CONFIRMED", "Alice", at(9), "s1"), ("SESSION_ENDED", "Alice", at(9, 30), "s1"), ("SESSION_ENDED", "Alice", at(11), "s1")]
    record = att.attendance_from_events(log(spark, rows), 1800.0).first()
    assert (record.total_dwell_seconds, record.status, record.last_check_out.hour) == (1800.0, "PRESENT", 9)
    audits = att.audit_from_events(log(spark, rows)).collect()
    assert len(audits) == 1 and audits[0].duration_seconds == 1800.0


def test_close_across_midnight_resume_and_unknown(spark):
    rows = [
        ("ENTRY_CONFIRMED", "Alice", at(23, 50), "s1"),
        ("SESSION_ENDED", "Alice", at(0, 10, 18), "s1"),
        ("ENTRY_CONFIRMED", "Unknown", at(9), "s3"),
        ("ENTRY_CONFIRMED", "", at(9), "s4"),
        ("ENTRY_CONFIRMED", "Bob", at(9), "s5"),
        ("SESSION_ENDED", "Bob", at(9, 5), "s5"),
        ("PRESENCE_RESUMED", "Bob", at(9, 6), "s5"),
    ]
    got = {(r.identity, r.date.day): r for r in att.attendance_from_events(log(spark, rows), 600.0).collect()}
    assert set(got) == {("Alice", 17), ("Alice", 18), ("Bob", 17)}
    assert got["Alice", 17].status == "IN_PROGRESS"
    assert (got["Alice", 18].total_dwell_seconds, got["Alice", 18].status, got["Alice", 18].session_count) == (0.0, "PARTIAL", 1)
    assert got["Bob", 17].status == "IN_PROGRESS"


SESSION = (
    "session_id STRING, identity STRING, started_at TIMESTAMP, last_seen_at TIMESTAMP, ended_at TIMESTAMP, "
    "duration_seconds DOUBLE, observation_count INT, interruption_count INT"
)


def sessions(spark):
    return spark.createDataFrame(
        [("a", "Alice", at(9), at(9, 15), at(9, 15), 900.0, 5, 0), ("b", "Alice", at(13), at(13, 30), None, 1800.0, 9, 1), ("c", "Bob", at(8), at(8, 10), at(8, 10), 600.0, 2, 0)],
        SESSION,
    )


def test_summed_dwell_and_summary(spark):
    records = att.attendance_from_sessions(sessions(spark), 1800.0)
    got = {r.identity: r for r in records.collect()}
    assert (got["Alice"].total_dwell_seconds, got["Alice"].session_count, got["Alice"].status) == (2700.0, 2, "PRESENT")
    assert got["Alice"].last_check_out.hour == 13 and got["Bob"].status == "PARTIAL"
    row = att.daily_summary(records).first()
    assert (row.total_records, row.total_present, row.total_partial, row.total_dwell_seconds) == (2, 1, 1, 3300.0)
    assert att.list_records(records, identity="Bob").count() == 1 and att.find_record(records, "Bob", "2026-08-17").count() == 1
    assert [r.session_id for r in att.list_audits(att.audit_from_sessions(sessions(spark)), "2026-08-17").collect()] == ["c", "a", "b"]


def test_upserts_keep_the_first_id(spark):
    old = att.attendance_from_sessions(sessions(spark)).withColumn("record_id", F.concat(F.lit("old-"), "identity"))
    new = att.attendance_from_sessions(sessions(spark).where("identity = 'Alice'")).withColumn("session_count", F.lit(7).cast("bigint"))
    got = {r.identity: r for r in att.upsert_records(old, new).collect()}
    assert got["Alice"].record_id == "old-Alice" and got["Alice"].session_count == 7 and got["Bob"].session_count == 1
    audits = att.audit_from_sessions(sessions(spark))
    assert att.replace_audits(audits, audits.where("session_id = 'a'").withColumn("closure_reason", F.lit("x"))).count() == 3
    assert att.cleared(audits).count() == 0 and att.cleared(audits).schema == audits.schema


def test_exports(spark, tmp_path):
    records = att.attendance_from_sessions(sessions(spark)).withColumn(
        "last_check_out", F.when(F.col("identity") == "Alice", F.col("last_check_out"))
    )
    writers.export_attendance_csv(records, str(tmp_path / "csv"))
    rows = {r.identity: r for r in spark.read.option("header", True).option("emptyValue", "").csv(str(tmp_path / "csv")).collect()}
    assert len(rows["Bob"]) == 9 and rows["Bob"].total_dwell_seconds == "600.00" and not rows["Bob"].last_check_out
    writers.export_attendance_json(records, str(tmp_path / "json"))
    objects = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {len(o) for o in objects} == {11} and any(o["last_check_out"] is None for o in objects)
    writers.write_attendance(records, str(tmp_path / "table"))
    writers.write_attendance(records.where("identity = 'Bob'"), str(tmp_path / "table"))
    assert readers.read_attendance(spark, str(tmp_path / "table"), ["2026-08-17"]).count() == 1


def test_pair_list(spark, tmp_path):
    lines = ["2\t2", "Ann\t1\t4", "Bea\t2\t3", "Ann\t1\tBea\t2", "Cy\t3\tDee\t11", "Eve\t5\t6", "Fay\t7\t8", "Ann\t2\tFay\t1", "Bea\t1\tCy\t2"]
    (tmp_path / "pairs.txt").write_text("\n".join(lines) + "\n")
    rows = readers.read_pair_list(spark, str(tmp_path / "pairs.txt")).orderBy("pair_id").collect()
    assert [(r.fold, r.is_same) for r in rows] == [(1, 1), (1, 1), (1, 0), (1, 0), (2, 1), (2, 1), (2, 0), (2, 0)]
    assert rows[3].image2_rel_path == "Dee/Dee_0011.jpg" and rows[0].image2_rel_path == "Ann/Ann_0004.jpg"


def test_labelled_folder_and_missing_files(spark, tmp_path):
    for name in ("Ann/Ann_0001.jpg", "Ann/Ann_0004.jpg", "Bea/Bea_0002.PNG", "Bea/notes.txt"):
        os.makedirs(tmp_path / "img" / name.split("/")[0], exist_ok=True)
        (tmp_path / "img" / name).write_bytes(name.encode())
    listing = readers.list_labelled_files(spark, str(tmp_path / "img"))
    assert sorted(r.relative_path for r in listing.collect()) == ["Ann/Ann_0001.jpg", "Ann/Ann_0004.jpg", "Bea/Bea_0002.PNG"]
    pairs = spark.createDataFrame([("Ann/Ann_0001.jpg", "Ann/Ann_0009.jpg")], "image1_rel_path STRING, image2_rel_path STRING")
    row = dat.flag_existing(pairs, listing).first()
    assert (row.image1_exists, row.image2_exists) == (True, False)
    wanted = spark.createDataFrame([("Ann/Ann_0001.jpg",), ("Zed/Zed_0001.jpg",)], "relative_path STRING")
    assert [r.relative_path for r in dat.missing_files(wanted, listing).collect()] == ["Zed/Zed_0001.jpg"]
    hashes = {r.file_hash for r in readers.hash_files(spark, str(tmp_path / "img")).collect()}
    assert len(hashes) == 3


def test_csv_metadata_and_caches(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("identity,total_images,enrollment_count,validation_count,test_count\nAnn,22,2,10,10\nBob,5,1,0,4\n")
    counts = readers.read_identity_counts(spark, str(tmp_path / "ids.csv"))
    errors = sorted((r.identity, r.error) for r in dat.sample_errors(counts).collect())
    assert errors == [("Bob", "fewer than 20 images"), ("Bob", "no validation images")]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "key STRING, embedding ARRAY<FLOAT>")
    writers.write_embedding_cache(vectors, str(tmp_path / "cache"))
    cache = readers.read_embedding_cache(spark, str(tmp_path / "cache"))
    assert cache.where("embedding is null").count() == 1
    wanted = spark.createDataFrame([("a",), ("c",), ("c",)], "key STRING")
    assert [r.key for r in prs.missing_keys(wanted, cache).collect()] == ["c"]


def test_gallery_round_trip(spark, tmp_path):
    good = spark.createDataFrame([(1, "A", [1.0, 0.0])], "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>")
    writers.save_gallery(good, str(tmp_path / "g"), 2)
    assert readers.load_gallery(spark, str(tmp_path / "g"), 2).count() == 1
    with pytest.raises(ValueError):
        readers.load_gallery(spark, str(tmp_path / "g"), 3)
    with pytest.raises(ValueError):
        writers.save_gallery(good.withColumn("embedding", F.array(F.lit(3.0), F.lit(0.0)).cast("array<float>")), str(tmp_path / "h"), 2)


def members(spark, sizes):
    rows = [(name, i + 1000 * at_) for at_, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "identity STRING, key BIGINT")


@pytest.mark.parametrize("cell", [1_000_000, 9])
def test_genuine_pairs_are_distinct_and_capped(spark, cell):
    rows = prs.genuine_pairs(members(spark, {"big": 60, "two": 2, "one": 1, "six": 6}), 20, rows_per_cell=cell).collect()
    count = {n: sum(r.identity1 == n for r in rows) for n in ("big", "two", "one", "six")}
    assert count == {"big": 20, "two": 1, "one": 0, "six": 15}
    assert len({(r.key1, r.key2) for r in rows}) == len(rows) and all(r.key1 < r.key2 for r in rows)
    again = prs.genuine_pairs(members(spark, {"big": 60, "two": 2, "one": 1, "six": 6}), 20).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_impostors_banded_and_splits(spark):
    people = members(spark, {"a": 25, "b": 22, "c": 5})
    rows = prs.impostor_pairs(people, 300).collect()
    assert len(rows) == 300 and all(r.identity1 != r.identity2 for r in rows)
    banded = prs.banded_pairs(people, rows_per_cell=6).collect()
    assert len(banded) == sum(min(9, n - 1 - i) for n in (25, 22, 5) for i in range(n))
    splits = prs.assign_splits(people)
    got = {r.identity: r for r in dat.split_counts(splits).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].enrollment_count, got["a"].validation_count, got["a"].test_count) == (2, 11, 12)
    assert sorted(map(tuple, splits.collect())) == sorted(map(tuple, prs.assign_splits(people, rows_per_cell=4).collect()))
    with pytest.raises(ValueError):
        prs.in_split(splits, "nowhere")


@pytest.mark.parametrize("cell", [1_000_000, 11])
def test_positions_and_totals_in_hot_groups(spark, cell):
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    got = order.positions(rows, ["g"], "v", "pos", ["id"], cell)
    plain = rows.selectExpr("*", "row_number() over (partition by g order by v, id) as pos")
    assert got.exceptAll(plain).isEmpty() and got.count() == 500
    totals = order.running_totals(order.cut(rows, (), "v", cell), {"t": F.col("id")}, ["id"], descending=True).df.select("g", "v", "id", "t")
    expected = rows.selectExpr("*", "sum(id) over (order by v desc, id desc rows unbounded preceding) as t")
    assert totals.exceptAll(expected).isEmpty()
    near = order.neighbour(order.cut(rows, ["g"], "v", cell), {"p": "id"}, ["id"], following=False).df.select("g", "v", "id", "p")
    assert near.exceptAll(rows.selectExpr("*", "lag(id) over (partition by g order by v, id) as p")).isEmpty()


def test_leakage(spark):
    rows = [("A", "enrollment", "h1"), ("A", "validation", "h1"), ("B", "test", "h1"), ("B", "test", "h2"), ("B", "test", "h2")]
    report = dat.leakage_report(spark.createDataFrame(rows, "identity STRING, split STRING, file_hash STRING")).first()
    assert tuple(report) == (1, 1, 1, 3)


def test_scalars(spark):
    texts = ["2026-08-17T10:00:00Z", "2026-08-17T10:00:00+02:00", "2026-08-17T10:00:00", "never", "2026-08-17", "2026-8-1", "2026-02-30"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", sca.parse_timestamp(F.col("t")).alias("ts"), sca.parse_date(F.col("t")).alias("d")).collect()
    got = {r.t: r for r in rows}
    assert got[texts[0]].ts.hour == 10 and got[texts[1]].ts.hour == 8 and got[texts[2]].ts.hour == 10 and got["never"].ts is None
    assert got["2026-08-17"].d is not None and got["2026-8-1"].d is None and got["2026-02-30"].d is None
    row = spark.range(1).select(
        sca.clean_identity(F.lit("  ")).alias("a"), sca.clean_identity(F.lit(" Bo ")).alias("b"), sca.forward_slashes(F.lit("a\\b")).alias("c"),
        sca.journal_minutes(F.lit(90.0)).alias("d"), sca.journal_check_out(F.lit(None).cast("timestamp")).alias("e"),
    ).first()
    assert tuple(row) == (None, "Bo", "a/b", "1.5", "In Progress")


def test_policy_resolution(spark):
    rows = spark.createDataFrame([("FAST", 9), ("odd", None), (None, None)], "mode STRING, window_size INT")
    got = [(r.mode, r.window_size, r.min_observations) for r in resolve(rows, TEMPORAL).collect()]
    assert got == [("fast", 9, 3), ("balanced", 7, 4), ("balanced", 7, 4)]


def test_enrollment_codes(spark):
    found = spark.createDataFrame([detection(i) if i != 4 else detection(4, blur=1.0) for i in (1, 2, 4, 5, 6, 7)], DET)
    found = found.withColumn("aligned", F.col("image_id") != 6).withColumn(
        "embedding", F.when(F.col("image_id") != 7, F.array(F.lit(3.0), F.lit(0.0)).cast("array<float>"))
    )
    requests = spark.createDataFrame([(1, " ", 1, True), (2, "A", 2, False), (3, "B", 3, True), (4, "C", 4, True), (5, " D ", 5, True), (6, "E", 6, True), (7, "F", 7, True)], "request_id BIGINT, identity STRING, image_id BIGINT, valid BOOLEAN")
    outcomes = enr.enrollment_outcomes(requests, found)
    got = {r.request_id: r.error_code for r in outcomes.collect()}
    assert got == {1: "invalid_identity", 2: "invalid_image", 3: "no_face_detected", 4: "quality_rejected", 5: None, 6: "alignment_failed", 7: "embedding_failed"}
    templates = spark.createDataFrame([(1, "D", [1.0, 0.0])], "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>")
    known = spark.createDataFrame([("D", 1, at(1), at(1), "seed")], "identity STRING, template_count BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP, notes STRING")
    gallery, people = enr.enroll(outcomes, templates, known, 2, F.lit(at(12)))
    row = people.first()
    assert gallery.count() == 2 and row.template_count == 2 and row.created_at.hour == 1 and row.updated_at.hour == 12


def test_latency_and_latest(spark):
    rows = spark.createDataFrame([(10.0, 20.0), (30.0, 60.0)], "a DOUBLE, total DOUBLE")
    got = {r.stage: r for r in rep.latency_profile(rows, ["a"], "total").collect()}
    assert got["total"].fps == 25.0 and got["a"].fps is None and got["a"].max_ms == 30.0
    frames = spark.createDataFrame([("s", i) for i in range(9)], "stream_id STRING, frame_index BIGINT")
    assert sorted(r.frame_index for r in rep.latest_per_stream(frames, 3).collect()) == [6, 7, 8]
