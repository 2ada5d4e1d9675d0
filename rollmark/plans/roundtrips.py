"""Queries over readers, sinks and small helpers: given tables go out through a sink and come back.

Files are written below the shared checkpoint folder. Each query has its SQL twin beside it.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollmark import schemas
from rollmark.functions import quality as qual
from rollmark.functions import scalars as sca
from rollmark.operators import attendance as att
from rollmark.operators import calibration as cal
from rollmark.operators import metrics as met
from rollmark.operators import pairs as prs
from rollmark.operators import projections as pub
from rollmark.operators import quality as qua
from rollmark.operators import temporal as tem
from rollmark.plans import fixtures as fx
from rollmark.plans.catalog import query, rounded
from rollmark.plans.oracle import DETECTIONS, LOG, SQL, span_ctes
from rollmark.session import ensure_checkpoint_dir
from rollmark.sources import readers, writers
from rollmark.streaming.jobs import run_detection_log, run_fault_log


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/roundtrip-{uuid4().hex}"


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    doc = fx.document_splits(spark, sf)
    return doc.select(
        "image_id",
        "identity",
        "split",
        F.concat("identity", F.lit(".jpg")).alias("image_name"),
        sca.image_path(F.col("identity"), F.col("image_id")).alias("relative_path"),
        "file_hash",
        "width",
        "height",
    )


_SPLITS_SQL = """
sp AS (SELECT doc_id AS image_id, source || '_' || lang AS identity,
         CASE WHEN doc_id % 10 < 2 THEN 'enrollment' WHEN doc_id % 10 < 6 THEN 'validation' ELSE 'test' END AS split,
         sha256(text) AS file_hash, CAST(n_chars % 3 * 50 + 150 AS INTEGER) AS width, 250 AS height FROM documents),
spl AS (SELECT image_id, identity, split, identity || '.jpg' AS image_name,
          identity || '/' || identity || '_' || CASE WHEN image_id < 1000 THEN lpad(CAST(image_id AS VARCHAR), 4, '0') ELSE CAST(image_id AS VARCHAR) END || '.jpg' AS relative_path,
          file_hash, width, height FROM sp)"""


@query("csv_metadata")
def _csv_metadata(spark, sf):
    path = _folder(spark)
    _splits(spark, sf).write.option("header", True).csv(path)
    return readers.read_splits(spark, path)


SQL["csv_metadata"] = f"WITH {_SPLITS_SQL} SELECT * FROM spl"


@query("split_filter")
def _split_filter(spark, sf):
    return prs.in_split(_splits(spark, sf), "validation")


SQL["split_filter"] = f"WITH {_SPLITS_SQL} SELECT * FROM spl WHERE split = 'validation'"


@query("csv_pairs")
def _csv_pairs(spark, sf):
    """Scored pairs as verification pairs, through CSV."""
    path = _folder(spark)
    lines = fx.table(spark, sf, "lineitem")
    same = F.col("l_linenumber") % 4 == 0
    one = F.concat(F.lit("P"), (F.col("l_partkey") % 200).cast("string"))
    two = F.when(same, one).otherwise(F.concat(F.lit("S"), (F.col("l_suppkey") % 90).cast("string")))
    pairs = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair_id"),
        (F.col("l_orderkey") % 10 + 1).cast("int").alias("fold"),
        one.alias("identity1"),
        F.concat(one, F.lit("/a.jpg")).alias("image1_rel_path"),
        (F.col("l_partkey") % 3 > 0).alias("image1_exists"),
        two.alias("identity2"),
        F.concat(two, F.lit("/b, c.jpg")).alias("image2_rel_path"),
        F.lit(True).alias("image2_exists"),
        same.cast("int").alias("is_same"),
    )
    pairs.write.option("header", True).csv(path)
    return readers.read_pairs(spark, path)


SQL["csv_pairs"] = """
SELECT l_orderkey * 8 + l_linenumber AS pair_id, CAST(l_orderkey % 10 + 1 AS INTEGER) AS fold, 'P' || (l_partkey % 200) AS identity1,
       'P' || (l_partkey % 200) || '/a.jpg' AS image1_rel_path, l_partkey % 3 > 0 AS image1_exists,
       CASE WHEN l_linenumber % 4 = 0 THEN 'P' || (l_partkey % 200) ELSE 'S' || (l_suppkey % 90) END AS identity2,
       CASE WHEN l_linenumber % 4 = 0 THEN 'P' || (l_partkey % 200) ELSE 'S' || (l_suppkey % 90) END || '/b, c.jpg' AS image2_rel_path,
       true AS image2_exists, CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS is_same
FROM lineitem"""


@query("csv_identity_counts")
def _csv_counts(spark, sf):
    path = _folder(spark)

    def of(name: str):
        return F.count_if(F.col("split") == name).cast("int").alias(f"{name}_count")

    counted = _splits(spark, sf).groupBy("identity").agg(F.count("*").cast("int").alias("total_images"), of("enrollment"), of("validation"), of("test"))
    counted.write.option("header", True).csv(path)
    return readers.read_identity_counts(spark, path)


SQL["csv_identity_counts"] = f"""
WITH {_SPLITS_SQL} SELECT identity, CAST(count(*) AS INTEGER) AS total_images,
  CAST(count(*) FILTER (WHERE split = 'enrollment') AS INTEGER) AS enrollment_count,
  CAST(count(*) FILTER (WHERE split = 'validation') AS INTEGER) AS validation_count,
  CAST(count(*) FILTER (WHERE split = 'test') AS INTEGER) AS test_count FROM spl GROUP BY identity"""


@query("pair_list")
def _pair_list(spark, sf):
    """Customers as lines of a pair list with one genuine and one impostor pair a fold, over several files."""
    path = _folder(spark)
    folds = fx.table(spark, sf, "customer").count() // 2
    key = F.col("c_custkey")
    spot = F.pmod(key, F.lit(7)).cast("string")
    genuine = F.concat_ws(" ", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), spot, F.lit("3"))
    impostor = F.concat_ws(" ", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), spot, F.lit("other"), F.lit("12"))
    body = fx.table(spark, sf, "customer").select(key.alias("k"), F.when(key % 2 == 0, genuine).otherwise(impostor).alias("value"))
    head = spark.sql(f"SELECT -1L AS k, '{folds} 1' AS value")
    body.unionByName(head).repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(path)
    return readers.read_pair_list(spark, path)


SQL["pair_list"] = """
WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS pair_id, c_custkey % 2 = 0 AS genuine, c_custkey % 7 AS spot, 'n' || c_nationkey AS name FROM customer)
SELECT pair_id, CAST((pair_id - 1) // 2 + 1 AS INTEGER) AS fold, name AS identity1, name || '/' || name || '_' || lpad(CAST(spot AS VARCHAR), 4, '0') || '.jpg' AS image1_rel_path,
       CASE WHEN genuine THEN name ELSE 'other' END AS identity2,
       CASE WHEN genuine THEN name || '/' || name || '_0003.jpg' ELSE 'other/other_0012.jpg' END AS image2_rel_path,
       CASE WHEN genuine THEN 1 ELSE 0 END AS is_same FROM c"""


@query("labelled_files")
def _labelled_files(spark, sf):
    """Documents as one folder of files per source: what is found is named after its folder."""
    path = _folder(spark)
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("value"), "source")
    rows.repartition("source").write.partitionBy("source").text(path)
    found = readers.list_labelled_files(spark, path, "*.txt")
    named = found.select("identity", F.startswith("relative_path", "identity").alias("inside"), "length")
    return named.groupBy("identity").agg(F.min("inside").alias("inside"), F.sum("length").alias("bytes"))


SQL["labelled_files"] = """
SELECT 'source=' || source AS identity, true AS inside, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY source"""


@query("gallery_roundtrip")
def _gallery_roundtrip(spark, sf):
    """A valid gallery is saved and loaded again."""
    path = _folder(spark)
    templates = fx.keyed_members(spark, sf).withColumnRenamed("key", "template_id")
    unit = templates.withColumn("embedding", F.col("embedding").cast("array<float>"))
    writers.save_gallery(unit, path, 64)
    shown = readers.load_gallery(spark, path, 64).select("template_id", "identity", "source_path", F.posexplode("embedding").alias("pos", "value"))
    return rounded(shown.withColumn("value", F.col("value").cast("double")), "value", places=5)


SQL["gallery_roundtrip"] = """
SELECT vec_id AS template_id, 'id_' || label AS identity, CAST(NULL AS VARCHAR) AS source_path, CAST(i - 1 AS INTEGER) AS pos,
       round(CAST(CAST(embedding[i] AS FLOAT) AS DOUBLE), 5) AS value FROM embeddings, range(1, 65) t(i)"""


@query("cache_roundtrip")
def _cache_roundtrip(spark, sf):
    """Vectors by key through the cache, in two appends; some could not be embedded."""
    path = _folder(spark)
    rows = fx.keyed_members(spark, sf).select(F.col("key").cast("string").alias("key"), F.when(F.col("key") % 9 != 0, F.col("embedding")).alias("embedding"), (F.col("key") % 2).alias("half"))
    for half in (0, 1):
        writers.write_embedding_cache(rows.where(F.col("half") == half), path)
    back = readers.read_embedding_cache(spark, path)
    return back.select("key", F.col("embedding").isNull().alias("failed"), F.round(F.get("embedding", 63).cast("double"), 5).alias("last"))


SQL["cache_roundtrip"] = """
SELECT CAST(vec_id AS VARCHAR) AS key, vec_id % 9 = 0 AS failed,
       CASE WHEN vec_id % 9 <> 0 THEN round(CAST(CAST(embedding[64] AS FLOAT) AS DOUBLE), 5) END AS last FROM embeddings"""


@query("quality_cache_roundtrip")
def _quality_cache(spark, sf):
    path = _folder(spark)
    scored = qua.quality_scores(fx.detections(spark, sf)).select("image_id", "det_idx", "face_width", "face_height", "blur_score")
    writers.write_quality_cache(scored, path)
    return readers.read_quality_cache(spark, path)


SQL["quality_cache_roundtrip"] = f"WITH {DETECTIONS} SELECT image_id, CAST(det_idx AS INTEGER) AS det_idx, CAST(w AS INTEGER) AS face_width, CAST(h AS INTEGER) AS face_height, blur_score FROM d4"


@query("detection_log")
def _detection_log(spark, sf):
    """The log after a batch append and a live append of the same rows."""
    path, base = _folder(spark), _folder(spark)
    seen = fx.observations(spark, sf).select(*schemas.column_names(schemas.OBSERVATIONS)[:4], "recognized")
    seen.write.parquet(f"{base}/in")
    writers.append_detection_log(seen, path)
    live = spark.readStream.schema(seen.schema).parquet(f"{base}/in")
    run_detection_log(live, f"{base}/live", f"{base}/state").awaitTermination()
    both = readers.read_detection_log(spark, path).unionByName(readers.read_detection_log(spark, f"{base}/live"))
    return both.groupBy("name", "time").agg(F.count("*").alias("n"))


SQL["detection_log"] = """
WITH o AS (SELECT user_id % 10 AS u, user_id // 10 % 3 AS alt, epoch_us(ts) // 43200000000 % 3 AS base, ts FROM events)
SELECT 'P' || CASE WHEN u = 0 THEN alt ELSE base END AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 2 * count(*) AS n
FROM o WHERE u <> 1 GROUP BY ALL"""


@query("live_faults")
def _live_faults(spark, sf):
    """Faulty rows of the live job's input in its side table: some fields are taken away here."""
    base = _folder(spark)
    seen = fx.observations(spark, sf).withColumn("quality_score", F.lit(None).cast("double"))
    key = F.col("event_id")
    spoilt = seen.withColumns(
        {
            "stream_id": F.when(key % 101 != 3, F.col("stream_id")),
            "ts": F.when(key % 103 != 5, F.col("ts")),
            "recognized": F.when(key % 107 != 7, F.col("recognized")),
        }
    )
    spoilt.select(*schemas.column_names(schemas.OBSERVATIONS)).write.parquet(f"{base}/in")
    live = spark.readStream.schema(schemas.OBSERVATIONS).parquet(f"{base}/in")
    run_fault_log(live, f"{base}/faults", f"{base}/state").awaitTermination()
    found = spark.read.schema(schemas.OBSERVATIONS + ", error STRING").parquet(f"{base}/faults")
    return found.select("stream_id", "frame_index", F.unix_micros("ts").alias("us"), "recognized", "error")


SQL["live_faults"] = """
WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS frame_index, epoch_us(ts) AS us, user_id % 10 <> 1 AS rec FROM events),
s AS (SELECT CASE WHEN event_id % 101 <> 3 THEN event_type END AS stream_id, frame_index, CASE WHEN event_id % 103 <> 5 THEN us END AS us,
             CASE WHEN event_id % 107 <> 7 THEN rec END AS recognized FROM o)
SELECT stream_id, frame_index, us, recognized,
       CASE WHEN stream_id IS NULL THEN 'missing stream' WHEN us IS NULL THEN 'missing time' ELSE 'missing recognition result' END AS error
FROM s WHERE stream_id IS NULL OR us IS NULL OR recognized IS NULL"""


@query("json_export")
def _json_export(spark, sf):
    path = _folder(spark)
    writers.export_attendance_json(att.attendance_from_events(fx.presence_log(spark, sf)), path)
    fields = "record_id STRING, identity STRING, date STRING, first_check_in STRING, session_count BIGINT, status STRING"
    return spark.read.schema(fields).json(path)


SQL["json_export"] = f"""
WITH {LOG}, {span_ctes('pl', 0)} SELECT record_id, identity, date,
  strftime(make_timestamp(first_check_in), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS first_check_in, session_count, status FROM rec"""


@query("scored_pairs_csv")
def _scored_csv(spark, sf):
    path = _folder(spark)
    pairs = fx.scored_pairs(spark, sf)
    writers.write_scored_pairs(pairs, path)
    back = readers.read_scored_pairs(spark, path, "experiment_id STRING, fold BIGINT, identity1 STRING, identity2 STRING, is_same INT, raw_score DOUBLE")
    return back.groupBy("experiment_id", "fold", "is_same").agg(F.count("*").alias("n"), F.round(F.sum("raw_score"), 3).alias("total"), F.max("identity2").alias("last"))


SQL["scored_pairs_csv"] = f"""
WITH {SQL['confusion_at_threshold'][SQL['confusion_at_threshold'].index('scored AS') : SQL['confusion_at_threshold'].index('FROM lineitem)') + 14]}
SELECT experiment_id, fold, is_same, count(*) AS n, round(sum(raw_score), 3) AS total, max(identity2) AS last FROM scored GROUP BY ALL"""


@query("fixed_rate_times")
def _fixed_rate(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_index"))
    timed = tem.fixed_rate_times(rows, F.lit("2024-01-01 00:00:00").cast("timestamp"), 24.0)
    return timed.select("frame_index", F.unix_micros("ts").alias("ts"))


SQL["fixed_rate_times"] = """
SELECT o_orderkey AS frame_index, epoch_us(TIMESTAMP '2024-01-01') + CAST(round(o_orderkey * CAST(1e6 / 24.0 AS DOUBLE)) AS BIGINT) AS ts FROM orders"""


@query("audit_filter")
def _audit_filter(spark, sf):
    audits = att.audit_from_sessions(fx.session_log(spark, sf))
    return att.list_audits(audits, date="2024-01-05", identity="U7").select("session_id", "identity", F.unix_micros("started_at").alias("started_at"))


SQL["audit_filter"] = f"""
WITH a AS ({SQL['session_audit']}) SELECT session_id, identity, started_at FROM a WHERE CAST(date AS VARCHAR) = '2024-01-05' AND identity = 'U7'"""


@query("record_lookup")
def _record_lookup(spark, sf):
    """One record by identity and date, and all records of one identity, in their public shape."""
    records = att.attendance_from_events(fx.presence_log(spark, sf))
    both = att.find_record(records, "U3", "2024-01-05").withColumn("asked", F.lit("day")).unionByName(att.find_identity(records, "U4").withColumn("asked", F.lit("identity")))
    shown = pub.public_records(both.drop("asked")).select("record_id", "identity", "date", "first_check_in", "last_check_out", "session_count", "status", "updated_at")
    return shown.join(both.select("record_id", "asked"), "record_id")


SQL["record_lookup"] = f"""
WITH {LOG}, {span_ctes('pl', 0)}, q AS (
  SELECT *, CASE WHEN identity = 'U4' THEN 'identity' ELSE 'day' END AS asked FROM rec
  WHERE identity = 'U4' OR (identity = 'U3' AND date = '2024-01-05'))
SELECT record_id, asked, identity, date, strftime(make_timestamp(first_check_in), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS first_check_in,
  strftime(make_timestamp(last_check_out), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS last_check_out, session_count, status,
  strftime(make_timestamp(updated_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS updated_at FROM q"""


@query("public_audits")
def _public_audits(spark, sf):
    return pub.public_audits(att.audit_from_events(fx.presence_log(spark, sf)))


SQL["public_audits"] = f"""
WITH a AS ({SQL['session_audit_span'].replace("round((us - first_us) / CAST(1000000 AS DOUBLE), 3)", "pyround((us - first_us) / CAST(1000000 AS DOUBLE), 2)")})
SELECT session_id, identity, CAST(date AS VARCHAR) AS date, strftime(make_timestamp(started_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS started_at,
  strftime(make_timestamp(ended_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ended_at, duration_seconds,
  observation_count, interruption_count, closure_reason FROM a"""


@query("box_helpers")
def _boxes(spark, sf):
    """Boxes of detections as x, y, width, height, moved over the edge and clamped again."""
    box = F.col("bbox")
    x, y = box["left"] - 60, box["top"] + 90
    made = qual.box_from_xywh(x, y, box["right"] - box["left"], box["bottom"] - box["top"])
    clamped = qual.clamp_box(made, F.col("image_w"), F.col("image_h"))
    return fx.detections(spark, sf).select("image_id", "det_idx", clamped.alias("b")).select("image_id", "det_idx", "b.*")


SQL["box_helpers"] = f"""
WITH {DETECTIONS}, m AS (SELECT image_id, det_idx, greatest(0, least(tp + 90, 249)) AS top, greatest(0, least(lft - 60, 249)) AS lf, lft - 60 + w AS r, tp + 90 + h AS b FROM d4)
SELECT image_id, CAST(det_idx AS INTEGER) AS det_idx, CAST(top AS INTEGER) AS top, CAST(greatest(lf + 1, least(r, 250)) AS INTEGER) AS "right",
       CAST(greatest(top + 1, least(b, 250)) AS INTEGER) AS bottom, CAST(lf AS INTEGER) AS "left" FROM m"""


@query("landmark_order")
def _landmarks(spark, sf):
    """Landmarks of detections with eyes and mouth corners swapped, put in order again."""
    p = F.col("landmarks")
    swapped = F.when(p.isNotNull() & (F.col("image_id") % 2 == 0), F.array(p[1], p[0], p[2], p[4], p[3])).otherwise(p)
    rows = fx.detections(spark, sf).where(p.isNotNull()).select("image_id", "det_idx", swapped.alias("landmarks"))
    put = qual.ordered_landmarks(F.col("landmarks"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.round(put[i][0].cast("double"), 3))
    return rows.select("image_id", "det_idx", F.posexplode(cells).alias("point", "x"))


SQL["landmark_order"] = f"""
WITH {DETECTIONS}, x AS (SELECT image_id, det_idx, [least(lx, rx), greatest(lx, rx), nx, least(mlx, mrx), greatest(mlx, mrx)] AS xs FROM d4 WHERE marks)
SELECT image_id, CAST(det_idx AS INTEGER) AS det_idx, CAST(i - 1 AS INTEGER) AS point, round(xs[i], 3) AS x FROM x, range(1, 6) t(i)"""


@query("path_separators")
def _separators(spark, sf):
    rows = fx.table(spark, sf, "documents")
    return rows.select("doc_id", sca.forward_slashes(F.concat_ws("\\", "source", "lang", F.lit("a/b"))).alias("path"))


SQL["path_separators"] = "SELECT doc_id, concat_ws('/', source, lang, 'a/b') AS path FROM documents"


@query("cleared_table")
def _cleared(spark, sf):
    """Clearing keeps a table's columns; what is left is counted beside what there was."""
    audits = att.audit_from_sessions(fx.session_log(spark, sf))
    left = att.cleared(audits)
    before = audits.select(F.lit("before").alias("state"), "session_id").unionByName(left.select(F.lit("after").alias("state"), "session_id"))
    return before.groupBy("state").agg(F.count("*").alias("n"), F.lit(len(left.columns)).alias("columns"))


SQL["cleared_table"] = f"WITH a AS ({SQL['session_audit']}) SELECT 'before' AS state, count(*) AS n, 9 AS columns FROM a"


@query("report_json")
def _report_json(spark, sf):
    """The nested report, written as JSON, read back and laid out as rows."""
    scored, path = fx.scored_pairs(spark, sf), _folder(spark)
    report = met.nested_report(met.class_spread(scored), met.fold_metrics(scored), cal.calibration_strategies(scored))
    writers.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)

    def rows(part: str, name: str, threshold: str, accuracy: str):
        one = back.select("summary.*", F.explode("folds" if part == "fold" else "strategies").alias("x"))
        return one.select(
            *[c for c in one.columns if c != "x"],
            F.lit(part).alias("part"),
            F.col(f"x.{name}").cast("string").alias("name"),
            F.col(f"x.{threshold}").alias("threshold"),
            F.col(f"x.{accuracy}").alias("accuracy"),
        )

    return rows("fold", "fold", "calibrated_threshold", "calibrated_accuracy").unionByName(rows("strategy", "strategy", "threshold", "accuracy"))
