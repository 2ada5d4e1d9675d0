"""Views of the given tables in the shapes the operators expect.

The star-schema and event tables carry no identities, so these projections assign roles:
vectors become templates and queries, line items become scored pairs and detections,
events become observation streams. Each is a plain projection of a whole table; the SQL
twins in ``oracle.py`` spell out the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollmark.functions.scalars import content_hash
from rollmark.operators.ordering import positions
from rollmark.operators.presence import presence_events
from rollmark.operators.quality import primary_detections, quality_scores
from rollmark.operators.temporal import number_frames, stabilise, to_observations
from rollmark.policies import PRESENCE, TEMPORAL, preset
from rollmark.session import broadcast_vectors, spread

SESSION_LIMIT_SECONDS = 60_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its identity and its position inside that identity."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("id_"), F.col("label").cast("string")).alias("identity")
    )
    return positions(vectors, ["identity"], "vec_id", "rn")


def gallery_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every other vector of an identity is a template, the others are queries: both grow with the table."""
    ranked = members(spark, sf_dir)
    templates = ranked.where("rn % 2 = 1").select(F.col("vec_id").alias("template_id"), "identity", "embedding")
    queries = ranked.where("rn % 2 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("identity").alias("true_identity"), "embedding"
    )
    return templates, queries


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored pairs: two classes that overlap, with many tied scores."""
    same = F.when(F.col("l_linenumber") % 4 == 0, 1).otherwise(0)
    mixed = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 1000 - 500
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("E"), (F.col("l_suppkey") % 2 + 1).cast("string")).alias("experiment_id"),
        (F.col("l_orderkey") % 10 + 1).alias("fold"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 200).cast("string")).alias("identity1"),
        F.when(same == 1, F.concat(F.lit("P"), (F.col("l_partkey") % 200).cast("string")))
        .otherwise(F.concat(F.lit("P"), ((F.col("l_partkey") + 1 + F.col("l_suppkey") % 198) % 200).cast("string")))
        .alias("identity2"),
        same.alias("is_same"),
        F.round(0.64 * same + mixed / F.lit(1000.0), 4).alias("raw_score"),
    )


def continuous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored pairs whose scores hardly ever repeat, with a far outlier."""
    price = F.col("l_extendedprice").cast("double")
    score = F.when(F.col("l_orderkey") == 7, F.lit(1e6)).otherwise(
        F.floor((price / F.lit(7919.0) + F.col("l_orderkey") % 9973 / F.lit(10007.0)) * F.lit(1e9)).cast("double") / F.lit(1e9)
    )
    same = F.when((F.col("l_linenumber") + F.col("l_partkey")) % 3 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(same.alias("is_same"), score.alias("raw_score"))


#: Policy durations are stretched by this, since the events are minutes apart and camera frames are not.
TIME_SCALE = 1800


def keyed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as identity members with a numeric key."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("id_"), F.col("label").cast("string")).alias("identity"),
        F.col("vec_id").alias("key"),
        "embedding",
    )


def vector_keys(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The number of vectors, and that number with a margin of keys that no vector has."""
    n = table(spark, sf_dir, "embeddings").count()
    return n, n + n // 25 + 1


def claimed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims that two vectors belong together; some name vectors that do not exist."""
    known, wide = vector_keys(spark, sf_dir)
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim"),
        (F.col("l_orderkey") % wide).alias("key1"),
        (F.col("l_partkey") % known).alias("key2"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognition observations: one stream per event type, three identities."""
    user = F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    shift = F.floor(F.unix_micros(ts) / F.lit(43_200_000_000)).cast("bigint") % 3
    candidate = F.when(user % 10 == 0, F.floor(user / 10).cast("bigint") % 3).otherwise(shift)
    recognized = user % 10 != 1
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream_id"),
        "event_id",
        ts.alias("ts"),
        F.concat(F.lit("P"), candidate.cast("string")).alias("best_candidate"),
        F.when(recognized, F.lit(0.8)).otherwise(F.lit(0.1)).alias("similarity"),
        F.lit(0.24).alias("threshold"),
        recognized.alias("recognized"),
        F.when(user % 10 == 2, F.lit("poor")).otherwise(F.lit("good")).alias("quality_status"),
        F.concat(F.lit("P"), shift.cast("string")).alias("true_identity"),
    )
    named = to_observations(rows.withColumn("identity", F.col("best_candidate")))
    return number_frames(named, ["event_id"])


def temporal_settings(mode: str = "balanced") -> dict[str, float]:
    return preset(TEMPORAL, mode, scale=TIME_SCALE)


def presence_settings(mode: str = "balanced") -> dict[str, float]:
    """Durations stretched to the spacing of the events; sessions last 60 000 s at most."""
    return preset(PRESENCE, mode, scale=TIME_SCALE, max_session_duration_seconds=SESSION_LIMIT_SECONDS)


def stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stabilise(observations(spark, sf_dir), temporal_settings())


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence_events(stabilised(spark, sf_dir), presence_settings())


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images; a few are invalid."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 37 != 0).alias("valid")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to three detections per image with geometry mixed from its key."""
    key = F.col("k")

    def mixed(factor: int, size: int):
        return (key * factor) % size

    def point(x, y):
        return F.array((F.col("left") + x).cast("float"), (F.col("top") + y).cast("float"))

    found = (
        spread(table(spark, sf_dir, "orders").select("o_orderkey"))
        .select("o_orderkey", F.explode(F.expr("sequence(0L, o_orderkey % 4)")).alias("det_idx"))
        .where("det_idx > 0")
        .select(F.col("o_orderkey").alias("image_id"), (F.col("det_idx") - 1).cast("int").alias("det_idx"))
        .withColumn("k", F.col("image_id") * 7 + F.col("det_idx") * 13)
        .withColumns(
            {
                "w": (mixed(37, 90) + 20).cast("int"),
                "h": (mixed(53, 90) + 20).cast("int"),
                "left": mixed(11, 120).cast("int"),
                "top": mixed(17, 120).cast("int"),
            }
        )
    )
    w, h = F.col("w"), F.col("h")
    jitter = [(mixed(f, 11) - 5).cast("double") for f in (3, 5, 7)]
    points = F.array(
        point(w * 0.3, h * 0.35 + jitter[0]),
        point(w * 0.7, h * 0.35 + jitter[1]),
        point(w * 0.5 + jitter[2], h * 0.55),
        point(w * 0.35, h * 0.75),
        point(w * 0.65, h * 0.75),
    )
    return found.select(
        "image_id",
        "det_idx",
        F.lit(250).alias("image_w"),
        F.lit(250).alias("image_h"),
        F.struct(
            F.col("top").alias("top"),
            (F.col("left") + w).alias("right"),
            (F.col("top") + h).alias("bottom"),
            F.col("left").alias("left"),
        ).alias("bbox"),
        (mixed(29, 600) / F.lit(1000.0) + 0.4).alias("confidence"),
        F.when(mixed(19, 17) != 0, points).alias("landmarks"),
        (mixed(71, 3000) / F.lit(10.0)).alias("blur_score"),
        (mixed(43, 2560) / F.lit(10.0)).alias("brightness_score"),
        (mixed(61, 700) / F.lit(10.0)).alias("contrast_score"),
    )


def embedded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the vector their image key points to, where there is one."""
    vectors = broadcast_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_key"), "embedding"))
    keyed = detections(spark, sf_dir).withColumn("_key", F.col("image_id") % vector_keys(spark, sf_dir)[1])
    return keyed.join(vectors, "_key", "left").drop("_key")


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each image's primary detection, keyed by image."""
    return quality_scores(primary_detections(detections(spark, sf_dir))).withColumnRenamed("image_id", "key")


def quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored pairs of images."""
    pairs = table(spark, sf_dir, "lineitem").select(
        "*", F.col("l_orderkey").alias("key1"), F.col("l_partkey").alias("key2")
    )
    same = F.when(F.col("l_linenumber") % 4 == 0, 1).otherwise(0)
    mixed = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 1000 - 500
    return pairs.select(
        "key1", "key2", same.alias("is_same"), F.round(0.64 * same + mixed / F.lit(1000.0), 4).alias("raw_score")
    )


def presence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as presence events of forty identities, with repeated and unnamed sessions."""
    user = F.col("user_id") % 40
    ts = F.col("ts").cast("timestamp")
    kind = (
        F.when(F.col("event_type") == "view", "ENTRY_CONFIRMED")
        .when(F.col("event_type") == "click", "SESSION_ENDED")
        .when(F.col("event_type") == "signup", "PRESENCE_RESUMED")
        .when(F.col("event_type") == "purchase", "PRESENCE_UPDATED")
        .otherwise("GRACE_STARTED")
    )
    slot = F.floor(F.unix_micros(ts) / F.lit(21_600_000_000)).cast("bigint").cast("string")
    session = F.concat(F.lit("S"), user.cast("string"), F.lit("-"), slot)
    return table(spark, sf_dir, "events").select(
        F.lit("door").alias("stream_id"),
        F.col("event_id").alias("frame_index"),
        F.lit(0).alias("event_seq"),
        ts.alias("ts"),
        F.when(user == 0, "Unknown").otherwise(F.concat(F.lit("U"), user.cast("string"))).alias("identity"),
        kind.alias("event_type"),
        F.when(F.col("event_id") % 13 != 0, session).alias("session_id"),
        F.concat(F.lit("because "), F.col("event_type")).alias("reason"),
    )


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished sessions; a few are still open."""
    user = F.col("user_id") % 40
    ts = F.col("ts").cast("timestamp")
    length = (F.col("value") * 60).cast("bigint")
    ended = F.timestamp_micros(F.unix_micros(ts) + length * 1_000_000)
    closed = F.col("event_id") % 17 != 0
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("session_id"),
        F.concat(F.lit("U"), user.cast("string")).alias("identity"),
        ts.alias("started_at"),
        ended.alias("last_seen_at"),
        F.when(closed, ended).alias("ended_at"),
        length.cast("double").alias("duration_seconds"),
        (F.col("event_id") % 9 + 1).cast("int").alias("observation_count"),
        (F.col("event_id") % 3).cast("int").alias("interruption_count"),
    )


def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dataset items; their whole text is hashed."""
    digit = F.col("doc_id") % 10
    split = F.when(digit < 2, "enrollment").when(digit < 6, "validation").otherwise("test")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.concat_ws("_", "source", "lang").alias("identity"),
        split.alias("split"),
        content_hash(F.col("text")).alias("file_hash"),
        (F.col("n_chars") % 3 * 50 + 150).cast("int").alias("width"),
        F.lit(250).alias("height"),
    )
