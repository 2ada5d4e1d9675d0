"""How often wide rows are read and moved."""

from pyspark.sql import functions as F

from rollmark.operators import enrollment as enr
from rollmark.operators import pairs as prs


def test_accepted_requests_are_judged_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(name):
        read.add(1)
        return name

    vector = F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>")
    name = F.concat(F.lit("P"), (F.col("id") % 3).cast("string"))
    outcomes = spark.range(30).select(
        F.col("id").alias("request_id"), F.udf(seen, "string").asNondeterministic()(name).alias("identity"), F.lit(True).alias("success"), vector.alias("embedding")
    )
    templates = spark.range(2).select(F.col("id").alias("template_id"), F.lit("P0").alias("identity"), vector.alias("embedding"))
    known = templates.limit(0).select(
        "identity", F.lit(0).cast("bigint").alias("template_count"), *[F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "updated_at")], F.lit("").alias("notes")
    )
    gallery, people = enr.enroll(outcomes, templates, known, 2, F.lit("2024-01-01").cast("timestamp"))
    assert {r.identity: r.template_count for r in people.collect()} == {"P0": 12, "P1": 10, "P2": 10}
    assert sorted(r.template_id for r in gallery.collect()) == [0, 1, *range(2, 32)]
    assert read.value == 30


def test_vectors_of_pairs_are_broadcast_unless_they_are_many(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0])], "key BIGINT, embedding ARRAY<FLOAT>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 1), (9, 1)], "key1 BIGINT, key2 BIGINT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        near, far = prs.score_pairs(pairs, vectors), prs.score_pairs(pairs, vectors, broadcast_bytes=0)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near, far)]
        assert ["SortMergeJoin" in p for p in plans] == [False, True]
        rows = [sorted(map(str, df.collect())) for df in (near, far)]
        assert rows[0] == rows[1] and len(rows[0]) == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
