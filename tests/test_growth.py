"""Steps whose work must not grow faster than the rows."""

from __future__ import annotations

import logging

import pytest
from pyspark.sql import functions as F

from rollmark.operators import presence as pre
from rollmark.operators import temporal as tem
from rollmark.operators.ordering import positions
from rollmark.policies import TEMPORAL, preset


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_of_hot_groups_are_places_in_sorted_ranges(spark):
    """Columns that are no numbers are sorted as well, and no window runs over the rows."""
    df = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 3 == 0).cast("string")).alias("g"),
        F.when(F.col("id") % 11 > 0, F.md5(F.col("id").cast("string"))).alias("v"),
    )
    got = positions(df, ["g"], "v", "pos", ["id"], 20)
    assert "Window" not in plan(got)
    places = {r.id: r.pos for r in got.collect()}
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.v or "", r.id))
    wanted = {i: n for rows in groups.values() for n, (_, i) in enumerate(sorted(rows), 1)}
    assert places == wanted
    whole = positions(df, (), "v", "pos", ["id"], 20)
    assert sorted(r.pos for r in whole.collect()) == list(range(1, 601))


def observed(spark, n):
    names = F.when(F.col("id") % 9 == 8, None).otherwise(F.concat(F.lit("P"), (F.floor(F.col("id") / 40) % 3).cast("string")))
    return spark.range(n).select(
        F.lit("door").alias("stream_id"),
        (F.col("id") + 1).alias("frame_index"),
        F.timestamp_micros(F.col("id") * 100_000 + F.when(F.col("id") > n // 2, 60_000_000).otherwise(0)).alias("ts"),
        names.alias("identity"),
        names.alias("best_candidate"),
        names.isNotNull().alias("recognized"),
        F.when(F.col("id") % 5 == 0, "poor").otherwise("good").alias("quality_status"),
    )


def test_a_state_machine_that_forgets_is_folded_once(spark, caplog):
    seen = observed(spark, 2000)
    policies = {mode: preset(TEMPORAL, mode) for mode in TEMPORAL}
    with caplog.at_level(logging.INFO, "rollmark.operators.chunked"):
        cut = tem.stabilise_by_policy(seen, policies, chunk_rows=400).orderBy("mode", "frame_index").collect()
    assert "settled in 1 rounds" in caplog.text
    assert cut == tem.stabilise_by_policy(seen, policies).orderBy("mode", "frame_index").collect()


@pytest.mark.parametrize("chunk", [64])
def test_a_state_that_no_lead_tells_is_folded_again(spark, chunk):
    """The holder stays in doubt for long: what it holds on to was seen chunks before."""
    seen = observed(spark, 300).withColumn("identity", F.when(F.col("frame_index") < 20, "A").otherwise(
        F.when(F.col("frame_index") % 2 == 0, "B").otherwise("C"))).withColumn("recognized", F.lit(True))
    settings = preset(TEMPORAL, "balanced") | {"max_gap_seconds": 1e6}
    cut = tem.stabilise(seen, settings, chunk_rows=chunk).orderBy("frame_index").collect()
    assert cut == tem.stabilise(seen, settings).orderBy("frame_index").collect()


def test_arrays_and_windows_tell_the_same_evidence(spark):
    seen = observed(spark, 400).withColumn("votes", F.col("quality_status") != "poor").withColumn("seen", F.col("identity"))
    settings = preset(TEMPORAL, "balanced")
    rows = seen.withColumn("_us", F.unix_micros("ts")).toPandas().sort_values("frame_index")
    arrays = tem.window_evidence(rows, settings)
    native = tem.window_consensus(seen, settings, chunk_rows=64).orderBy("frame_index").toPandas()
    for name, column in {"gap": "after_gap", "leader": "leader", "weight": "leader_weight", "ratio": "consensus_ratio",
                         "unknown": "unknown_weight", "count": "window_count"}.items():
        assert arrays[name].tolist() == native[column].tolist(), name


def test_entry_counts_are_running_sums(spark):
    """Crowded windows: no frame slides over its rows again and again."""
    rows = spark.range(3000).select(
        F.lit("s").alias("stream_id"),
        F.lit("A").alias("identity"),
        F.timestamp_micros(F.floor(F.col("id") / 10) * 100_000).alias("ts"),
    )
    got = pre.entry_counts(rows, 5.0)
    assert "unboundedpreceding" in plan(got).lower()
    for r in got.collect():
        at = round(r.ts.timestamp() * 10)
        assert r.entries_in_window == 10 * min(at + 1, 51)


def test_only_idle_events_are_sorted_for_previous_states(spark):
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pre._FOLDED)
    steps = [("NOT_PRESENT", "CANDIDATE"), ("CANDIDATE", "PRESENT"), ("PRESENT", "PRESENT"), ("PRESENT", "ABSENT"), ("NOT_PRESENT", "CANDIDATE")]
    rows = [("", "s", k, 0, k, "A", "E", before, after, "r", None, None, None, None) for k, (before, after) in enumerate(steps)]
    got = pre.with_previous_states(spark.createDataFrame(rows, fields))
    assert "Union" in plan(got)
    assert [r.previous_state for r in got.orderBy("frame_index").collect()] == ["NOT_PRESENT", "CANDIDATE", "PRESENT", "PRESENT", "ABSENT"]
