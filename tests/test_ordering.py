"""Cells of hot groups: outliers, repeated values, NULL groups."""

import pytest
from pyspark.sql import functions as F

from rollmark.operators.ordering import _with_part, cut, exact_percentiles, neighbour, positions, running_totals
from rollmark.session import materialize, release, run


def _largest(rows):
    return max(r["n"] for r in rows.df.groupBy(*rows.keys).agg(F.count("*").alias("n")).collect())


def test_an_outlier_does_not_fill_a_cell(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), (F.col("id") + 1_700_000_000_000_000).alias("v"))
    df = df.union(spark.sql("SELECT 'g', 0L"))
    rows = cut(df, ["g"], "v", 100)
    assert rows.hot and _largest(rows) <= 100


def test_a_repeated_value_is_cut_by_the_tie_column(spark):
    df = spark.range(5_000).select(F.lit(1).alias("g"), F.lit(3.0).alias("v"), "id")
    rows = cut(df, ["g"], "v", 100, ["id"])
    assert _largest(rows) <= 100
    got = {r.id: r.pos for r in positions(df, ["g"], "v", "pos", ["id"], 100).collect()}
    assert got == {i: i + 1 for i in range(5_000)}


def test_equal_rows_stay_whole(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.lit(2).alias("v"))
    assert sorted(r.pos for r in positions(df, ["g"], "v", "pos", rows_per_cell=50).collect()) == list(range(1, 501))


@pytest.mark.parametrize("descending", [False, True])
def test_null_groups_and_values(spark, descending):
    df = spark.range(2_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), F.when(F.col("id") % 50 != 7, (F.col("id") * 37) % 1999).alias("v"), "id"
    )
    rows = cut(df, ["g"], "v", 100, ["id"])
    summed = neighbour(running_totals(rows, {"n": F.lit(1)}, ["id"], descending), {"near": "id"}, ["id"], descending).rows()
    for group in (None, "a"):
        mine = sorted((r for r in summed.collect() if r.g == group), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1)) and len(mine) > 600
        keys = [(r.v is not None, r.v or 0, r.id) for r in mine]
        assert keys == sorted(keys, reverse=descending)
        assert [r.near for r in mine] == [r.id for r in mine[1:]] + [None]


def test_percentiles_of_a_null_group(spark):
    df = spark.range(1_001).select(F.lit(None).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    (row,) = exact_percentiles(df, ["g"], "v", {"half": 0.5, "p90": 0.9}, 50).collect()
    assert (row.g, row.half, row.p90) == (None, 500.0, 900.0)


def test_tables_are_removed_after_a_run(spark):
    from rollmark.sources.files import filesystem

    with run(spark):
        frame = materialize(spark.range(5))
        (uri, *_) = frame.inputFiles()
        assert frame.count() == 5
    store, path = filesystem(uri)
    assert store.get_file_info(path).type.name == "NotFound"
    release(spark, 10**6)


def test_a_row_is_read_three_times_however_often_its_cell_is_asked(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    df = spark.range(3_000).select(F.lit("g").alias("g"), F.udf(seen, "long").asNondeterministic()("id").alias("v"))
    got = positions(df, ["g"], "v", "pos", rows_per_cell=100).collect()
    assert {r.v: r.pos for r in got} == {i: i + 1 for i in range(3_000)}
    assert read.value <= 3 * 3_000


def test_parts_count_edges_at_or_below(spark):
    edges = [float(e) for e in range(10, 2_560, 10)]
    df = spark.range(-5, 2_600).select("id", F.lit(edges).alias("_edges"))
    rows = _with_part(df.union(spark.range(1).select(F.lit(-6), F.lit(None))), F.col("id").cast("double")).collect()
    assert {r.id: r._part for r in rows} == {i: max(0, min(255, i // 10)) for i in range(-6, 2_600)}
