import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollmark.functions import vectors as vec
from rollmark.operators import gallery as gal

DIM = 8
TEMPLATES = "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>"
QUERIES = "query_id BIGINT, embedding ARRAY<FLOAT>"


def unit(index, scale=1.0, **extra):
    row = [0.0] * DIM
    row[index] = scale
    for key, value in extra.items():
        row[int(key[1:])] = value
    return row


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, "Alice", unit(0)), (2, "Bob", unit(1))], TEMPLATES)


def one(df):
    return df.first()


def test_known_query_is_accepted(spark, pair):
    query = spark.createDataFrame([(1, unit(0, 0.95, i2=0.1))], QUERIES)
    row = one(gal.search(query, pair, 0.45))
    assert (row.identity, row.recognized) == ("Alice", True) and row.score > 0.9


def test_stranger_keeps_candidate(spark, pair):
    row = one(gal.search(spark.createDataFrame([(1, unit(5))], QUERIES), pair, 0.45))
    assert (row.identity, row.best_candidate, row.recognized, row.score) == (None, "Alice", False, 0.0)


def test_threshold_is_inclusive(spark, pair):
    query = spark.createDataFrame([(1, unit(1))], QUERIES)
    assert one(gal.search(query, pair, 1.0)).recognized


def test_unusable_queries_and_empty_gallery(spark, pair):
    queries = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [0.0] * DIM)], QUERIES)
    rows = {r.query_id: r for r in gal.search(queries, pair).collect()}
    for at in (1, 2, 3):
        assert (rows[at].identity, rows[at].best_candidate, rows[at].score) == (None, "Unknown", -1.0)
    assert (rows[4].best_candidate, rows[4].score) == ("Alice", 0.0)
    empty = gal.search(queries, pair.where("false"))
    assert {(r.best_candidate, r.score, r.recognized) for r in empty.collect()} == {("Unknown", -1.0, False)}


def test_tie_goes_to_the_identity_enrolled_first(spark):
    """The winner is whose first template came first, even if another's reached the score first."""
    templates = spark.createDataFrame(
        [(1, "Late", unit(3)), (2, "Other", unit(0)), (3, "Late", unit(0))], TEMPLATES
    )
    query = spark.createDataFrame([(1, unit(0))], QUERIES)
    assert one(gal.search(query, templates)).best_candidate == "Late"
    assert one(gal.match_cosine(query, templates, 0.5)).identity == "Other"


def test_euclidean_boundary(spark):
    reference = spark.createDataFrame([(1, "Zero", [0.0] * DIM)], TEMPLATES)
    queries = spark.createDataFrame([(1, unit(0, 0.4)), (2, unit(0, 0.6)), (3, unit(0, 0.5))], QUERIES)
    rows = {r.query_id: r for r in gal.match_euclidean(queries, reference, 0.5).collect()}
    assert [rows[i].identity for i in (1, 2, 3)] == ["Zero", "Unknown", "Zero"]
    assert rows[1].score == pytest.approx(0.4)
    empty = one(gal.match_euclidean(queries, reference.where("false"), 0.5))
    assert (empty.identity, empty.score) == ("Unknown", float("inf"))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("tie", ["identity", "template"])
def test_blocks_equal_broadcast_and_brute_force(spark, small, metric, tie):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    templates = vectors.where("vec_id % 3 = 0").select(
        F.col("vec_id").alias("template_id"), F.concat(F.lit("p"), F.col("label")).alias("identity"), "embedding"
    )
    # exact copies of a third of the gallery, under other ids, to force ties
    copies = templates.select((F.col("template_id") + 1000).alias("template_id"), F.lit("copy").alias("identity"), "embedding")
    templates = templates.union(copies)
    queries = vectors.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("query_id"), "embedding")
    queries = queries.union(templates.where("template_id < 30").select(F.col("template_id") + 5000, "embedding"))
    in_blocks = gal.nearest_templates(queries, templates, metric, tie, broadcast_bytes=0, chunk_bytes=64 * 8 * 50)
    whole = gal.nearest_templates(queries, templates, metric, tie)
    got = {r.query_id: r for r in in_blocks.collect()}
    assert {k: (v.candidate, v.template_id) for k, v in got.items()} == {
        r.query_id: (r.candidate, r.template_id) for r in whole.collect()
    }
    gallery = sorted(templates.collect(), key=lambda r: r.template_id)
    first = {}
    for r in gallery:
        first.setdefault(r.identity, r.template_id)
    for q in queries.collect():
        v = np.array(q.embedding, dtype=float)
        if metric == "cosine":
            v = v / np.linalg.norm(v)
            scores = [-float(np.dot(np.array(t.embedding, dtype=float), v)) for t in gallery]
        else:
            scores = [float(np.linalg.norm(np.array(t.embedding, dtype=float) - v)) for t in gallery]
        ranked = min(
            range(len(gallery)),
            key=lambda i: (round(scores[i], 9), first[gallery[i].identity] if tie == "identity" else gallery[i].template_id),
        )
        assert got[q.query_id].candidate == gallery[ranked].identity
        assert abs(got[q.query_id].score) == pytest.approx(abs(scores[ranked]), abs=1e-6)


def test_centroid_is_unit_mean(spark):
    rows = spark.createDataFrame([("a", unit(0)), ("a", unit(1)), ("z", [0.0] * DIM)], "identity STRING, embedding ARRAY<FLOAT>")
    got = {r.identity: r.embedding for r in vec.centroids(rows).collect()}
    assert got["a"][:2] == pytest.approx([2**-0.5, 2**-0.5])
    assert got["z"] == [0.0] * DIM


def test_validation_errors(spark, pair):
    assert one(gal.validate(pair, DIM)).valid
    bad = pair.union(spark.createDataFrame([(3, "C", unit(0, 2.0)), (4, "D", unit(0, float("nan"))), (5, "E", [1.0])], TEMPLATES))
    report = one(gal.validate(bad, DIM))
    assert not report.valid
    assert set(report.errors) == {"non-finite values", "not unit normalised", "unexpected dimension"}


def test_add_checks_dimension_and_normalises(spark, pair):
    new = spark.createDataFrame([(1, "Cora", unit(2, 4.0))], TEMPLATES)
    grown = gal.add_templates(pair, new, DIM)
    row = grown.where("identity = 'Cora'").first()
    assert row.template_id == 3 and row.embedding[2] == pytest.approx(1.0)
    wrong = spark.createDataFrame([(1, "Dan", [1.0, 2.0])], TEMPLATES)
    with pytest.raises(Exception, match="dimension"):
        gal.add_templates(pair, wrong, DIM).collect()
    assert gal.removed_count(grown, "Alice").first().removed == 1
    assert gal.remove_identity(grown, "Alice").count() == 2


def test_every_detection_is_matched(spark, pair):
    rows = spark.createDataFrame(
        [(7, [(0, unit(0)), (1, unit(5))])], "image_id BIGINT, detections ARRAY<STRUCT<det_idx: INT, embedding: ARRAY<FLOAT>>>"
    )
    for options in ({}, {"broadcast_bytes": 0, "chunk_bytes": 64}):
        got = {r.det_idx: r.identity for r in gal.match_detections(rows, pair, 0.5, **options).collect()}
        assert got == {0: "Alice", 1: "Unknown"}


def test_quarantine_by_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], QUERIES)
    good, bad = vec.split_by_dimension(rows, 2)
    assert [r.query_id for r in good.collect()] == [1] and sorted(r.query_id for r in bad.collect()) == [2, 3]


WAYS = [{}, {"broadcast_bytes": 0, "chunk_bytes": DIM * 8}]


@pytest.mark.parametrize("way", WAYS)
def test_non_finite_vectors_are_never_recognised(spark, way):
    nan, inf = float("nan"), float("inf")
    templates = spark.createDataFrame([(1, "Alice", unit(0)), (2, "Bad", unit(1, nan)), (3, "Worse", unit(2, inf)), (4, None, None)], TEMPLATES)
    queries = spark.createDataFrame([(1, unit(0, nan)), (2, unit(0, inf)), (3, unit(0)), (4, unit(1))], QUERIES)
    rows = {r.query_id: r for r in gal.search(queries, templates, 0.5, **way).collect()}
    assert [(rows[i].identity, rows[i].best_candidate, rows[i].score) for i in (1, 2)] == [(None, "Unknown", -1.0)] * 2
    assert (rows[3].identity, rows[4].best_candidate, rows[4].recognized) == ("Alice", "Alice", False)
    left_out = {(r.template_id, r.reason) for r in gal.quarantined(templates).collect()}
    assert left_out == {(2, "non-finite values"), (3, "non-finite values"), (4, "missing embedding")}


@pytest.mark.parametrize("way", WAYS)
def test_a_gallery_of_several_dimensions_is_refused_unless_one_is_stated(spark, way):
    rows = [(1, "Long", [*unit(0), 1.0]), (2, "Alice", unit(0)), (3, "Bob", unit(1)), (4, "Short", [1.0])]
    templates, query = spark.createDataFrame(rows, TEMPLATES), spark.createDataFrame([(1, unit(0))], QUERIES)
    with pytest.raises(ValueError, match="dimensions"):
        gal.search(query, templates, **way)
    row = one(gal.search(query, templates, dim=DIM, **way))
    assert (row.identity, row.score) == ("Alice", 1.0)
    assert {r.template_id for r in gal.quarantined(templates, DIM).collect()} == {1, 4}
    assert not one(gal.search(query, templates, dim=DIM + 7, **way)).recognized


@pytest.mark.parametrize("way", WAYS)
def test_near_ties_go_by_the_exact_score(spark, way):
    doubles = "template_id BIGINT, identity STRING, embedding ARRAY<DOUBLE>"
    templates = spark.createDataFrame([(1, "A", unit(0, 1 - 4e-13)), (2, "B", unit(0, 1.0))], doubles)
    query = spark.createDataFrame([(1, unit(0))], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    assert one(gal.search(query, templates, **way)).identity == "B"


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("size", [1.0, 500.0])
def test_euclidean_finds_the_vector_itself_among_near_duplicates(spark, way, size):
    doubles = "template_id BIGINT, identity STRING, embedding ARRAY<DOUBLE>"
    rows = [(1, "Near", unit(0, size + 5e-7, i1=3.0)), (2, "Self", unit(0, size, i1=3.0)), (3, "Copy", unit(0, size, i1=3.0))]
    query = spark.createDataFrame([(1, unit(0, size, i1=3.0))], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    row = one(gal.match_euclidean(query, spark.createDataFrame(rows, doubles), 0.1, **way))
    assert (row.identity, row.score) == ("Self", 0.0)


@pytest.mark.parametrize("way", WAYS)
def test_every_row_is_answered_by_itself(spark, pair, way):
    queries = spark.createDataFrame([(1, unit(0), "x"), (1, unit(1), "y"), (None, unit(1), "z")], QUERIES + ", note STRING").select("note", "query_id", "embedding")
    found = gal.search(queries, pair, **way)
    assert found.columns[:2] == ["note", "query_id"]
    assert {(r.note, r.query_id, r.identity) for r in found.collect()} == {("x", 1, "Alice"), ("y", 1, "Bob"), ("z", None, "Bob")}


def test_centroid_ties_go_to_the_first_enrolled(spark):
    rows = [(5, "a", unit(0)), (2, "z", unit(0)), (9, "m", unit(0))]
    centres = gal.centres(spark.createDataFrame(rows, TEMPLATES))
    assert one(gal.match_centroid(spark.createDataFrame([(1, unit(0))], QUERIES), centres)).identity == "z"


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("size", [1.0, 1e-25, 1e14, 1e40])
def test_single_precision_shortlists_lose_no_best_row(metric, size):
    draws = np.random.default_rng(7)
    gallery = draws.normal(size=(300, 8)) * size
    gallery[100:200] = gallery[:100] * (1 + 1e-12)  # nearer to each other than single precision tells
    gallery[200:250] = gallery[:50]
    queries = np.concatenate([gallery[:150], draws.normal(size=(50, 8)) * size])
    rough = gal._Rough(gallery, metric)
    assert rough.single == (size in (1.0, 1e14)) and rough.weighted.dtype == (np.float32 if rough.single else np.float64)
    scores = np.stack([gal._exact(np.broadcast_to(q, gallery.shape), gallery, metric) for q in queries])
    chosen, best = gal._nearest(queries, rough)
    assert (chosen == scores.argmin(axis=1)).all() and (best == scores.min(axis=1)).all()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_products_are_small_whatever_the_gallery(metric, monkeypatch):
    draws = np.random.default_rng(3)
    gallery, queries = draws.normal(size=(40_000, 8)), draws.normal(size=(2_000, 8))
    gallery[30_000:] = gallery[:10_000]  # equal rows far apart: the first wins
    queries[:500] = gallery[30_000:30_500]
    rough = gal._Rough(gallery, metric)
    tracemalloc.start()
    chosen, best = gal._nearest(queries, rough)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores at once are 320 MB
    monkeypatch.setattr(gal, "QUERY_TILE", 7)
    monkeypatch.setattr(gal, "GALLERY_TILE", 999)
    assert all((a == b).all() for a, b in zip(gal._nearest(queries[:50], rough), (chosen[:50], best[:50])))
    for at in range(0, 2_000, 100):
        scores = gal._exact(np.broadcast_to(queries[at], gallery.shape), gallery, metric)
        assert (chosen[at], best[at]) == (scores.argmin(), scores.min())


def test_a_gallery_of_equal_rows_is_shortlisted_in_parts():
    gallery = np.ones((100_000, 4))
    queries = np.concatenate([np.ones((100, 4)), np.zeros((1, 4))])
    rough = gal._Rough(gallery, "euclidean")
    assert max(len(rows) for rows, _ in rough.shortlist(queries)) <= gal.PAIRS + gal.QUERY_TILE * gal.GALLERY_TILE
    chosen, best = gal._nearest(queries, rough)
    assert (chosen == 0).all() and best.tolist() == [0.0] * 100 + [2.0]


def test_rows_without_a_vector_do_not_fill_a_group():
    """A written gallery is read once for each group: few of an audit's rows may have a vector."""
    def batch(vectors, rows):
        return pa.RecordBatch.from_arrays([pa.array([[1.0]] * vectors + [None] * (rows - vectors), type=pa.list_(pa.float64()))], names=["embedding"])

    sizes = lambda batches: [len(t) for t in gal._groups(iter(batches), 0, 100)]
    assert sizes([batch(10, 50)] * 20) == [400, 400, 200]  # four times as many rows at most
    assert sizes([batch(40, 50)] * 6) == [150, 150]
    assert sizes([batch(0, 50), batch(100, 100), batch(1, 1)]) == [150, 1]
