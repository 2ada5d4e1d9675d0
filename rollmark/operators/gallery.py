"""Open-set search of query vectors in a gallery of templates, and gallery upkeep.

``search`` is exact. A gallery that stays below ``broadcast_bytes`` (its vectors, names and ids are
counted first) is shipped to the tasks. A larger one is never collected or shuffled to the queries:
it is written once as blocks of bounded size, queries stay where they are, and each task reads
block after block for a bounded number of its queries and keeps their best template so far.

Both ways decide alike: matrix products only shortlist what may be best within their rounding error,
then each shortlisted pair is scored by itself, always in the same order of operations, and the
exact scores are compared; equal scores go by tie key and template id. Templates without a finite
vector of the gallery's dimension are left out and listed by ``quarantined``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollmark.functions.vectors import centroids, is_finite, norm, normalise
from rollmark.session import ensure_checkpoint_dir
from rollmark.sources.files import filesystem

COSINE_THRESHOLD = 0.24
BROADCAST_BYTES = 256 * 1024 * 1024
CHUNK_BYTES = 128 * 1024 * 1024
#: Vectors of queries that a task holds while it reads the blocks of a large gallery.
QUERY_BYTES = 64 * 1024 * 1024
#: Queries and gallery rows of one matrix product.
QUERY_TILE, GALLERY_TILE = 512, 2048
#: Queries that a block of the gallery is searched for at once.
QUERY_ROWS = 8192
#: Shortlisted pairs above which they are scored; a product's more may be held.
PAIRS = 500_000

_ANSWER = [
    T.StructField("candidate", T.StringType()),
    T.StructField("template_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("tie", T.LongType()),
]


def with_tie_key(templates: DataFrame, tie: str) -> DataFrame:
    """Add ``tie``: the template's own id, or the first template id of its identity."""
    if tie == "template":
        return templates.withColumn("tie", F.col("template_id"))
    if tie != "identity":
        raise ValueError(f"unknown tie rule: {tie!r}")
    first = templates.groupBy("identity").agg(F.min("template_id").alias("tie"))
    return templates.join(first, "identity")


def usable(vector: Column, dim: int) -> Column:
    """True for a finite vector of ``dim`` elements; never NULL."""
    return F.coalesce((F.size(vector) == dim) & is_finite(vector), F.lit(False))


def gallery_dimension(templates: DataFrame) -> int:
    """The dimension of the first template that has a vector; 0 if there is none."""
    first = templates.where(F.size("embedding") > 0).agg(F.min_by(F.size("embedding"), "template_id")).first()[0]
    return int(first or 0)


def quarantined(templates: DataFrame, dim: int | None = None) -> DataFrame:
    """Templates that a search leaves out, with the reason."""
    dim = gallery_dimension(templates) if dim is None else dim
    reason = (
        F.when(F.col("embedding").isNull(), "missing embedding")
        .when(F.size("embedding") != dim, "unexpected dimension")
        .otherwise("non-finite values")
    )
    return templates.where(~usable(F.col("embedding"), dim)).select("template_id", "identity", reason.alias("reason"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a finite vector of ``dim`` elements, and their double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    kept = column.filter(fits)
    values = pc.cast(kept.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a NULL element is NaN
    finite = np.isfinite(values).all(axis=1)
    return np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite], values[finite]


def _exact(queries: np.ndarray, templates: np.ndarray, metric: str) -> np.ndarray:
    """Score of each pair of rows by itself; less is better."""
    if metric == "cosine":
        return -(queries * templates).sum(axis=1)
    return np.sqrt(np.square(queries - templates).sum(axis=1))


class _Rough:
    """Products that shortlist the rows of a gallery, up to a value that is the same for all of them.

    They are single precision where the vectors' sizes allow, at a quarter of the time; the slack allows for it.
    A product has ``QUERY_TILE`` queries and ``GALLERY_TILE`` rows whatever the gallery's size, so that it is still
    in the cache when its least values are looked for. Only queries that come near their best one look again.
    """

    def __init__(self, gallery: np.ndarray, metric: str):
        squares = np.square(gallery).sum(axis=1)
        self.gallery, self.metric, self.squares, self.largest = gallery, metric, squares, squares.max()
        self.single = bool(1e-20 < self.largest < 1e30)
        self.weighted = self._weighted(np.float32 if self.single else np.float64)

    def _weighted(self, kind: type) -> np.ndarray:
        (rows, dim), cosine = self.gallery.shape, self.metric == "cosine"
        weighted = np.empty((rows, dim if cosine else dim + 1), dtype=kind)
        np.multiply(self.gallery, -1.0 if cosine else -2.0, out=weighted[:, :dim], casting="same_kind")
        if not cosine:
            weighted[:, dim] = self.squares
        return weighted.T

    def shortlist(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query and gallery row of each pair that may be a best one within the rounding error.

        They come in parts of bounded size, as very many rows of a gallery may be equal; of a query's parts,
        later ones have later rows.
        """
        own = np.square(queries).sum(axis=1)
        single = self.single and own.max() < 1e30
        kind = np.float32 if single else np.float64
        size = np.sqrt(own * self.largest) if self.metric == "cosine" else own + self.largest
        asked = queries if self.metric == "cosine" else np.column_stack([queries, np.ones(len(queries))])
        asked, weighted = asked.astype(kind), self.weighted if single == self.single else self._weighted(kind)
        # more than both roundings together
        slack = 8 * (self.gallery.shape[1] + 4) * np.finfo(kind).eps * size

        held = np.empty(min(len(queries), QUERY_TILE) * min(weighted.shape[1], GALLERY_TILE), dtype=kind)
        for start in range(0, len(queries), QUERY_TILE):
            rows = slice(start, start + QUERY_TILE)
            least, found = np.full(len(asked[rows]), np.inf, dtype=kind), []
            for at in range(0, weighted.shape[1], GALLERY_TILE):
                tile = weighted[:, at : at + GALLERY_TILE]
                rough = np.matmul(asked[rows], tile, out=held[: len(least) * tile.shape[1]].reshape(len(least), -1))
                here = rough.min(axis=1)
                least = np.minimum(least, here)
                limit = np.nextafter((least + slack[rows]).astype(kind), kind(np.inf))
                near = np.flatnonzero(here <= limit)
                again = rough[near]
                row, col = np.divmod(np.flatnonzero(again <= limit[near, None]), tile.shape[1])
                found.append((near[row], col + at, again[row, col]))
                if sum(len(pair) for pair, _, _ in found) > PAIRS:
                    yield _kept(found, limit, start)
                    found = []
            if found:
                yield _kept(found, limit, start)


def _kept(found: list[tuple], limit: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are still within the limit that their query has by now."""
    rows, cols, values = (np.concatenate(parts) for parts in zip(*found))
    near = values <= limit[rows]
    return rows[near] + start, cols[near]


def _nearest(queries: np.ndarray, rough: _Rough) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact score of the best gallery row per query; of equal scores the first row."""
    chosen, best = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), np.inf)
    for rows, cols in rough.shortlist(queries):
        scores = np.empty(len(rows))
        for i in range(0, len(rows), 65536):
            scores[i : i + 65536] = _exact(queries[rows[i : i + 65536]], rough.gallery[cols[i : i + 65536]], rough.metric)
        order = np.lexsort((cols, scores, rows))
        first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        first = first[scores[first] < best[rows[first]]]
        chosen[rows[first]], best[rows[first]] = cols[first], scores[first]
    return chosen, best


def _unit_rows(matrix: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return matrix
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, sizes, out=matrix.copy(), where=sizes > 0)


class _Best:
    """The best template so far of each query of a batch."""

    def __init__(self, vectors: pa.Array | pa.ChunkedArray, dim: int, metric: str):
        self.metric, self.size = metric, len(vectors)
        self.keep, queries = _matrix(vectors, dim)
        self.queries = _unit_rows(queries, metric)
        self.scores = np.full(len(self.keep), np.inf)
        self.ties = np.zeros(len(self.keep), dtype=np.int64)
        self.ids = np.zeros(len(self.keep), dtype=np.int64)
        self.names = np.empty(len(self.keep), dtype=object)

    def meet(self, block: tuple) -> None:
        rough, names, template_ids, ties = block
        for at in range(0, len(self.keep) if len(ties) else 0, QUERY_ROWS):
            s = slice(at, at + QUERY_ROWS)
            chosen, scores = _nearest(self.queries[s], rough)
            tie, ids = ties[chosen], template_ids[chosen]
            better = (scores < self.scores[s]) | (
                (scores == self.scores[s]) & ((tie < self.ties[s]) | ((tie == self.ties[s]) & (ids < self.ids[s])))
            )
            at_ = np.flatnonzero(better) + at
            self.scores[at_], self.ties[at_], self.ids[at_] = scores[better], tie[better], ids[better]
            self.names[at_] = names.take(pa.array(chosen[better])).to_pylist()

    def answers(self) -> list[pa.Array]:
        """Candidate, template id, score and tie per row; NULL where the row cannot be scored."""
        met = np.isfinite(self.scores)
        at, missing = self.keep[met], np.ones(self.size, dtype=bool)
        missing[at] = False
        out = []
        for values, kind in ((self.names, pa.string()), (self.ids, pa.int64()), (self.scores, pa.float64()), (self.ties, pa.int64())):
            if kind == pa.string():
                whole = np.empty(self.size, dtype=object)
            else:
                whole = np.zeros(self.size, dtype=values.dtype)
            whole[at] = values[met]
            if kind == pa.float64() and self.metric == "cosine":
                whole = -whole
            out.append(pa.array(whole, type=kind, mask=missing))
        return out


def _block(arrays: tuple, metric: str) -> tuple:
    """Arrays of a gallery with what its products need in place of its matrix."""
    matrix, *others = arrays
    return (_Rough(matrix, metric) if len(matrix) else None, *others)


def _gallery_arrays(table: pa.Table, dim: int) -> tuple:
    """Gallery in tie order, so that the first best row is the tie winner."""
    table = table.sort_by([("tie", "ascending"), ("template_id", "ascending")])
    keep, matrix = _matrix(table.column("embedding"), dim)
    names = table.column("identity").combine_chunks().take(pa.array(keep))
    ids = table.column("template_id").to_numpy()[keep]
    return matrix, names, ids, table.column("tie").to_numpy()[keep]


def _groups(batches: Iterator[pa.RecordBatch], at: int, vectors: int) -> Iterator[pa.Table]:
    """Batches put together to at least ``vectors`` rows with a vector in column ``at``, or four times as many rows."""
    held: list[pa.RecordBatch] = []
    rows = found = 0
    for batch in batches:
        held.append(batch)
        rows, found = rows + len(batch), found + len(batch) - batch.column(at).null_count
        if found >= vectors or rows >= 4 * vectors:
            yield pa.Table.from_batches(held)
            held, rows, found = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _search_blocks(queries: DataFrame, blocks: Callable[[], Iterator[tuple]], dim: int, metric: str, query_rows: int) -> DataFrame:
    """One narrow pass: the queries' other columns travel along, so nothing is joined back."""
    kept = [c for c in queries.columns if c != "embedding"]
    schema = T.StructType([queries.schema[c] for c in kept] + _ANSWER)
    names = schema.fieldNames()
    at = queries.columns.index("embedding")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, at, query_rows):
            best = _Best(table.column(at), dim, metric)
            for block in blocks():
                best.meet(block)
            others = [c for i, c in enumerate(table.columns) if i != at]
            yield from pa.Table.from_arrays([*others, *best.answers()], names=names).to_batches(max_chunksize=10_000)

    return queries.mapInArrow(score, schema)


def _shared_block(shared: Broadcast, metric: str) -> Callable[[], Iterator[tuple]]:
    """A function that gives a broadcast gallery as one block, made once in a task."""
    made: list[tuple] = []

    def read() -> Iterator[tuple]:
        if not made:
            made.append(_block(shared.value, metric))
        yield made[0]

    return read


def _written_blocks(gallery: DataFrame, rows: int, block_rows: int, dim: int, metric: str) -> Callable[[], Iterator[tuple]]:
    """Write the gallery as blocks; a function that reads them one by one in a task."""
    path = f"{ensure_checkpoint_dir(gallery.sparkSession)}/gallery-{uuid4().hex}"
    dealt = gallery.repartition(max(1, -(-rows // block_rows)), "template_id")
    dealt.write.option("maxRecordsPerFile", block_rows).parquet(path)
    files = sorted(gallery.sparkSession.read.parquet(path).inputFiles())

    def read() -> Iterator[tuple]:
        for uri in files:
            store, name = filesystem(uri)
            yield _block(_gallery_arrays(pq.read_table(name, filesystem=store), dim), metric)

    return read


def nearest_templates(
    queries: DataFrame,
    templates: DataFrame,
    metric: str = "cosine",
    tie: str = "identity",
    dim: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Best template beside every query: candidate, template_id, score and tie.

    These are NULL for a query without a finite vector of the gallery's dimension. ``dim`` states that
    dimension, and templates of another one are left out (``quarantined`` lists them); unless it is
    stated, a gallery with vectors of several dimensions is refused. Every row is answered by itself:
    other columns, ids among them, may be NULL or repeat.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric!r}")
    sizes = templates.groupBy(F.size("embedding").alias("dim")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("template_id").alias("first"), F.sum(F.octet_length("identity")).alias("names")
    )
    present = sizes.where("dim > 0" if dim is None else F.col("dim") == dim).orderBy("dim").limit(2).collect()
    if len(present) > 1:
        raise ValueError(f"vectors of several dimensions in the gallery ({present[0]['dim']}, {present[1]['dim']}, ...): state dim")
    if not present:
        return queries.drop("embedding").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _ANSWER])
    rows, dim = int(present[0]["rows"]), int(present[0]["dim"])
    kept = templates.select("template_id", "identity", "embedding").where(usable(F.col("embedding"), dim))
    gallery = with_tie_key(kept, tie)
    query_rows = max(1, QUERY_BYTES // (dim * 8))
    # the matrix and its Arrow form, ids and ties, names twice as well
    if 2 * (rows * (dim * 8 + 32) + int(present[0]["names"] or 0)) <= broadcast_bytes:
        shared = queries.sparkSession.sparkContext.broadcast(_gallery_arrays(gallery.toArrow(), dim))
        return _search_blocks(queries, _shared_block(shared, metric), dim, metric, 1)
    blocks = _written_blocks(gallery, rows, max(1, chunk_bytes // (dim * 8)), dim, metric)
    return _search_blocks(queries, blocks, dim, metric, query_rows)


def _decide(found: DataFrame, accepted: Column, empty_score: float, open_set: bool) -> DataFrame:
    """Turn best templates into decisions; queries without one get the 'no match' answer."""
    keep = [c for c in found.columns if c not in {f.name for f in _ANSWER}]
    ok = F.coalesce(accepted & ~F.isnan("score"), F.lit(False))
    rejected = F.lit(None).cast("string") if open_set else F.lit("Unknown")
    answer = [F.when(ok, F.col("candidate")).otherwise(rejected).alias("identity")]
    if open_set:
        answer.append(F.coalesce(F.col("candidate"), F.lit("Unknown")).alias("best_candidate"))
    return found.select(*keep, *answer, F.coalesce("score", F.lit(empty_score)).alias("score"), ok.alias("recognized"))


def search(queries: DataFrame, templates: DataFrame, threshold: float = COSINE_THRESHOLD, **options) -> DataFrame:
    """Open-set cosine search: best identity per query, accepted at ``score >= threshold``.

    Rejected queries keep ``best_candidate`` and score with a NULL identity. Ties go to the
    identity whose first template came first. Queries that cannot be scored, and any query
    against an empty gallery, give (NULL, 'Unknown', -1.0, false).
    """
    found = nearest_templates(queries, templates, "cosine", "identity", **options)
    return _decide(found, F.col("score") >= threshold, -1.0, open_set=True)


def match_euclidean(queries: DataFrame, templates: DataFrame, threshold: float, **options) -> DataFrame:
    """Nearest template by distance, accepted at ``distance <= threshold``, else 'Unknown'."""
    found = nearest_templates(queries, templates, "euclidean", "template", **options)
    return _decide(found, F.col("score") <= threshold, float("inf"), open_set=False)


def match_cosine(queries: DataFrame, templates: DataFrame, threshold: float, **options) -> DataFrame:
    """Most similar template, normalised first, accepted at ``score >= threshold``, else 'Unknown'."""
    unit = templates.withColumn("embedding", normalise(F.col("embedding")))
    found = nearest_templates(queries, unit, "cosine", "template", **options)
    return _decide(found, F.col("score") >= threshold, -1.0, open_set=False)


def centres(templates: DataFrame) -> DataFrame:
    """Mean vector and first template id of each identity."""
    first = templates.groupBy("identity").agg(F.min("template_id").alias("template_id"))
    return centroids(templates).join(first, "identity")


def match_centroid(
    queries: DataFrame, centre_rows: DataFrame, threshold: float = COSINE_THRESHOLD, **options
) -> DataFrame:
    """Most similar class centre, accepted at ``score >= threshold``.

    ``centre_rows`` has identity, embedding and template_id, the first template of the identity
    (``centres`` makes such a table): ties go to the centre that was enrolled first.
    """
    found = nearest_templates(queries, centre_rows, "cosine", "template", **options)
    return _decide(found, F.col("score") >= threshold, -1.0, open_set=True)


def match_detections(detections: DataFrame, templates: DataFrame, threshold: float, **options) -> DataFrame:
    """Euclidean match of every detection of an image on its own.

    ``detections`` has one row per image with an array of (det_idx, embedding) structs.
    """
    one = detections.select("image_id", F.explode("detections").alias("_d")).select(
        "image_id", F.col("_d.det_idx").alias("det_idx"), F.col("_d.embedding").alias("embedding")
    )
    keyed = one.withColumn("query_id", F.struct("image_id", "det_idx"))
    return match_euclidean(keyed, templates, threshold, **options).drop("query_id")


# Upkeep


def template_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("identity").agg(F.count(F.lit(1)).alias("template_count")).orderBy("identity")


def gallery_summary(templates: DataFrame) -> DataFrame:
    return templates.agg(
        F.count(F.lit(1)).alias("total_templates"), F.countDistinct("identity").alias("unique_identities")
    )


def build_report(vectors: DataFrame) -> DataFrame:
    """Templates added and inputs skipped (no vector) per identity."""
    return vectors.groupBy("identity").agg(
        F.count("embedding").alias("templates_added"), F.count_if(F.col("embedding").isNull()).alias("skipped")
    )


def validate(templates: DataFrame, dim: int) -> DataFrame:
    """One-row integrity report with an array of errors, from one pass over the gallery."""
    v = F.col("embedding")
    size = norm(v)
    facts = templates.agg(
        F.count(F.lit(1)).alias("total_templates"),
        F.countDistinct("identity").alias("unique_identities"),
        F.count_if(v.isNull() | F.col("identity").isNull()).alias("_missing"),
        F.count_if(v.isNotNull() & ~is_finite(v)).alias("_non_finite"),
        F.count_if(F.abs(size - 1.0) > 1e-3 + 1e-5).alias("_not_unit"),
        F.count_if(F.size(v) != dim).alias("_wrong_dim"),
        F.min(size).alias("min_norm"),
        F.max(size).alias("max_norm"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("_missing") > 0, F.lit("missing embedding or identity")),
            F.when(F.col("_non_finite") > 0, F.lit("non-finite values")),
            F.when(F.col("_not_unit") > 0, F.lit("not unit normalised")),
            F.when(F.col("_wrong_dim") > 0, F.lit("unexpected dimension")),
        )
    )
    return facts.select(
        (F.size(errors) == 0).alias("valid"),
        "total_templates",
        "unique_identities",
        "min_norm",
        "max_norm",
        errors.alias("errors"),
    )


def add_templates(templates: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Gallery with new vectors normalised and numbered after the present ones.

    ``new`` has ``template_id`` starting from 1 in insertion order; vectors of the wrong
    dimension fail the job.
    """
    last = templates.agg(F.coalesce(F.max("template_id"), F.lit(0))).scalar()
    fits = F.size("embedding") == dim
    checked = F.when(fits, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("vector dimension differs from "), F.lit(dim)))
    )
    added = new.select(
        (F.col("template_id") + last).alias("template_id"),
        "identity",
        normalise(checked).cast("array<float>").alias("embedding"),
    )
    return templates.select("template_id", "identity", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(added)


def remove_identity(templates: DataFrame, identity: str) -> DataFrame:
    return templates.where(F.col("identity") != identity)


def removed_count(templates: DataFrame, identity: str) -> DataFrame:
    return templates.agg(F.count_if(F.col("identity") == identity).alias("removed"))
