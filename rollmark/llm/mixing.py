"""Mixing sources to target weights along a time-varying curriculum; DataFrame operations only.

Each source has a weight and a schedule, its weight's course over the training run. The weights give
the source's target of words, capped at a number of passes. Within a source documents come in a
hashed order, pass after pass; the words before a document, as a share of the target, are the
cumulative demand at which it is due, and inverting the integral of the schedule gives the moment,
its position. Range-sorting by position gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.operators.ordering import ROWS_PER_CELL, cut, positions as place_in_group, running_totals

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: How often a source's words are taken at most.
PASSES = 2
#: Parts that a source's documents are hashed into, so that running sums never sort a source in one task.
PARTS = 4096
#: (moment, weight relative to the mean) of the schedules, by the order of the sources, repeating:
#: early sources fade, late ones grow, the third kind peaks halfway. Weights are linear between moments.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Add ``place`` and ``target`` to one row per source (``source, source_size``).

    Sources share ``share`` times all words by weight; what is above ``passes`` times a source's size
    is shared among the others by weight, until none is above. So with sources in the order of
    capacity per weight, the first ones are filled and the others share the rest, from the first
    one on whose part is no more than it holds.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    capacity = passes * F.col("source_size")
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("capacity", capacity)
    by_fill = Window.orderBy(F.col("capacity") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.select(
        "source",
        "source_size",
        "place",
        "weight",
        "capacity",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("filled"),
        F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("weights"),
        F.sum("source_size").over(everything).alias("all_words"),
        F.row_number().over(by_fill).alias("turn"),
    )
    level = (share * F.col("all_words") - F.col("filled")) / F.col("weights")
    open_ = F.when(level * F.col("weight") <= F.col("capacity"), F.col("turn"))
    rows = rows.withColumn("level", level).withColumn("first", F.min(open_).over(everything))
    rows = rows.withColumn("rate", F.max(F.when(F.col("turn") == F.col("first"), F.col("level"))).over(everything))
    full = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    target = F.when(full, F.col("capacity").cast("double")).otherwise(F.col("rate") * F.col("weight"))
    return rows.select("source", "source_size", F.col("place").cast("int").alias("place"), target.alias("target"))


def position(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The moment (0 to 1) at which a source's schedule has used up ``share`` of its demand.

    The weight is linear between the moments of a schedule, so its integral is a parabola there; the
    parabola is inverted in the piece that holds the demand.
    """
    out = None
    for kind, knots in enumerate(schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[:-1], knots[1:], strict=True)]
        whole, used, inverse = sum(areas), 0.0, None
        pieces = list(zip(knots[:-1], knots[1:], areas, strict=True))
        for number, ((t0, w0), (t1, w1), area) in enumerate(pieces):
            demand = F.greatest(share * whole - used, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * demand, F.lit(0.0)))
            moment = F.least(F.lit(t0) + 2 * demand / (root + w0), F.lit(t1))
            used += area
            if number == len(pieces) - 1:
                inverse = moment if inverse is None else inverse.otherwise(moment)
            else:
                inverse = (F if inverse is None else inverse).when(share * whole <= used, moment)
        out = (F if out is None else out).when(place % len(schedules) == kind, inverse)
    return out


def mix_sizes(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    parts: int = PARTS,
    schedules=SCHEDULES,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, positions``.

    ``size`` is the words of the text (null: 0). A source takes its documents in the order of the md5
    of their ids, then once more, until its target is reached; the document in which that happens is
    taken in part, so the taken words of a source are its target to the word (rounded down).
    ``positions`` holds the moments (0 to 1) at which a document's passes are due; it is empty for
    documents that aren't taken or have no words. A null source is a source of its own. Rows may
    repeat, and each counts; null ids are hashed like a text of their own. An empty table gives an
    empty result.
    """
    return _deal(_keyed(docs), weights, share, passes, parts, schedules, rows_per_cell).drop("key")


def _deal(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    parts: int = PARTS,
    schedules=SCHEDULES,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``mix_sizes`` of ``doc_id, source, text, tie, key``, with each row's ``key``.

    Rows of one id and size are dealt in the order of ``tie``, then of the key. All rows of an id are
    in one part; if that makes it hot, it is cut into cells.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "mixing")
    sized = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("turn"),
        "tie",
        "key",
    )

    def digits(first: int, n: int) -> Column:
        return F.conv(F.substring("turn", first, n), 16, 10).cast("long")

    # the turn as numbers, by which cells can be cut; keys are written, so they don't change
    part = F.pmod(digits(1, 8), F.lit(parts)).cast("int")
    sized = sized.select("doc_id", "source", "size", "tie", "key", part.alias("part"), *(digits(a, n).alias(f"turn{a}") for a, n in ((1, 15), (16, 15), (31, 2))))
    sized = scratch.table(sized, "sized")
    by_part = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    per_source = by_part.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = targets(per_source, weights, share, passes)
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_part = by_part.select("source", "part", F.coalesce(before, F.lit(0)).alias("earlier"))
    # a row for each source and part: at most `parts` times the number of sources
    frame = by_part.join(goals.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    frame = scratch.table(frame, "frame").select(F.col("source").alias("its"), F.col("part").alias("its_part"), "earlier", "source_size", "target", "place")

    ties = ["turn16", "turn31", "doc_id", "size", "tie", "key"]
    ordered = cut(sized, ["source", "part"], "turn1", rows_per_cell, ties)
    placed = running_totals(ordered, {"upto": F.col("size")}, ties).rows().withColumn("within", F.col("upto") - F.col("size"))
    placed = placed.join(frame, F.col("source").eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")))
    start = F.col("earlier") + F.col("within")
    goal = F.floor("target")

    def words(number: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), goal - start - number * F.col("source_size")))

    def moment(number: int) -> Column:
        return F.when(words(number) > 0, position((start + number * F.col("source_size")) / F.col("target"), F.col("place"), schedules))

    taken = sum((words(n) for n in range(1, passes)), words(0))
    return placed.select(
        "key",
        "doc_id",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.array_compact(F.array(*(moment(n) for n in range(passes)))).alias("positions"),
    )


def _placed(due: DataFrame) -> DataFrame:
    """Add ``place``, the number from 1 of each row of ``due`` along the run, by ``position, doc_id, size, pass, key``.

    Moments are numbered within equal parts of the run and the parts are added up, so no task sorts all of it.
    """
    names = due.columns
    due = due.withColumn("moment", F.least(F.floor(F.col("position") * PARTS), F.lit(PARTS - 1)).cast("int"))
    due = Scratch(due.sparkSession, "mixing").table(due, "due")
    ranked = place_in_group(due, ["moment"], "position", "within", ["doc_id", "size", "pass", "key"])
    # a row for each part of the run
    counts = due.groupBy("moment").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("moment").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select(F.col("moment").alias("its"), F.coalesce(before, F.lit(0)).alias("earlier"))
    ranked = ranked.join(F.broadcast(earlier), F.col("moment") == F.col("its"))
    return ranked.select(*names, (F.col("earlier") + F.col("within")).alias("place"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("key"))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The schedule of the training run: ``doc_id, size, pass, position, place``, a row per pass taken.

    ``pass`` counts from 0, ``position`` is the moment (0 to 1) at which it is due and ``place`` its
    number, from 1, when all passes are sorted by moment, id, size and pass.
    """
    due = _deal(_keyed(docs), **options).select("key", "doc_id", "size", F.posexplode("positions").alias("pass", "position"))
    return _placed(due).select("doc_id", "size", "pass", "position", "place")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """``mix_sizes`` with ``first_position``, ``last_position`` and ``place`` instead of the list of positions.

    ``place`` is where the first pass of a document stands when the passes of all are range-sorted by
    the moment they are due; the three are null for documents that the mix doesn't take.
    """
    dealt = Scratch(docs.sparkSession, "mixing").table(_deal(_keyed(docs), **options), "dealt")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    ends = F.try_element_at("positions", F.lit(1)).alias("first_position"), F.try_element_at("positions", F.lit(-1)).alias("last_position")
    due = dealt.select(*names, *ends, "key", F.posexplode("positions").alias("pass", "position"))
    mixed = _placed(due).filter(F.col("pass") == 0)
    left = dealt.filter(F.size("positions") == 0).select(*names, *ends, F.lit(None).cast("long").alias("place"))
    return mixed.select(*left.columns).unionByName(left)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of training: a row for each pass in which it is taken.

    Each row gets a key that is written with it, and what is due is joined by that key, so rows that
    share an id, or have none, are no group. Documents without words are in no mix and stay once, at
    the end: nothing can weigh them.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "mixing")
    renamed = [f"c{i}" for i in range(len(names))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(names, renamed, strict=True)), F.monotonically_increasing_id().alias("key"))
    keyed = scratch.table(keyed, "keyed")
    of = dict(zip(names, renamed, strict=True))
    rows = keyed.select(*(F.col(of[c]).alias(c) for c in ("doc_id", "source", "text")), F.xxhash64(*renamed).alias("tie"), "key")
    moments = F.when(F.col("size") == 0, F.array(F.lit(1.0))).otherwise(F.col("positions"))
    due = _deal(rows, **options).select(F.col("key").alias("its"), F.col("doc_id").alias("own_id"), F.explode(moments).alias("due"))
    due = scratch.table(due, "due")
    kept = keyed.join(due, F.col("key") == F.col("its")).orderBy("due", "own_id", "key")
    return kept.select(*(F.col(r).alias(c) for r, c in zip(renamed, names, strict=True)))


#: Target, taken words and sizes as DuckDB SQL.
SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS turn
  FROM documents),
numbered AS (
  SELECT *, (('0x' || substr(turn, 1, 8))::BIGINT % 4096) AS part FROM sized),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place % 3 + 1] AS weight, 2 * source_size AS capacity FROM per_source),
filling AS (
  SELECT *, coalesce(sum(capacity) OVER (ORDER BY capacity / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         sum(weight) OVER (ORDER BY capacity / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         sum(source_size) OVER ()::BIGINT AS all_words,
         row_number() OVER (ORDER BY capacity / weight, place) AS turn_no
  FROM weighed),
levelled AS (
  SELECT *, (1.5::DOUBLE * all_words - filled) / weights AS level FROM filling),
opened AS (
  SELECT *, min(CASE WHEN level * weight <= capacity THEN turn_no END) OVER () AS first_no FROM levelled),
rated AS (
  SELECT *, max(CASE WHEN turn_no = first_no THEN level END) OVER () AS rate FROM opened),
goals AS (
  SELECT source, source_size, place,
         CASE WHEN first_no IS NULL OR turn_no < first_no THEN capacity::DOUBLE ELSE rate * weight END AS target
  FROM rated),
placed AS (
  SELECT n.doc_id, n.size, g.source_size, g.target, g.place % 3 AS kind,
         coalesce(sum(n.size) OVER (PARTITION BY n.source ORDER BY n.part, n.turn, n.doc_id, n.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM numbered n JOIN goals g ON n.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT p.*, n AS pass, greatest(0, least(size, floor(target)::BIGINT - start - n * source_size))::BIGINT AS words,
         (start + n * source_size)::DOUBLE / target AS share
  FROM placed p, (VALUES (0), (1)) t(n)),
pieces AS (
  SELECT *, CASE WHEN kind = 2 AND share > 0.5::DOUBLE THEN greatest(share - 0.5::DOUBLE, 0.0::DOUBLE) ELSE greatest(share, 0.0::DOUBLE) END AS demand,
         CASE WHEN kind = 2 AND share > 0.5::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS t0,
         CASE WHEN kind = 2 AND share <= 0.5::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS t1,
         CASE WHEN kind = 0 OR (kind = 2 AND share > 0.5::DOUBLE) THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE WHEN kind = 0 THEN -2.0::DOUBLE WHEN kind = 1 THEN 2.0::DOUBLE WHEN share <= 0.5::DOUBLE THEN 4.0::DOUBLE ELSE -4.0::DOUBLE END AS twice_slope
  FROM passes),
due AS (
  SELECT *, CASE WHEN words > 0 THEN least(t0 + demand * 2::DOUBLE / (sqrt(greatest(w0 * w0 + demand * twice_slope, 0.0::DOUBLE)) + w0), t1) END AS position
  FROM pieces),
ranked AS (SELECT doc_id, size, row_number() OVER (ORDER BY position, doc_id, size, pass) AS place, pass FROM due WHERE words > 0)
SELECT d.doc_id, d.size, d.source_size, d.target, sum(d.words)::BIGINT AS taken,
       min(d.position) FILTER (WHERE d.pass = 0) AS first_position,
       coalesce(max(d.position) FILTER (WHERE d.pass = 1), max(d.position)) AS last_position, any_value(r.place) AS place
FROM due d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.size = d.size AND r.pass = 0
GROUP BY d.doc_id, d.size, d.source_size, d.target, d.start
"""
