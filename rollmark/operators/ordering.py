"""Ordered computations that stay distributed when one group holds most of the rows.

A window over a hot group, or over the whole table, would sort all of it in one task.
``cut`` looks for groups above ``rows_per_cell`` rows. Without any, plain windows do. A hot
group is cut into order-preserving cells at its own quantiles, so outliers don't matter; a
cell that is still too large is cut again, and one that holds a single value is cut at the
quantiles of the tie columns. Windows then run per (group, cell), and the cells are stitched
together with a small table of one row per cell, joined by size as Spark finds it. NULL is a
group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.session import materialize

ROWS_PER_CELL = 1_000_000
#: Parts into which a hot group or cell is cut at once.
PARTS = 256
#: How many times more parts than its rows ask for a cell is cut into, up to all.
SPARE = 8
#: How often cells are cut again: 256 to the third is more cells than rows allow tasks.
ROUNDS = 3


def hash60(*parts: str | Column) -> Column:
    """Non-negative 60-bit hash that any SQL engine with md5 can reproduce."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Cut:
    """Rows with their grouping and order; ``hot`` if ``_cell`` and ``_hot`` columns were added."""

    df: DataFrame
    group_cols: tuple[str, ...]
    order_col: str
    hot: bool

    @property
    def keys(self) -> list[str]:
        return [*self.group_cols, "_cell"] if self.hot else list(self.group_cols)

    def rows(self) -> DataFrame:
        return self.df.drop("_cell", "_hot") if self.hot else self.df


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where NULL equals NULL; the keys come from the left."""
    if not keys:
        raise ValueError("no keys to join on")
    named = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    return left.join(named, on, how).drop(*(f"_right_{i}" for i in range(len(keys))))


def _with_part(rows: DataFrame, value: Column) -> DataFrame:
    """Add ``_part``: how many of the row's ``_edges`` are at or below ``value``; 0 where there are no edges.

    A binary search in one column per step, so that each row makes a few comparisons in compiled code.
    """
    placed = rows.withColumn("_value", value).withColumn("_part", F.lit(0))
    step = PARTS // 2
    while step:
        found = F.get("_edges", F.col("_part") + (step - 1)) <= F.col("_value")
        placed = placed.withColumn("_part", F.col("_part") + F.when(found, step).otherwise(0))
        step //= 2
    return placed.drop("_value")


def _hot_groups(df: DataFrame, group_cols: Sequence[str], rows_per_cell: int) -> DataFrame:
    """Groups of more rows than a cell has, with their number ``_n``."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_cell)


def cut(
    df: DataFrame, group_cols: Sequence[str], order_col: str, rows_per_cell: int = ROWS_PER_CELL, tie_cols: Sequence[str] = ()
) -> Cut:
    """Find hot groups of ``df`` and, if there are any, add their cells.

    ``df`` is read once to count. If there is a hot group, it is read three times more and written once with
    its cells; what follows, more rounds of cutting among it, reads that.
    Columns that are no numbers can't be cut by; a cell of equal values of all that can stays whole.
    """
    groups = tuple(group_cols)
    hot = _hot_groups(df, groups, rows_per_cell)
    if not hot.limit(1).count():  # nearly always so: nothing is written for the question
        return Cut(df, groups, order_col, False)
    hot = materialize(hot)
    if groups:
        celled = join_groups(df, hot.drop("_n").withColumn("_hot", F.lit(True)), groups, "left")
        celled = celled.withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn("_cell", F.lit(0).cast("bigint"))
    else:
        celled = df.withColumns({"_hot": F.lit(True), "_cell": F.lit(0).cast("bigint")})
    numbers = {"timestamp", "date", "timestamp_ntz"}
    numeric = [c for c in (order_col, *tie_cols) if dict(df.dtypes)[c] not in ("string", "binary", "boolean") and "<" not in dict(df.dtypes)[c]]

    def as_double(name: str) -> Column:
        plain = F.unix_micros(F.col(name).cast("timestamp")) if dict(df.dtypes)[name] in numbers else F.col(name)
        return plain.cast("double")

    keys = [*groups, "_cell"]
    shares = [k / PARTS for k in range(1, PARTS)]
    for level in range(ROUNDS if numeric else 0):
        lows = [F.min(as_double(c)).alias(f"_lo{i}") for i, c in enumerate(numeric)]
        highs = [F.max(as_double(c)).alias(f"_hi{i}") for i, c in enumerate(numeric)]
        sizes = celled.where("_hot").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *lows, *highs)
        # the first column whose values differ within the cell
        by = F.coalesce(*(F.when(F.col(f"_lo{i}") < F.col(f"_hi{i}"), F.lit(i)) for i in range(len(numeric))))
        large = sizes.where(F.col("_n") > rows_per_cell).withColumn("_by", by).where("_by IS NOT NULL")
        large = materialize(large.select(*keys, "_by", "_n"))
        if large.isEmpty():
            break
        wanted = join_groups(celled.where("_hot"), large, keys)
        value = F.coalesce(*(F.when(F.col("_by") == i, as_double(c)) for i, c in enumerate(numeric)))
        wanted = wanted.select(*keys, "_by", "_n", value.alias("_value"))
        edges = wanted.groupBy(*keys, "_by", "_n").agg(F.percentile_approx("_value", shares, 10 * PARTS).alias("_edges"))
        # every edge of a very large cell, fewer of one that is soon small enough
        stride = F.greatest(F.lit(1), F.floor(F.lit(PARTS) / (SPARE * F.ceil(F.col("_n") / F.lit(rows_per_cell)))))
        kept = F.filter("_edges", lambda e, i: (i + 1) % stride == 0)
        edges = materialize(edges.select(*keys, "_by", F.array_sort(F.array_distinct(kept)).alias("_edges")))
        # NULL values have part 0: they come first in ascending order, as in the windows below
        celled = _with_part(join_groups(celled, edges, keys, "left"), value)
        celled = celled.withColumn("_cell", F.col("_cell") * PARTS + F.col("_part").cast("bigint"))
        celled = materialize(celled.select(*df.columns, "_cell", "_hot"))
    return Cut(celled.select(*df.columns, "_cell", "_hot"), groups, order_col, True)


def _order(rows: Cut, tie_cols: Sequence[str], descending: bool) -> list[Column]:
    cols = [F.col(c) for c in (rows.order_col, *tie_cols)]
    return [c.desc() if descending else c.asc() for c in cols]


def _cell_order(descending: bool) -> Column:
    return F.col("_cell").desc() if descending else F.col("_cell").asc()


def running_totals(
    rows: Cut, sums: Mapping[str, Column], tie_cols: Sequence[str] = (), descending: bool = False
) -> Cut:
    """Add inclusive running sums per group in the given order."""
    local = (
        Window.partitionBy(*rows.keys)
        .orderBy(*_order(rows, tie_cols, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not rows.hot:
        summed = rows.df.select("*", *[F.sum(expr).over(local).alias(name) for name, expr in sums.items()])
        return replace(rows, df=summed)
    before = (
        Window.partitionBy(*rows.group_cols)
        .orderBy(_cell_order(descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.df.where("_hot")
        .groupBy(*rows.keys)
        .agg(*[F.sum(expr).alias(f"_o_{name}") for name, expr in sums.items()])
        .select(*rows.keys, *[F.sum(f"_o_{name}").over(before).alias(f"_o_{name}") for name in sums])
    )
    summed = (
        rows.df.select("*", *[F.sum(expr).over(local).alias(f"_l_{name}") for name, expr in sums.items()])
        .transform(lambda d: join_groups(d, offsets, rows.keys, "left"))
        .select(
            *rows.df.columns,
            *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
        )
    )
    return replace(rows, df=summed)


def neighbour(
    rows: Cut,
    values: Mapping[str, str],
    tie_cols: Sequence[str] = (),
    descending: bool = False,
    following: bool = True,
) -> Cut:
    """Add values of the next (or previous) row in the group; maps new name to column."""
    step = F.lead if following else F.lag
    local = Window.partitionBy(*rows.keys).orderBy(*_order(rows, tie_cols, descending))
    if not rows.hot:
        near = rows.df.select("*", *[step(src).over(local).alias(name) for name, src in values.items()])
        return replace(rows, df=near)
    edge = F.min_by if following != descending else F.max_by
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    edges = (
        rows.df.where("_hot")
        .groupBy(*rows.keys)
        .agg(edge(packed, F.struct(rows.order_col, *tie_cols)).alias("_edge"))
        .select(
            *rows.keys,
            step("_edge").over(Window.partitionBy(*rows.group_cols).orderBy(_cell_order(descending))).alias("_edge"),
        )
    )
    near = (
        rows.df.select("*", step(packed).over(local).alias("_near"))
        .transform(lambda d: join_groups(d, edges, rows.keys, "left"))
        .select(*rows.df.columns, F.coalesce("_near", "_edge").alias("_near"))
        .select(*rows.df.columns, *[F.col(f"_near.{name}").alias(name) for name in values])
    )
    return replace(rows, df=near)


def positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    out: str,
    tie_cols: Sequence[str] = (),
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """1-based position of each row in its group: ``row_number`` that survives hot groups.

    With a hot group, all rows are sorted into ranges and written once in that order. A row's position is
    its place in its range plus an offset of its group there, from a table of one row per group and range.
    """
    if not _hot_groups(df, group_cols, rows_per_cell).limit(1).count():
        rows = Cut(df, tuple(group_cols), order_col, False)
        return running_totals(rows, {out: F.lit(1).cast("bigint")}, tie_cols).rows()
    keys = [*group_cols, order_col, *tie_cols]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.select("*", F.monotonically_increasing_id().alias("_place")))
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    where = [*group_cols, "_range"]
    sizes = placed.groupBy(*where).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = materialize(sizes.select(*where, offset.alias("_offset")))
    numbered = join_groups(placed, offsets, where, "left")
    return numbered.select(*df.columns, (F.col("_place") + F.col("_offset")).alias(out))


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Mapping[str, float],
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``probs``.

    Works on distinct values with counts and their running totals, so no task holds all
    values of a group as the built-in exact ``percentile`` would.
    """
    counted = materialize(
        df.groupBy(*group_cols, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running_totals(cut(counted, group_cols, "_v", rows_per_cell), {"_cum": F.col("_c")}).rows()
    totals = counted.groupBy(*group_cols).agg(F.sum("_c").alias("_total"))
    if group_cols:
        ranked = join_groups(ranked, totals, group_cols)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_cum") - F.col("_c")) & (rank < F.col("_cum"))

    picks = []
    for name, prob in probs.items():
        rank = (F.col("_total") - 1) * F.lit(float(prob))
        picks += [
            F.max(F.when(holds(F.floor(rank)), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(rank)), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_fr_{name}"),
        ]
    return (
        ranked.groupBy(*group_cols)
        .agg(*picks)
        .select(
            *group_cols,
            *[
                (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
                for n in probs
            ],
        )
    )


def with_halo(df: DataFrame, position_col: str, chunk_rows: int, halo: int) -> DataFrame:
    """Cut a numbered sequence into chunks; each also gets the last ``halo`` rows before it.

    Adds ``_chunk`` and ``_halo``. Windows of up to ``halo + 1`` rows can then run per
    (sequence, chunk) with the answer they would give over the whole sequence. Positions
    are 1-based and dense, and ``halo`` must be below ``chunk_rows``.
    """
    if halo >= chunk_rows:
        raise ValueError("halo must be smaller than chunk_rows")
    zero = F.col(position_col) - 1
    chunk = F.floor(zero / F.lit(chunk_rows)).cast("bigint")
    late = F.pmod(zero, F.lit(chunk_rows)) >= F.lit(chunk_rows - halo)
    homes = F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = df.select("*", F.explode(homes).alias("_chunk"))
    return spread.withColumn("_halo", F.col("_chunk") != chunk)
