"""Verification pairs: construction, scoring, splits and sampling.

Random choices are seeded hashes (``hash60``), so a lost task makes the same choice again
and another engine can reproduce it. Pairs inside an identity are drawn by pair number and
never listed first, so an identity with a third of all members costs no more than its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.functions.vectors import score
from rollmark.operators.ordering import ROWS_PER_CELL, hash60, positions
from rollmark.session import BROADCAST_BYTES, broadcast_if_small, broadcast_vectors

#: Pair caps, split rule and band width.
MAX_GENUINE_PER_IDENTITY = 150
MAX_IMPOSTOR_PAIRS = 50_000
BAND = 9
MIN_ITEMS, ENROLLMENT_ITEMS, VALIDATION_SHARE = 20, 2, 0.5


def score_pairs(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Score pairs (key1, key2) by joining their vectors; a missing vector fails the pair only."""
    side = broadcast_vectors(vectors.select(F.col("key").alias("_k"), F.col("embedding").alias("_v")), "_v", broadcast_bytes)
    left = side.withColumnsRenamed({"_k": "key1", "_v": "_v1"})
    right = side.withColumnsRenamed({"_k": "key2", "_v": "_v2"})
    joined = pairs.join(left, "key1", "left").join(right, "key2", "left")
    both = F.col("_v1").isNotNull() & F.col("_v2").isNotNull()
    return joined.select(
        *pairs.columns,
        F.when(both, score(F.col("_v1"), F.col("_v2"), metric)).alias("raw_score"),
        F.lit("similarity" if metric == "cosine" else "distance").alias("score_direction"),
        F.when(both, F.lit("success")).otherwise(F.lit("failed_embedding")).alias("status"),
    )


def seeded_positions(
    members: DataFrame, seed: int, out: str = "pos", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Number the members (identity, key) of each identity from 1 in a seeded random order."""
    hashed = members.withColumn("_h", hash60(F.lit(seed), F.col("identity"), F.col("key")))
    return positions(hashed, ["identity"], "_h", out, ["key"], rows_per_cell).drop("_h")


def genuine_pairs(
    members: DataFrame,
    cap: int = MAX_GENUINE_PER_IDENTITY,
    seed: int = 42,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Unordered pairs inside each identity, at most ``cap`` of them drawn without replacement.

    Pair number t stands for positions (i, j), i < j, t = j(j-1)/2 + i. A large identity is
    cut into ``cap`` equal strata of pair numbers and one number is hashed from each.
    """
    placed = seeded_positions(members.select("identity", "key"), seed, "pos", rows_per_cell)
    sizes = members.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    total = F.expr("n * (n - 1) div 2")
    strata = (
        sizes.withColumn("total", total)
        .withColumn("drawn", F.least("total", F.lit(cap)))
        .select("identity", "total", "drawn", F.explode(F.expr("sequence(0L, drawn - 1)")).alias("k"))
        .withColumn("base", F.expr("total div drawn"))
        .withColumn("longer", F.expr("total % drawn"))
        .withColumn("start", F.expr("k * base + least(k, longer)"))
        .withColumn("width", F.expr("base + if(k < longer, 1, 0)"))
        .withColumn("t", F.col("start") + F.pmod(hash60(F.lit(seed), F.lit("g"), F.col("identity"), F.col("k")), F.col("width")))
    )
    numbered = (
        strata.withColumn("_j", F.floor((1 + F.sqrt(1 + 8 * F.col("t").cast("double"))) / 2).cast("bigint"))
        .withColumn("j", F.expr("case when _j * (_j - 1) div 2 > t then _j - 1 when _j * (_j + 1) div 2 <= t then _j + 1 else _j end"))
        .withColumn("i", F.expr("t - j * (j - 1) div 2"))
    )
    first = placed.select("identity", (F.col("pos") - 1).alias("i"), F.col("key").alias("key1"))
    second = placed.select("identity", (F.col("pos") - 1).alias("j"), F.col("key").alias("key2"))
    return (
        numbered.select("identity", "i", "j")
        .join(first, ["identity", "i"])
        .join(second, ["identity", "j"])
        .select(
            F.col("identity").alias("identity1"),
            F.col("identity").alias("identity2"),
            F.least("key1", "key2").alias("key1"),
            F.greatest("key1", "key2").alias("key2"),
            F.lit(1).alias("is_same"),
        )
    )


def impostor_pairs(
    members: DataFrame, n: int = MAX_IMPOSTOR_PAIRS, seed: int = 42, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """``n`` draws of two different identities and one member of each, with replacement."""
    spark = members.sparkSession
    placed = seeded_positions(members.select("identity", "key"), seed, "pos", rows_per_cell)
    sizes = members.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    named = positions(
        sizes.withColumn("_h", hash60(F.lit(seed), F.col("identity"))), (), "_h", "idx", ["identity"], rows_per_cell
    ).select((F.col("idx") - 1).alias("idx"), "identity", "n")
    groups = sizes.agg(F.count(F.lit(1))).scalar()

    def draw(tag: str) -> Column:
        return hash60(F.lit(seed), F.lit(tag), F.col("pair_id"))

    drawn = (
        spark.range(1, n + 1)
        .withColumnRenamed("id", "pair_id")
        .withColumn("groups", groups)
        .where("groups >= 2")
        .withColumn("idx1", F.pmod(draw("a"), F.col("groups")))
        .withColumn("idx2", F.pmod(F.col("idx1") + 1 + F.pmod(draw("b"), F.col("groups") - 1), F.col("groups")))
    )
    for side in ("1", "2"):
        names = named.select(
            F.col("idx").alias(f"idx{side}"), F.col("identity").alias(f"identity{side}"), F.col("n").alias(f"n{side}")
        )
        spots = placed.select(
            F.col("identity").alias(f"identity{side}"), F.col("pos").alias(f"pos{side}"), F.col("key").alias(f"key{side}")
        )
        drawn = (
            drawn.join(names, f"idx{side}")
            .withColumn(f"pos{side}", F.pmod(draw("m" + side), F.col(f"n{side}")) + 1)
            .join(spots, [f"identity{side}", f"pos{side}"])
        )
    return drawn.select("pair_id", "identity1", "identity2", "key1", "key2", F.lit(0).alias("is_same"))


def validation_pairs(members: DataFrame, cap: int, n: int, seed: int = 42) -> DataFrame:
    """Genuine and impostor pairs in one table."""
    cols = ["identity1", "identity2", "key1", "key2", "is_same"]
    return genuine_pairs(members, cap, seed).select(*cols).unionByName(impostor_pairs(members, n, seed).select(*cols))


def banded_pairs(members: DataFrame, band: int = BAND, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs of members at most ``band`` places apart in key order inside their identity.

    Each member is sent to its ``band`` next places and meets its partner by an equi-join,
    so the work is ``band`` rows per member however large the identity.
    """
    placed = positions(members.select("identity", "key"), ["identity"], "key", "pos", (), rows_per_cell)
    ahead = placed.select(
        "identity",
        F.col("key").alias("key1"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(band)), lambda d: F.col("pos") + d)).alias("pos"),
    )
    partner = placed.select("identity", "pos", F.col("key").alias("key2"))
    return ahead.join(partner, ["identity", "pos"]).select("identity", "key1", "key2")


def assign_splits(
    items: DataFrame,
    min_items: int = MIN_ITEMS,
    enrollment_items: int = ENROLLMENT_ITEMS,
    validation_share: float = VALIDATION_SHARE,
    seed: int = 42,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Seeded enrollment / validation / test split inside each identity with enough items."""
    sizes = items.groupBy("identity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_items)
    placed = seeded_positions(items, seed, "_pos", rows_per_cell).join(broadcast_if_small(sizes), "identity")
    rest = F.greatest(F.col("_n") - enrollment_items, F.lit(0))
    validation = F.greatest(F.lit(1), F.floor(rest * F.lit(float(validation_share))))
    split = (
        F.when(F.col("_pos") <= enrollment_items, F.lit("enrollment"))
        .when(F.col("_pos") <= enrollment_items + validation, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return placed.select(*items.columns, split.alias("split"))


def in_split(splits: DataFrame, name: str) -> DataFrame:
    """Rows of one split; an empty split is an error."""
    rows = splits.where(F.col("split") == name)
    if rows.isEmpty():
        raise ValueError(f"no rows in split {name!r}")
    return rows


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys that the cache does not hold yet."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def distinct_keys(pairs: DataFrame) -> DataFrame:
    """Distinct vector keys named on either side of the pairs, in order."""
    return (
        pairs.select(F.col("key1").alias("key"))
        .unionByName(pairs.select(F.col("key2").alias("key")))
        .distinct()
        .orderBy("key")
    )


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by seeded hash: a top-n, so only n rows per task leave it."""
    return rows.orderBy(hash60(F.lit(seed), F.col(key)), key).limit(n)


def cap_per_group(rows: DataFrame, group_cols: list[str], key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group by seeded hash; tasks trim groups before the shuffle."""
    order = Window.partitionBy(*group_cols).orderBy(hash60(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def unknown_probes(members: DataFrame, enrolled: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """One member each of ``n`` identities that are not enrolled."""
    others = members.join(enrolled.select("identity").distinct(), "identity", "left_anti")
    first = others.groupBy("identity").agg(F.min("key").alias("key"))
    return seeded_sample(first, "identity", n, seed)
