"""Shards of near-equal bytes in which equal texts stay together: a minimax contiguous partition.

The atomic groups are the equal texts, in the order of the SHA-256 of their text, so a shard is a
stretch of digests and a uniform part of the corpus, and a document's shard follows from its text
and the cuts alone. The smallest capacity for which the groups, taken in order, fill no more than the
wanted number of shards is found by binary search; a greedy pass checks each capacity.

The search runs on the driver, over sums of bytes per prefix of the digest that Spark adds up. A
prefix that holds several groups is known by its sum only. A greedy pass that cuts beside such
prefixes needs at least the true capacity, one that may cut anywhere in them at most that; between
the two lies where the true cuts are. Only prefixes there are added up again two digits further,
until both passes agree. So the driver holds some 65,536 sums, whatever the number of documents.

A group that is no smaller than an even share would make any capacity as large as itself; it comes
before all others, largest first, and gets a shard of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.operators.ordering import ROWS_PER_CELL, positions

SHARDS = 16
#: Hex digits of the first prefixes, and how many are added when a prefix is looked at closer.
DIGITS = 4
MORE_DIGITS = 2


@dataclass(frozen=True)
class Prefix:
    """Groups whose digests begin with ``digits``: their bytes, and the digest if there is one group only."""

    digits: str
    size: int
    only: str | None


@dataclass(frozen=True)
class Plan:
    """``alone`` are the groups with a shard each; the others are cut before the digests ``cuts``."""

    alone: tuple[str, ...]
    cuts: tuple[str, ...]
    capacity: int

    def shard(self, digest: Column) -> Column:
        behind = F.lit(len(self.alone))
        for cut in self.cuts:
            behind = behind + (digest >= F.lit(cut)).cast("int")
        chosen = behind
        for number, own in enumerate(self.alone):
            chosen = F.when(digest == F.lit(own), number).otherwise(chosen)
        return chosen.cast("int")


class _Sums:
    """Sums of bytes in digest order, ``edges`` being the running totals at the borders of the prefixes."""

    def __init__(self, prefixes: list[Prefix]):
        self.prefixes = sorted(prefixes, key=lambda p: p.digits)
        self.sizes = np.array([p.size for p in self.prefixes], dtype=np.int64)
        self.open = np.array([p.only is None for p in self.prefixes], dtype=bool)
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total = int(self.edges[-1])

    def _below(self, at: int) -> int:
        """The prefix that holds the byte position ``at``, or whose start it is."""
        return int(np.searchsorted(self.edges, at, side="right")) - 1

    def reach(self, start: int, capacity: int, anywhere: bool) -> int:
        """How far a shard from ``start`` goes; ``anywhere`` lets it end within an open prefix."""
        end = start + capacity
        if end >= self.total:
            return self.total
        k = self._below(end)
        if anywhere and self.open[k]:
            return end
        return max(start, int(self.edges[k]))

    def ends(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, anywhere)
            out.append(at)
        return out

    def capacity(self, shards: int, anywhere: bool) -> int:
        """Smallest capacity for which ``shards`` greedy shards hold everything."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.ends(middle, shards, anywhere)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, shards: int) -> list[Prefix]:
        """Open prefixes in which a cut may lie for a capacity that may be the smallest."""
        low, high = self.capacity(shards, True), self.capacity(shards, False)
        found: set[int] = set()
        for a, b in zip(self.ends(low, shards, False), self.ends(high, shards, True), strict=True):
            if a < self.total:
                last = self._below(min(b, self.total - 1))
                found.update(k for k in range(self._below(a), last + 1) if self.open[k] and (a < b or self.edges[k] < a))
        return [self.prefixes[k] for k in sorted(found)]

    def cut(self, shards: int) -> tuple[list[int], int, list[Prefix]]:
        """Prefixes before which to cut, the capacity, and the open prefixes that a closer look could cut better.

        The capacity is the smallest one. ``least`` are the first places for each cut from which the rest
        still fits. Between that and the reach of the shard before, a cut is as near as can be to an even
        share of what is left, the lower one of two.
        """
        capacity = self.capacity(shards, False)
        looked: list[int] = []
        least = [self.total] * (shards + 1)
        for k in range(shards - 1, -1, -1):
            if least[k + 1] > capacity:
                looked.append(least[k + 1] - capacity)
                least[k] = int(self.edges[np.searchsorted(self.edges, looked[-1], side="left")])
            else:
                least[k] = 0
        out, at = [], 0
        for k in range(1, shards):
            first = int(np.searchsorted(self.edges, max(least[k], at), side="left"))
            last = int(np.searchsorted(self.edges, at + capacity, side="right")) - 1
            even = at + (self.total - at) // (shards - k + 1)
            near = int(np.searchsorted(self.edges, even))
            choices = [min(max(c, first), last) for c in (near - 1, near)]
            chosen = min(choices, key=lambda c: (abs(int(self.edges[c]) - even), c))
            looked += [even, at + capacity]
            out.append(chosen)
            at = int(self.edges[chosen])
        inside = {self._below(x) for x in looked if 0 < x < self.total}
        unsure = [self.prefixes[k] for k in sorted(inside) if self.open[k] and any(self.edges[k] < x < self.edges[k + 1] for x in looked)]
        return out, capacity, unsure


def _sums(sized: DataFrame, digits: int, among: list[str] | None = None) -> list[Prefix]:
    """Bytes per prefix of ``digits``, of all digests or of those with the shorter prefixes ``among``."""
    if among is not None:
        sized = sized.filter(F.substring("digest", 1, len(among[0])).isin(among))
    rows = sized.groupBy(F.substring("digest", 1, digits).alias("digits"))
    rows = rows.agg(F.sum("size").alias("size"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    return [Prefix(r.digits, r.size, r.least if r.least == r.most else None) for r in rows.collect()]


def _refined(sized: DataFrame, prefixes: list[Prefix], chosen: list[Prefix], more: int) -> list[Prefix]:
    wanted = {p.digits for p in chosen}
    out = [p for p in prefixes if p.digits not in wanted]
    for length in sorted({len(d) for d in wanted}):
        out += _sums(sized, length + more, sorted(d for d in wanted if len(d) == length))
    return out


def plan_shards(sized: DataFrame, shards: int = SHARDS, digits: int = DIGITS, more: int = MORE_DIGITS) -> Plan:
    """Where to cut the rows ``digest`` (hexadecimal), ``size``; rows with equal digests stay together."""
    prefixes = _sums(sized, digits)
    alone: list[Prefix] = []
    while prefixes:
        total = sum(p.size for p in prefixes)
        large = [p for p in prefixes if p.size * (shards - len(alone)) >= total]
        closer = [p for p in large if p.only is None]
        if closer:
            prefixes = _refined(sized, prefixes, closer, more)
        elif large:
            largest = min(large, key=lambda p: (-p.size, p.only))
            alone.append(largest)
            prefixes.remove(largest)
        else:
            break
    own = tuple(p.only for p in alone)
    left = shards - len(alone)
    if not prefixes or not left:
        return Plan(own, (), max((p.size for p in alone), default=0))
    while True:
        sums = _Sums(prefixes)
        closer = sums.unsure(left)
        if not closer:
            places, capacity, closer = sums.cut(left)
        if not closer:
            break
        prefixes = _refined(sized, prefixes, closer, more)
    # behind the last prefix nothing follows: "g" is above all hexadecimal digests
    cuts = tuple(sums.prefixes[k].digits if k < len(sums.prefixes) else "g" for k in places)
    return Plan(own, cuts, max([capacity, *(p.size for p in alone)]))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, digits: int = DIGITS, more: int = MORE_DIGITS, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus one, so an empty text has a size too. A null
    text counts as an empty one. Equal texts are in one shard; the largest shard is as small as the
    order of the groups allows. ``slot`` numbers a shard's documents from 0 by id, null ids first, then
    by what is in them; of rows that are equal in all that, any may come first. ``law`` is ``bytes``, by
    which ``grown_shard`` is null: another number of shards means other cuts. An empty table gives an
    empty result; with fewer groups than shards some shards stay empty.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    sized = scratch.table(sized, "sized")
    plan = plan_shards(sized, shards, digits, more)
    dealt = sized.withColumn("shard", plan.shard(F.col("digest")))
    placed = positions(dealt, ["shard"], "doc_id", "place", ["text_crc32", "size", "digest"], rows_per_cell)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same partition as DuckDB SQL: one recursion searches the capacity, one goes back over the last possible cuts, one cuts.
SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
sized AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, sha256(coalesce(text, '')) AS digest,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc_table),
groups AS (SELECT digest, sum(size)::BIGINT AS size FROM sized GROUP BY digest),
by_size AS (
  SELECT digest, size, row_number() OVER w - 1 AS place, sum(size) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM groups WINDOW w AS (ORDER BY size DESC, digest)),
alone AS MATERIALIZED (
  SELECT digest, place FROM by_size
  WHERE place < 16 AND place < coalesce((SELECT min(place) FROM by_size WHERE size * (16 - place) < rest), 16)),
left_over AS MATERIALIZED (SELECT 16 - count(*) AS shards FROM alone),
ordered AS MATERIALIZED (
  SELECT digest, sum(size) OVER (ORDER BY digest)::BIGINT AS upto, size FROM groups WHERE digest NOT IN (SELECT digest FROM alone)),
edges AS MATERIALIZED (SELECT 0::BIGINT AS e UNION ALL SELECT upto FROM ordered),
whole AS MATERIALIZED (SELECT max(e) AS total, (SELECT shards FROM left_over) AS shards FROM edges),
search AS (
  SELECT 0 AS step, 0::BIGINT AS low, total AS high, 0 AS k, 0::BIGINT AS place FROM whole
  UNION ALL
  (WITH next AS (
     SELECT s.step, s.low, s.high, s.k, max(e) AS place
     FROM search s JOIN edges ON e <= s.place + (s.low + s.high) // 2 WHERE s.low < s.high GROUP BY ALL)
   SELECT step + 1,
          CASE WHEN k + 1 = shards AND place < total THEN (low + high) // 2 + 1 ELSE low END,
          CASE WHEN place = total THEN (low + high) // 2 ELSE high END,
          CASE WHEN place = total OR k + 1 = shards THEN 0 ELSE k + 1 END,
          CASE WHEN place = total OR k + 1 = shards THEN 0 ELSE place END
   FROM next, whole)),
smallest AS MATERIALIZED (SELECT low AS capacity FROM search WHERE low = high ORDER BY step LIMIT 1),
back AS (
  SELECT shards::BIGINT AS k, total AS least FROM whole
  UNION ALL
  SELECT b.k - 1, min(e) FROM back b, smallest JOIN edges ON e >= b.least - capacity WHERE b.k > 1 GROUP BY b.k),
cuts AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS place
  UNION ALL
  SELECT c.k + 1, arg_min(e, struct_pack(far := abs(e - (c.place + (total - c.place) // (shards - c.k))), e := e))
  FROM cuts c, smallest, whole JOIN back ON back.k = c.k + 1 JOIN edges ON e >= greatest(back.least, c.place) AND e <= c.place + capacity
  WHERE c.k + 1 < shards GROUP BY c.k),
dealt AS (
  SELECT digest, place::INT AS shard FROM alone
  UNION ALL
  SELECT o.digest, (16 - shards + (SELECT count(*) FROM cuts WHERE k > 0 AND place <= o.upto - o.size))::INT FROM ordered o, left_over)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, digest) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN dealt USING (digest)
"""
