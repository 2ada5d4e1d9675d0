"""SimHash near-dedup: fingerprints linked within a Hamming radius by a self-join of binary tries.

Distinct fingerprints are dealt to tries by pigeonhole: at most ``radius`` of 64 bits differ, so of
``radius + 1`` blocks of bits one is equal, and in the trie that has that block on top the pair meets
below one node. A node with too many fingerprints is divided the same way on its other bits. In a
trie all pairs of nodes are traversed together: differing bits add up, a pair of nodes is pruned
when they exceed the radius, and taken whole when even the bits that are left can't exceed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rollmark.llm.common import Scratch, components, is_empty, prepare

BITS = 64
SHINGLE = 4
#: Fingerprints below one node of a trie, beyond which the node is divided once more.
NODE_ROWS = 50_000
_BUFFER = 200_000
_LEAF = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' hashes have it; repeated shingles count again."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(sizes) - 1
    starts = stops - sizes + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, votes = len(words) - k + 1, np.zeros(BITS, dtype=np.int64)
    begin, end = starts[:total].tolist(), stops[k - 1 :].tolist()
    for i in range(0, total, 1 << 14):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begin[i : i + (1 << 14)], end[i : i + (1 << 14)], strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(BITS, dtype=np.uint64))[votes * 2 > total].sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; a null text is an empty one."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_fingerprints, "doc_id long, fp long")


class _Forest:
    """Roots of the fingerprints of a partition, joined link by link."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = self.parent[up]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.roots(x), self.roots(y)
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            x, y = low[open_], high[open_]
            np.minimum.at(self.parent, y, x)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges and the range that each is of."""
    sizes = hi - lo
    of = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of], of


def trie_links(fps: np.ndarray, groups: np.ndarray, radius: int) -> _Forest:
    """Link all fingerprints of equal group within ``radius``; rows are sorted by group and fingerprint.

    Every group is a trie: a node is the range of rows below it, and its children are the halves
    of that range. Pairs of nodes at one depth are expanded together.
    """
    n = len(fps)
    forest = _Forest(n)
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    work = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    while work:
        bit, alo, ahi, blo, bhi, diff = work.pop()
        if len(alo) > 500_000:
            cut = len(alo) // 2
            work += [(bit, alo[:cut], ahi[:cut], blo[:cut], bhi[:cut], diff[:cut]), (bit, alo[cut:], ahi[cut:], blo[cut:], bhi[cut:], diff[cut:])]
            continue
        whole = diff + bit + 1 <= radius  # whatever the bits that are left are
        if whole.any():
            for side_lo, side_hi in ((alo[whole], ahi[whole]), (blo[whole], bhi[whole])):
                member, of = _spread(side_lo, side_hi)
                forest.link(member, alo[whole][of])
        small = ~whole & ((ahi - alo) * (bhi - blo) <= _LEAF)
        if small.any():
            sa, of = _spread(alo[small], ahi[small])
            sb, of_pair = _spread(blo[small][of], bhi[small][of])
            sa = sa[of_pair]
            near = (sa < sb) & (np.bitwise_count(fps[sa] ^ fps[sb]) <= radius)
            forest.link(sa[near], sb[near])
        rest = ~whole & ~small
        if not rest.any():
            continue
        alo, ahi, blo, bhi, diff = (x[rest] for x in (alo, ahi, blo, bhi, diff))
        ones = np.zeros(n + 1, dtype=np.int64)
        np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        amid, bmid, same = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo]), alo == blo
        apart = ~same
        pairs = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            (amid[apart], ahi[apart], blo[apart], bmid[apart], diff[apart] + 1),
        ]
        alo, ahi, blo, bhi, diff = (np.concatenate([p[i] for p in pairs]) for i in range(5))
        alive = (ahi > alo) & (bhi > blo) & (diff <= radius) & ~((alo == blo) & (ahi - alo == 1))
        if alive.any():
            work.append((bit - 1, alo[alive], ahi[alive], blo[alive], bhi[alive], diff[alive]))
    return forest


def _join(radius: int):
    def links(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key, path))
        path, key, fp = path[order], key[order], fp[order]
        new = np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]
        forest = trie_links(fp, np.cumsum(new), radius)
        rows = np.arange(len(fp))
        roots = forest.roots(rows)
        at = roots != rows
        return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[roots[at]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            kept.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)])
            if sum(len(x[0]) for x in kept) >= _BUFFER:
                path, key, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
                whole = np.flatnonzero((path != path[-1]) | (key != key[-1]))
                if len(whole):  # the last group may go on in the next batch
                    n = whole[-1] + 1
                    yield links(path[:n], key[:n], fp[:n])
                    path, key, fp = path[n:], key[n:], fp[n:]
                kept = [[path, key, fp]]
        if kept:
            yield links(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def _parts(free: int, pieces: int) -> list[int]:
    """Masks that divide the set bits of ``free`` into neighbouring blocks of nearly equal size."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * k // pieces for k in range(pieces + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(distinct: DataFrame, radius: int, scratch: Scratch, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``a, b`` that connect exactly the fingerprints (column ``fp``, distinct) reachable within ``radius``.

    Per trie the links are a spanning forest, not all pairs. Every fingerprint goes to ``radius + 1``
    tries; tries with more than ``node_rows`` rows are divided by further blocks until no bit is left
    to divide by.
    """
    pieces = radius + 1
    masks = _parts((1 << BITS) - 1, pieces)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("path"), F.lit(_as_long(m)).alias("mask")) for i, m in enumerate(masks)))).alias("x"))
    dealt = dealt.select("x.path", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp")
    ready: list[DataFrame] = []
    level = 0
    while True:
        crowded = dealt.groupBy("path", "key").count().filter(F.col("count") > node_rows).select("path", "key")
        crowded = scratch.table(crowded, f"crowded{level}")
        if is_empty(crowded) or all(bin(m).count("1") >= BITS - pieces for m in masks):
            ready.append(dealt)
            break
        ready.append(dealt.join(crowded, ["path", "key"], "left_anti"))
        deeper = [[m | part for part in _parts(((1 << BITS) - 1) ^ m, pieces)] for m in masks]
        table = F.array(*(F.array(*(F.lit(_as_long(m)) for m in row)) for row in deeper))
        again = dealt.join(crowded, ["path", "key"], "left_semi").select("fp", "path", F.posexplode(F.element_at(table, F.col("path") + 1)).alias("part", "mask"))
        dealt = scratch.table(again.select((F.col("path") * pieces + F.col("part")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), f"dealt{level}")
        masks = [m for row in deeper for m in row]
        level += 1
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition("path", "key").sortWithinPartitions("path", "key")
    return rows.mapInArrow(_join(radius), "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links of ``radius`` or
    fewer differing bits, the document itself included. A text without words (null or empty) has
    fingerprint zero and is linked like any other. A null ``doc_id`` is kept, but is never a
    component's id unless the whole component has no other (then it is null). Repeated rows give
    repeated results. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprints(docs), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(classes.select("fp"), radius, scratch, node_rows)
    found = scratch.table(components(links, scratch), "components")
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    hexes = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select("doc_id", hexes.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays.

    Rows that repeat a kept ``doc_id`` stay with it. A document without an id stays: nothing says
    that another stands for it.
    """
    found = simhash_dedup(docs, radius)
    dropped = found.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
