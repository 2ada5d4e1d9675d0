"""Benchmark decontamination: windows of a document as long as a benchmark item, compared by SimHash, then exactly.

Only windows that share a shingle with an item of that length can be similar at all, so only around
such places are windows fingerprinted. A multi-index (blocks of 8 bits, each item listed under every
value within the errors that a block may have) gives all items within the Hamming radius; the
weighted similarity of the shingles then decides. Items of equal text are one item of the index. The
index is broadcast in blocks of a bounded number of items, with one pass over the documents each.
Weights are counted once over all items and are the same in each block: shingles that several items
have are broadcast with their counts (12 bytes each), all others count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.llm.texts import NOT_ALNUM, batch_bytes, run_hashes, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 20
#: Items, and bytes of their text, whose index is broadcast at once.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
_BLOCKS = 8
_BITS = 64
_FILTER = 1 << 22
#: Parts of a block's size into which items are hashed; whole parts make a block.
_PARTS = 16
_SLICE = 8192

FOUND = "doc_id long, item long, similarity double, start_word long, window_words long"


def _votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _shingles(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    """Hashes of all shingles of an item, and the words in each."""
    data, offsets = batch_bytes(pa.array([text or ""]), lower=True)
    starts, ends, _ = word_spans(data, offsets, NOT_ALNUM)
    size = min(shingle, len(starts))
    return (run_hashes(word_hashes(data, starts, ends), size) if size else np.zeros(0, dtype=np.uint64)), size


@dataclass
class Weights:
    """What shingles weigh, by all items: ``rare`` unless listed."""

    rare: int
    shingles: np.ndarray  # sorted
    weights: np.ndarray

    @classmethod
    def of(cls, n: int, shingles: np.ndarray, df: np.ndarray) -> Weights:
        # whole thousandths, so that sums don't depend on their order
        n, often = max(1, n), df > 1
        return cls(round(1000 * math.log1p(n)), shingles[often], np.round(1000 * np.log1p(n / df[often])).astype(np.int32))

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.rare, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.weights[at].astype(np.int64), self.rare)


class ItemIndex:
    """Items of one block: shingles with weights, and per length of window a multi-index of fingerprints."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int = SHINGLE, radius: int = RADIUS, weights: Weights | None = None):
        self.radius = radius
        self.ids: list[int | None] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        lengths: list[tuple[int, int]] = []  # words in a shingle, shingles in the item
        for item_id, text in items:
            found, size = _shingles(text, shingle)
            if len(found):
                self.ids.append(item_id)
                self.counts.append(np.unique(found, return_counts=True))
                lengths.append((size, len(found)))
        every = [x for x, _ in self.counts]
        all_shingles = np.concatenate([*every, np.zeros(0, dtype=np.uint64)])
        self.shingles, where, df = np.unique(all_shingles, return_inverse=True, return_counts=True)
        self.of_all = weights or Weights.of(len(self.ids), self.shingles, df)
        owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
        order = np.argsort(where, kind="stable")
        self.owners, self.owner_at = owner[order], np.searchsorted(where[order], np.arange(len(self.shingles) + 1))
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.shingles & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        self.class_of = np.zeros(len(self.ids), dtype=np.int64)
        self.classes = sorted(set(lengths))
        self.tables = []
        for c, length in enumerate(self.classes):
            members = np.array([i for i, x in enumerate(lengths) if x == length])
            self.class_of[members] = c
            sums = np.stack([(_votes(s) * (k * self.weight(s))[:, None]).sum(axis=0) for s, k in (self.counts[i] for i in members)])
            prints = _packed(sums)
            self.tables.append((members, prints, self._multi_index(prints)))
        self.sizes = sorted({size for size, _ in lengths})

    def _multi_index(self, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block and value: the fingerprints whose block is within radius // blocks bits of it."""
        values = np.arange(256, dtype=np.uint64)
        out = []
        for b in range(_BLOCKS):
            part = (prints >> np.uint64(8 * b)) & np.uint64(255)
            near = np.bitwise_count(values[:, None] ^ part[None, :]) <= self.radius // _BLOCKS
            value, which = np.nonzero(near)
            out.append((np.searchsorted(value, np.arange(257)), which))
        return out

    def __getstate__(self):
        # the weights are broadcast once, not with each block
        return {**self.__dict__, "of_all": None}

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        return self.of_all.weight(shingles)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has."""
        at = np.flatnonzero(self.filter[(shingles & np.uint64(_FILTER - 1)).astype(np.int64)])
        return at[np.isin(shingles[at], self.shingles)]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Sum of the smaller over the sum of the larger weighted counts of the shingles of both."""
        own, own_n = np.unique(window, return_counts=True)
        other, other_n = self.counts[item]
        _, a, b = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        shared = (np.minimum(own_n[a], other_n[b]) * self.weight(own[a])).sum()
        total = (own_n * self.weight(own)).sum() + (other_n * self.weight(other)).sum() - shared
        return float(shared) / float(total)

    def match(self, shingles: np.ndarray, hits: np.ndarray, size: int, threshold: float) -> dict[int, tuple[float, int, int]]:
        """Item -> best similarity, first shingle and shingles of the window, for one document."""
        best: dict[int, tuple[float, int, int]] = {}
        which = np.searchsorted(self.shingles, shingles[hits])
        counts = self.owner_at[which + 1] - self.owner_at[which]
        place = np.repeat(hits, counts)
        owner = self.owners[np.repeat(self.owner_at[which], counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)]
        classes = self.class_of[owner]
        for c in np.unique(classes).tolist():
            if self.classes[c][0] != size:
                continue
            width = min(self.classes[c][1], len(shingles))
            near = np.unique(place[classes == c])
            last = len(shingles) - width
            edge = np.zeros(last + 2, dtype=np.int64)
            np.add.at(edge, np.clip(near - width + 1, 0, last + 1), 1)
            np.add.at(edge, np.minimum(near, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for i in range(0, len(run), _SLICE):
                    self._windows(shingles, int(run[i]), min(_SLICE, len(run) - i), width, c, threshold, best)
        return best

    def _windows(self, shingles: np.ndarray, begin: int, n: int, width: int, c: int, threshold: float, best: dict) -> None:
        part = shingles[begin : begin + n + width - 1]
        sums = np.zeros((len(part) + 1, _BITS), dtype=np.int64)
        np.cumsum(_votes(part) * self.weight(part)[:, None], axis=0, out=sums[1:])
        prints = _packed(sums[width:] - sums[:-width])
        members, own, tables = self.tables[c]
        pairs = []
        for b, (ptr, listed) in enumerate(tables):
            value = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            counts = ptr[value + 1] - ptr[value]
            window = np.repeat(np.arange(n), counts)
            item = listed[np.repeat(ptr[value], counts) + np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)]
            close = np.bitwise_count(prints[window] ^ own[item]) <= self.radius
            pairs.append(window[close] * len(members) + item[close])
        for pair in np.unique(np.concatenate(pairs)).tolist():
            window, item = divmod(pair, len(members))
            item = int(members[item])
            value = self.similarity(shingles[begin + window : begin + window + width], item)
            if value >= threshold and (item not in best or value > best[item][0]):
                best[item] = (value, begin + window, width)


def _matches_of(batch_texts: pa.Array, index: ItemIndex, threshold: float) -> Iterator[tuple[int, int, tuple[float, int, int], int]]:
    """Number of the text, item, best window and words in a shingle, for all matches of a batch."""
    data, offsets = batch_bytes(batch_texts, lower=True)
    starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
    words = word_hashes(data, starts, ends)
    for size in index.sizes:
        runs = run_hashes(words, size)
        hits = index.hits(runs)
        text = np.searchsorted(first, hits, side="right") - 1
        inside = hits + size <= first[text + 1]
        hits, text = hits[inside], text[inside]
        for t in np.unique(text).tolist():
            mine = runs[first[t] : first[t + 1] - size + 1]
            for item, found in index.match(mine, hits[text == t] - first[t], size, threshold).items():
                yield t, item, found, size


def _opened(index, weights) -> ItemIndex:
    items: ItemIndex = index.value
    items.of_all = weights.value
    return items


def _search(index, weights, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(index, weights)
        for batch in batches:
            rows = list(_matches_of(batch.column(1), items, threshold))
            of = np.array([t for t, *_ in rows], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of)),
                    pa.array([items.ids[i] for _, i, _, _ in rows], type=pa.int64()),
                    pa.array([x[0] for *_, x, _ in rows], type=pa.float64()),
                    pa.array([x[1] for *_, x, _ in rows], type=pa.int64()),
                    pa.array([x[2] + size - 1 for *_, x, size in rows], type=pa.int64()),
                ],
                names=["doc_id", "item", "similarity", "start_word", "window_words"],
            )

    return run


def _clean(index, weights, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(index, weights)
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for t, *_ in _matches_of(batch.column(column), items, threshold):
                keep[t] = False
            yield batch.filter(pa.array(keep))

    return run


def _spread(shingle: int):
    """Per distinct text: its distinct shingles, each for as many items as have the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(_shingles(text, shingle)[0])
                if len(found):
                    # a row more for the item itself, without a shingle
                    rows = pa.array([None, *found.view(np.int64).tolist()], type=pa.int64())
                    yield pa.RecordBatch.from_arrays([rows, pa.array(np.full(len(rows), n, dtype=np.int64))], names=["shingle", "n"])

    return run


class _Items:
    """Distinct item texts with the weights of all items."""

    def __init__(self, items: DataFrame):
        spark = items.sparkSession
        scratch = Scratch(spark, "decontam")
        self.rows = scratch.table(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "items").filter("text IS NOT NULL")
        texts = self.rows.groupBy("text").agg(F.count("*").alias("n"))
        # numbers are written with the texts, so they don't change
        self.texts = scratch.table(texts.select(F.monotonically_increasing_id().alias("item"), "text", "n"), "texts")
        spread = self.texts.select("text", "n").mapInArrow(_spread(SHINGLE), "shingle long, n long")
        df = scratch.table(spread.groupBy("shingle").agg(F.sum("n").alias("df")).filter("df > 1 OR shingle IS NULL"), "df")
        n = df.filter("shingle IS NULL").first()
        often = df.filter("shingle IS NOT NULL").toArrow()
        shingles, counts = np.array(often["shingle"], dtype=np.int64).view(np.uint64), np.array(often["df"], dtype=np.int64)
        order = np.argsort(shingles)
        self.weights = spark.sparkContext.broadcast(Weights.of(n["df"] if n else 0, shingles[order], counts[order]))

    def indexes(self, block_items: int, block_bytes: int) -> Iterator:
        """Broadcast indexes of all texts, block by block; a text above the bytes of a block is a block of its own."""
        spark = self.texts.sparkSession
        size = self.texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        parts = _PARTS * max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
        part = F.pmod(F.xxhash64("item"), F.lit(parts))
        sizes = self.texts.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        blocks: list[list[int]] = [[0, 0, 0, 0]]  # first part, part behind the last, texts, bytes
        for row in sizes.orderBy("part").collect():
            if blocks[-1][2] and (blocks[-1][2] + row["n"] > block_items or blocks[-1][3] + row["bytes"] > block_bytes):
                blocks.append([row["part"], row["part"], 0, 0])
            blocks[-1] = [blocks[-1][0], row["part"] + 1, blocks[-1][2] + row["n"], blocks[-1][3] + row["bytes"]]
        for first, behind, _, _ in blocks:
            mine = self.texts.filter((part >= first) & (part < behind)).select("item", "text").orderBy("item")
            yield spark.sparkContext.broadcast(ItemIndex([(r["item"], r["text"]) for r in mine.collect()], weights=self.weights.value))


def benchmark_matches(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, window_words``: items found in documents, best window each.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; shingles have five
    words (an item of fewer words is one shingle). A window has as many shingles as the item, or the
    whole document if that is shorter. ``similarity`` is the weighted Jaccard of the shingles, with
    repeats; a shingle weighs ln(1 + items / items that have it). Of equal windows the first counts.

    Null or wordless texts of documents or items match nothing. Ids may be null or repeat; repeated
    rows give repeated matches. No item or no document: an empty result.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed, out = _Items(items), None
    for index in listed.indexes(block_items, block_bytes):
        found = source.mapInArrow(_search(index, listed.weights, threshold), FOUND)
        out = found if out is None else out.unionByName(found)
    # from a text to the items that have it
    numbers = listed.texts.select("item", F.col("text").alias("its"))
    numbers = listed.rows.join(numbers, F.col("text") == F.col("its")).select("item", "item_id")
    return out.join(numbers, "item").select("doc_id", "item_id", "similarity", "start_word", "window_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; nothing is shuffled."""
    prepare(docs.sparkSession)
    listed = _Items(items)
    for index in listed.indexes(block_items, block_bytes):
        docs = docs.mapInArrow(_clean(index, listed.weights, docs.columns.index("text"), threshold), docs.schema)
    return docs
