"""Substring dedup: windows of words that an earlier document has too are removed, found by level-wise doubling.

The lengths double up to the window: 25 and 50 words for a window of 50. At the first length only
the least hash among the runs of each window of twice that length is kept (winnowing). Equal windows
have equal least hashes, so a window whose least hash occurs in one text alone can't be repeated:
nothing is lost, and about one word in thirteen is shuffled. What is repeated is extended to twice
the length and judged there, and so on until the window's length is reached or nothing is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.llm.texts import WHITESPACE, batch_bytes, least_of_run, lists, run_hashes, word_hashes, word_spans

NO_ID = (1 << 63) - 1
SHORTEST = 32

FACTS = "doc_id long, id long, t long, u long, n_words long, kept_sha256 string, least array<long>"
WINDOWS = "row long, id long, at int, h long, g long"
KEPT = "row long, id long, t long, u long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>"


def levels(window: int) -> list[int]:
    """Lengths from at most ``SHORTEST`` words that double up to ``window``."""
    if window < 2:
        raise ValueError("a window has two words at least")
    length = window // 2
    while length > SHORTEST:
        length //= 2
    out = [length]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _least(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of twice ``length`` words in one text: its first word, and the least hash of its runs."""
    runs = run_hashes(hashes, length)
    if len(runs) <= length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = least_of_run(runs, length + 1)
    room = np.repeat(first[1:], np.diff(first))[: len(least)]  # where the text of each word ends
    at = np.flatnonzero(np.arange(len(least)) + 2 * length <= room)
    return at, least[at]


def _facts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = batch_bytes(batch.column(4))
            starts, ends, first = word_spans(data, offsets, WHITESPACE)
            at, least = _least(word_hashes(data, starts, ends), first, length)
            text = np.searchsorted(first[1:], at, side="right")
            new = np.ones(len(at), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            values = lists(_signed(least[new]), np.bincount(text[new], minlength=len(batch)), pa.int64())
            raw = data.tobytes()
            kept = [hashlib.sha256(b" ".join(raw[i:j].split())).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            out = [batch.column(i) for i in range(4)] + [pa.array(np.diff(first), type=pa.int64()), pa.array(kept), values]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "id", "t", "u", "n_words", "kept_sha256", "least"])

    return run


def _windows(length: int, of: int, first_level: bool):
    """Candidate windows of ``of`` words; ``found`` has the least hashes or the starts that were repeated at ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = batch_bytes(batch.column(2))
            starts, ends, first = word_spans(data, offsets, WHITESPACE)
            one, two = word_hashes(data, starts, ends), word_hashes(data, starts, ends, second=True)
            found, places = batch.column(3), batch.column(3).offsets.to_numpy()
            flat = found.values.to_numpy()
            picked = []
            if first_level:
                at, least = _least(one, first, length)
                edges = np.searchsorted(at, first)
                for k in range(len(batch)):
                    mine = slice(edges[k], edges[k + 1])
                    picked.append(at[mine][np.isin(_signed(least[mine]), flat[places[k] : places[k + 1]])])
            else:
                for k in range(len(batch)):
                    mine = np.sort(flat[places[k] : places[k + 1]])
                    picked.append(first[k] + mine[np.isin(mine + (of - length), mine)])
            at = np.concatenate([*picked, np.zeros(0, dtype=np.int64)]).astype(np.int64)
            text = np.repeat(np.arange(len(batch)), [len(x) for x in picked])
            within = at + of <= first[text + 1]
            at, text = at[within], text[within]
            ids = [batch.column(i).to_numpy()[text] for i in (0, 1)]
            for i in range(0, len(at), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[0][s]),
                        pa.array(ids[1][s]),
                        pa.array((at[s] - first[text[s]]).astype(np.int32)),
                        pa.array(_signed(run_hashes(one, of)[at[s]])),
                        pa.array(_signed(run_hashes(two, of)[at[s]])),
                    ],
                    names=["row", "id", "at", "h", "g"],
                )

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept, spans = [], [], []
            for text, starts in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                words = (text or "").encode().split()
                at = np.asarray(starts.values.to_numpy(), dtype=np.int64)
                step = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                counts.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(~gone))).hexdigest())
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            out = [batch.column(i) for i in range(4)] + [pa.array(counts, type=pa.int64()), pa.array(kept, type=pa.string()), pa.array(spans, type=kind)]
            yield pa.RecordBatch.from_arrays(out, names=["row", "id", "t", "u", "n_removed", "kept_sha256", "removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256, removed`` (spans of words, stop excluded).

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller ``doc_id``; windows are judged on the input. Words are runs of anything but ASCII
    white space, unchanged. ``kept_sha256`` is over the kept words joined by single spaces.

    A null text has no words. A null ``doc_id`` counts as larger than any other. Rows with the same
    id never remove from each other; repeated rows give repeated results. Of equal texts only the
    one with the smallest id is searched: in all others every word goes, if a window fits at all.
    Texts may have any length; columns besides ``doc_id`` and ``text`` are not looked at. An empty
    table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "substrings")
    steps = levels(window)
    text = F.coalesce("text", F.lit(""))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("t"),
        F.xxhash64(F.lit(1), text).alias("u"),
        text.alias("text"),
    )
    facts = scratch.table(source.mapInArrow(_facts(steps[0]), FACTS), "facts")
    # written like the tables below, so that a large group of copies can be split in the last join
    originals = scratch.table(facts.groupBy("t", "u").agg(F.min("id").alias("id")), "originals")

    runs = facts.select("id", "t", "u", "least").join(originals, ["id", "t", "u"]).select("id", "t", "u", F.explode("least").alias("v"))
    repeated = runs.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("v")
    # written, so that both sides of the join are plain shuffles and a hot value can be split there
    repeated = scratch.table(repeated, "repeated")
    found = runs.join(repeated, "v").groupBy("id", "t", "u").agg(F.collect_set("v").alias("found"))
    found = scratch.table(found, "found")
    searched = scratch.table(
        source.drop("doc_id").join(found, ["id", "t", "u"]).select(F.monotonically_increasing_id().alias("row"), "id", "t", "u", "text", "found"), "searched"
    )
    scratch.drop("found")

    starts = searched.select("row", "found")
    for length, of in zip(steps[:-1], steps[1:], strict=True):
        first_level = length == steps[0]
        texts = searched.select("row", "id", "text", "found") if first_level else searched.select("row", "id", "text").join(starts, "row")
        windows = scratch.table(texts.mapInArrow(_windows(length, of, first_level), WINDOWS), f"windows{of}")
        least = windows.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        least = scratch.table(least, f"least{of}")
        again = windows.join(least, ["h", "g"])
        if of == window:
            again = again.filter("id > low")
        starts = again.groupBy("row").agg(F.collect_set("at").alias("found"))
    cut = searched.drop("found").join(starts, "row").select("row", "id", "t", "u", "text", "found")
    cut = cut.mapInArrow(_removed(window), KEPT).drop("row").dropDuplicates(["id", "t", "u"])
    cut = scratch.table(cut, "cut")
    scratch.drop("searched", "repeated", *(f"{name}{x}" for x in steps[1:] for name in ("windows", "least")))

    whole = facts.drop("least").join(originals.withColumnRenamed("id", "low"), ["t", "u"])
    cut = cut.select("id", "t", "u", F.col("n_removed").alias("cut_n"), F.col("kept_sha256").alias("cut_sha"), "removed")
    copy = (F.col("id") > F.col("low")) & (F.col("n_words") >= window)
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return whole.join(cut, ["id", "t", "u"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "kept_sha256")).alias("kept_sha256"),
        F.when(copy, all_words).otherwise(F.coalesce("removed", none)).alias("removed"),
    )
