"""Spelling variants: which words of a vocabulary are one edit apart, and which form each belongs to.

Every word generates its edits, and each edit is looked up in Bloom filters of the vocabulary before
anything moves. The filters are sharded by word length, because an edit's length is known, and
blocked: a look-up stays within 512 bits. They are broadcast in rounds of bounded size. What the
filters let through is shuffled to a join with the vocabulary, which drops the false positives.

An edit is never spelt out on the way: a word's hash is a sum over its code points, each hashed with
its place, so the hash of an edit is the word's own with few terms changed. Of two words one edit
apart only one generates the other: the longer one by a deletion, or the one whose code point is
smaller by a replacement. The links found are then read in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollmark.llm.blooms import BLOCK_BITS, block_column, block_numbers, collect_blocks, lane_bits, look_up
from rollmark.llm.common import Scratch, is_empty, prepare
from rollmark.llm.texts import mix
from rollmark.session import spread_by

#: Letters of the words: ASCII and Latin-1 with marks, as the task defines them.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 6
MIN_COUNT = 5
#: How much more frequent a form is than its variant at least.
RATIO = 5
#: One run in so many loses a code point.
NOISE = 199

#: Bits of filter for each word.
BITS_PER_WORD = 16
#: Blocks (64 bytes each) of the filters that are broadcast at once.
ROUND_BLOCKS = 1 << 19
#: Words of so many code points or more share a shard.
LONG = 256
#: Edits of a batch that are looked up at once.
EDITS = 1 << 20

_U = np.uint64
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, *_ASCII))


def noisy_words(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word`` for every run of letters, lower-cased, one in ``noise`` of them without one code point.

    Which run is hit, and where, follows from the CRC-32 of the document's id (null: ``null``), a colon
    and the run, so equal runs of a document are hit alike. Words below ``min_length`` are left out.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("its"), F.explode(runs).alias("run"))
    rows = rows.select("its", lower_ascii(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("its", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    hit = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % noise == 0, hit).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur ``min_count`` times or more; nulls are no words."""
    counted = words.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _terms(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What a code point at a place adds to a word's sum."""
    return mix((places.astype(_U) << _U(21)) ^ codes.astype(_U) ^ _U(0x9E3779B97F4A7C15))


def _finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums ^ _U((length * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, code points as a matrix)`` of the words of a batch, for each length there is."""
    texts = words.to_pylist()
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        joined = "".join([texts[i] for i in rows]).encode("utf-32-le")
        yield length, rows, np.frombuffer(joined, dtype="<u4").reshape(len(rows), length)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.zeros(batch.num_rows, dtype=_U)
        lengths = np.zeros(batch.num_rows, dtype=np.int32)
        for length, rows, codes in _by_length(batch.column(0)):
            lengths[rows] = length
            step = max(1, EDITS // max(length, 1))
            for i in range(0, len(rows), step):
                part = codes[i : i + step]
                sums[rows[i : i + step]] = _finish(_terms(np.arange(length)[None, :], part).sum(axis=1, dtype=_U), length)
        columns = [batch.column(0), batch.column(1), pa.array(lengths), pa.array(sums.view(np.int64)), pa.array(lane_bits(sums).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "length", "hash", "lanes"])


class _Filters:
    """Blocks ``start`` and on of the filters of all shards, which lie one after another."""

    def __init__(self, sizes: list[int], start: int, lanes: np.ndarray):
        self.sizes, self.start, self.lanes = sizes, start, lanes
        self.offsets = [0]
        for size in sizes:
            self.offsets.append(self.offsets[-1] + size)

    def holds(self, length: int) -> bool:
        shard = min(length, LONG)
        return self.sizes[shard] > 0 and self.offsets[shard] < self.start + self.lanes.shape[1] and self.offsets[shard + 1] > self.start

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes of words of ``length`` that these blocks may hold."""
        shard = min(length, LONG)
        block = block_numbers(hashes, self.sizes[shard]) + (self.offsets[shard] - self.start)
        inside = np.flatnonzero((block >= 0) & (block < self.lanes.shape[1]))
        return look_up(self.lanes, inside, block[inside], hashes[inside])


def _probe(filters, alphabet: str):
    """Rows ``id, hash, place, put`` for the edits that the broadcast filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Filters = filters.value
        letters = np.array([ord(c) for c in alphabet], dtype=np.int64)
        spelt = pa.array([*alphabet, ""])
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for length, rows, codes in _by_length(batch.column(1)):
                step = max(1, EDITS // max(1, length * len(letters)))
                for i in range(0, len(rows), step):
                    for found in _edits(known, codes[i : i + step], letters):
                        row, place, put, hashes = found
                        if len(row):
                            columns = [pa.array(ids[rows[i + row]]), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32)), spelt.take(pa.array(put))]
                            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "place", "put"])

    return run


def _edits(known: _Filters, codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, place, letter, hash)`` of the deletions, then the replacements, that may be words.

    Of neighbouring equal code points only the first is deleted; a replacement puts a larger one.
    Long words are done a stretch of places at a time.
    """
    n, length = codes.shape
    places = np.arange(length)
    own = _terms(places[None, :], codes)
    total = own.sum(axis=1, dtype=_U)
    if length > 1 and known.holds(length - 1):
        moved = np.zeros_like(own)
        moved[:, 1:] = _terms(places[None, :-1], codes[:, 1:])
        before = np.cumsum(own, axis=1, dtype=_U) - own
        behind = moved.sum(axis=1, dtype=_U)[:, None] - np.cumsum(moved, axis=1, dtype=_U)
        first = np.ones(codes.shape, dtype=bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, place = np.nonzero(first)
        hashes = _finish((before + behind)[first], length - 1)
        hit = known.find(hashes, length - 1)
        yield row[hit], place[hit], np.full(len(hit), len(letters)), hashes[hit]
    if known.holds(length):
        step = max(1, EDITS // max(1, n * len(letters)))
        for i in range(0, length, step):
            part = codes[:, i : i + step]
            larger = letters[None, None, :] > part[:, :, None]
            row, place, letter = np.nonzero(larger)
            put = _terms(places[i : i + step, None], letters[None, :])
            hashes = _finish(((total[:, None] - own[:, i : i + step])[:, :, None] + put[None, :, :])[larger], length)
            hit = known.find(hashes, length)
            yield row[hit], place[hit] + i, letter[hit], hashes[hit]


def _filter_rounds(words: DataFrame, round_blocks: int, bits_per_word: int) -> Iterator[_Filters]:
    """The filters of all words, at most ``round_blocks`` blocks at a time; Spark sets the bits."""
    shard = F.least(F.col("length"), F.lit(LONG))
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    sizes = [-(-counts.get(s, 0) * bits_per_word // BLOCK_BITS) for s in range(LONG + 1)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).tolist()

    def of(values: list[int]) -> Column:
        upto = values[: max(counts, default=0) + 1]
        return F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in upto)})"), shard + 1)

    block = block_column("hash", of(sizes)) + of(offsets[:-1])
    for start in range(0, offsets[-1], round_blocks):
        size = min(round_blocks, offsets[-1] - start)
        chosen = words.withColumn("block", block).filter((F.col("block") >= start) & (F.col("block") < start + size))
        yield _Filters(sizes, start, collect_blocks(chosen, start, size))


def near_words(words: DataFrame, scratch: Scratch, round_blocks: int = ROUND_BLOCKS, bits_per_word: int = BITS_PER_WORD) -> DataFrame:
    """Links ``id, n, near_id, near_word, near_n`` in both directions, of words one edit apart.

    ``words`` has ``id, word, n, length, hash, lanes``. Each round broadcasts the filters of some shards
    (64 bytes a block) and only reads words whose edits can be in them.
    """
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = "".join(sorted(r.c for r in letters.collect()))
    positives = None
    for k, filters in enumerate(_filter_rounds(words, round_blocks, bits_per_word)):
        lengths = [s for s in range(LONG + 1) if filters.holds(s)]
        reach = F.least(F.col("length"), F.lit(LONG)).isin(lengths) | F.least(F.col("length") - 1, F.lit(LONG)).isin(lengths)
        shared = spark.sparkContext.broadcast(filters)
        asking = spread_by(words.filter(reach).select("id", "word"), "id")
        found = asking.mapInArrow(_probe(shared, alphabet), "id long, hash long, place int, put string")
        found = scratch.table(found, f"positives{k}")
        shared.unpersist()
        positives = found if positives is None else positives.unionByName(found)
    if positives is None:
        positives = spark.createDataFrame([], "id long, hash long, place int, put string")
    targets = words.select("hash", F.col("id").alias("to"), F.col("word").alias("to_word"), F.col("n").alias("to_n"))
    sources = words.select("id", "word", "n")
    edited = F.concat(F.expr("substring(word, 1, place)"), F.col("put"), F.expr("substring(word, place + 2)"))
    links = positives.join(targets, "hash").join(sources, "id").filter(edited == F.col("to_word"))
    forth = links.select("id", "n", F.col("to").alias("near_id"), F.col("to_word").alias("near_word"), F.col("to_n").alias("near_n"))
    back = links.select(F.col("to").alias("id"), F.col("to_n").alias("n"), F.col("id").alias("near_id"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    return forth.unionByName(back)


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for each word with a form: forms followed to the last, in steps that double."""
    at = forms.select("id", F.col("form_id").alias("to"), F.col("form").alias("root"))
    step = 0
    while True:
        at = scratch.table(at, f"roots{step}")
        onward = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("next_root"))
        joined = at.join(onward, "to", "left")
        if is_empty(joined.filter("next is not null")):
            return at.select("id", "root")
        at = joined.select("id", F.coalesce("next", "to").alias("to"), F.coalesce("next_root", "root").alias("root"))
        step += 1


def group_variants(words: DataFrame, ratio: int = RATIO, round_blocks: int = ROUND_BLOCKS, bits_per_word: int = BITS_PER_WORD) -> DataFrame:
    """Per word of ``word, n`` (distinct words): ``word, form, root, n, n_near, form_n``.

    Words are near if one inserted, deleted or replaced code point makes one of the other. A word's form
    is its most frequent near word (ties: the smallest in code-point order) if that occurs ``ratio``
    times as often; ``root`` is the last form reached by following forms, the word itself without one.
    Counts grow on the way, so this ends. Nulls are no words. An empty table gives an empty result.
    """
    spark = prepare(words.sparkSession)
    scratch = Scratch(spark, "spelling")
    hashed = words.filter("word is not null").select("word", F.col("n").cast("long").alias("n"))
    hashed = hashed.mapInArrow(_hash_words, "word string, n long, length int, hash long, lanes long")
    hashed = scratch.table(hashed.withColumn("id", F.monotonically_increasing_id()), "words")
    links = near_words(hashed, scratch, round_blocks, bits_per_word)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word", "near_id")).alias("best")
    near = links.groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.less") >= ratio * F.col("n")
    near = near.select(
        "id",
        "n_near",
        F.when(strong, F.col("best.near_word")).alias("form"),
        F.when(strong, F.col("best.near_id")).alias("form_id"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    near = scratch.table(near, "near")
    roots = _roots(near.filter("form is not null"), scratch)
    rows = hashed.select("id", "word", "n").join(near, "id", "left").join(roots, "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``group_variants`` of the words of all texts, some of which lose a code point (``noisy_words``).

    Null texts have no words; rows may repeat, and each counts.
    """
    spark = prepare(docs.sparkSession)
    counted = vocabulary(noisy_words(docs, noise, min_length), min_count)
    return group_variants(Scratch(spark, "spelling").table(counted, "vocabulary"), ratio)


#: The same groups as DuckDB SQL: deletions on both sides meet instead of filters.
SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS its,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run
  FROM documents),
counted AS (SELECT its, run, count(*) AS times FROM runs GROUP BY its, run),
hashed AS (
  SELECT run, times,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(its || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS h
  FROM counted, crc_table),
noisy AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times
  FROM hashed),
vocabulary AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS MATERIALIZED (
  SELECT word, n, i AS place, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM vocabulary)),
links AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, v.word, v.n FROM shorter a JOIN vocabulary v ON a.rest = v.word
  UNION
  SELECT v.word, v.n, a.word, a.n FROM shorter a JOIN vocabulary v ON a.rest = v.word),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(near, struct_pack(less := -near_n, near := near)) AS near, max(near_n) AS near_n FROM links GROUP BY word, n),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
steps AS (
  SELECT word, word AS place, form AS next FROM forms
  UNION ALL
  SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON s.next = f.word)
SELECT f.word, f.form, s.place AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON f.word = s.word AND s.next IS NULL
"""
