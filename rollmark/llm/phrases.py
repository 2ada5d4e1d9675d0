"""Phrases whose words occur together more often than apart, per language, counted exactly in two passes.

First pass: the n-grams of all texts are dealt by hash to partitions. Each task counts what it reads in
bounded buffers; a partition merges these counts into one Misra-Gries summary, which keeps as many
counters as the partition's mass divided by the threshold, and one more. When there are too many, the
count of the largest one that must go is taken off all. What is taken off in total is below the
threshold, so an n-gram that reaches the threshold keeps a counter, whatever the order of merging.

Second pass: a Bloom filter of the n-grams that are left goes to the workers, which read the texts
again and count, as words, the n-grams that it lets through. Sums at or above the threshold are exact
counts of all frequent n-grams; the parts of a frequent phrase are frequent too. The filter has a
fixed largest size: if more is left than it tells apart, more n-grams pass and are dropped by their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.llm.blooms import BLOCK_BITS, block_column, block_numbers, collect_blocks, lane_bits, look_up
from rollmark.llm.common import Scratch, prepare
from rollmark.llm.texts import batch_bytes, mix, run_hashes, slices, word_hashes, word_spans

#: What ends a piece of text, and what ends a word within a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
WORD_ENDS = " \t"
#: Language of texts that name none.
NO_LANG = "und"

MAX_WORDS = 3
THRESHOLD = 10
#: A phrase is dropped if a longer one that holds it has so many percent of its count.
ABSORBED = 50
TOP = 2000
SCALE = 1_000_000

#: N-grams that a task holds before it sends their counts.
BUFFER = 3 << 20
#: Bytes of text whose n-grams are hashed at once.
COUNTED_BYTES = 1 << 20
#: N-grams of a batch that are spelt out at once.
SPELT = 1 << 16
#: Mass of a hash partition, about; its summary has a tenth as many counters.
PART_MASS = 1 << 24
LEAST_PARTS = 64
#: Partitions that a task sends to at once; more are reached in two steps.
FAN = 1024
#: Largest filter that is broadcast, and its bits for each n-gram below that.
FILTER_BYTES = 64 << 20
FILTER_BITS = 16
#: Parts that a language's candidates are ranked in before the last ranking.
SALTS = 64

_U = np.uint64
_BLOCKS = "part int, mass long, hashes binary, counts binary, larger binary"


def _table(members: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in members]] = True
    return table


class _Grams:
    """Words and n-grams of the texts of one Arrow batch (``text``, ``lang``)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.data, offsets = batch_bytes(texts, lower=True)
        ends = _table(PIECE_ENDS)
        self.starts, self.ends, first = word_spans(self.data, offsets, ends | _table(WORD_ENDS))
        marks = np.flatnonzero(ends[self.data])
        self.joined = np.zeros(len(self.starts), dtype=bool)  # with the word before it
        self.joined[1:] = np.searchsorted(marks, self.starts[1:]) == np.searchsorted(marks, self.ends[:-1])
        self.joined[first[:-1][first[:-1] < len(self.starts)]] = False
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.repeat(coded.indices.to_numpy().astype(np.int64), np.diff(first))
        self.words: dict[bool, np.ndarray] = {}

    def places(self, size: int) -> np.ndarray:
        """First words of the n-grams of ``size`` words that lie within a piece."""
        whole = np.ones(max(0, len(self.starts) - size + 1), dtype=bool)
        for k in range(1, size):
            whole &= self.joined[k : k + len(whole)]
        return np.flatnonzero(whole)

    def hashes(self, size: int, places: np.ndarray, second: bool = False) -> np.ndarray:
        if second not in self.words:
            self.words[second] = word_hashes(self.data, self.starts, self.ends, second)
        salts = np.array([xxhash.xxh3_64_intdigest(name, size) for name in self.langs], dtype=_U)
        return mix(run_hashes(self.words[second], size)[places] ^ salts[self.lang[places]])

    def phrases(self, size: int, places: np.ndarray) -> pa.Array:
        """The n-grams at ``places``, their words joined by one space."""
        parts = [self._phrases(size, places[i : i + SPELT]) for i in range(0, len(places), SPELT)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.large_string())

    def _phrases(self, size: int, places: np.ndarray) -> pa.Array:
        a, b = self.starts[places], self.ends[places + size - 1]
        plain = np.ones(len(places), dtype=bool)
        for k in range(1, size):
            gap = self.ends[places + k - 1]
            plain &= (self.starts[places + k] == gap + 1) & (self.data[gap] == 32)
        odd = np.flatnonzero(~plain)
        lengths = np.where(plain, b - a, 0)
        ends = np.cumsum(lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        at = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], lengths)
        found = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))
        if len(odd):
            def spelt(place: int) -> str:
                words = (self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(place, place + size))
                return b" ".join(words).decode()

            found = pc.replace_with_mask(found, pa.array(~plain), pa.array([spelt(p) for p in places[odd].tolist()], type=pa.large_string()))
        return found


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts (ones if there are none)."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts, heads)
    return keys[heads], sums.astype(np.int64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return block_numbers(keys, parts)


def _send(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_BLOCKS`` for keys in order: for each partition its mass, then the keys and counts."""
    part = _part_of(keys, parts)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
    tails = np.append(heads[1:], len(part))
    small = np.minimum(counts, 255).astype(np.uint8)
    rows: list[tuple] = []
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        large = np.flatnonzero(small[a:b] == 255)
        rows.append((int(part[a]), int(counts[a:b].sum()), None, None, None))
        rows.append((int(part[a]), 0, keys[a:b].tobytes(), small[a:b].tobytes(), counts[a:b][large].tobytes()))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for i in range(0, len(rows), 512):
        columns = zip(*rows[i : i + 512], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["part", "mass", "hashes", "counts", "larger"])


def _received(hashes: bytes, counts: bytes, larger: bytes) -> tuple[np.ndarray, np.ndarray]:
    sums = np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
    sums[sums == 255] = np.frombuffer(larger, dtype=np.int64)
    return np.frombuffer(hashes, dtype=_U), sums


def _count(parts: int, max_words: int, buffer: int):
    """First pass over texts: counts of hashed n-grams, for each buffer full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in (part for whole in batches for part in slices(whole, COUNTED_BYTES)):
            grams = _Grams(batch.column(0), batch.column(1))
            for n in range(1, max_words + 1):
                found = grams.hashes(n, grams.places(n)) if len(grams.starts) >= n else np.zeros(0, dtype=_U)
                for i in range(0, len(found), buffer):
                    held.append(found[i : i + buffer])
                    size += len(held[-1])
                    if size >= buffer:
                        yield from _send(*_summed(np.concatenate(held), None), parts)
                        held, size = [], 0
        if size:
            yield from _send(*_summed(np.concatenate(held), None), parts)

    return run


def _regroup(parts: int, buffer: int):
    """Blocks of coarse partitions dealt to finer ones, equal keys summed where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from _send(*_summed(keys, counts), parts)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if row[0] is not None:
                    held.append(_received(*row))
                    size += len(held[-1][0])
                    if size >= buffer:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return run


class Summary:
    """A Misra-Gries summary of ``capacity`` counters; ``lost`` is what was taken off every counter."""

    def __init__(self, capacity: int, buffer: int = 1 << 20):
        self.capacity, self.buffer, self.lost = capacity, buffer, 0
        self.keys, self.counts = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge counts of distinct keys; a few blocks are gathered first, so that merging is linear."""
        self.held.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting >= max(self.buffer, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.held:
            keys, counts = (np.concatenate(c) for c in zip((self.keys, self.counts), *self.held, strict=True))
            self.keys, self.counts = _summed(keys, counts)
            self.held, self.waiting = [], 0
        if len(self.keys) > self.capacity:
            # the largest count that must go
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > off
            self.keys, self.counts = self.keys[stay], self.counts[stay] - off
            self.lost += off

    def may_reach(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def _summarise(threshold: int):
    """``hash, lanes`` of the n-grams that may reach the threshold; rows come by partition, its masses first."""

    def left(summary: Summary | None) -> Iterator[pa.RecordBatch]:
        if summary is not None:
            keys = summary.may_reach(threshold)
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(lane_bits(part).view(np.int64))], names=["hash", "lanes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mass, summary = None, 0, None
        for batch in batches:
            for part, more, *block in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if part != current:
                    yield from left(summary)
                    current, mass, summary = part, 0, None
                if block[0] is None:
                    mass += more
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                summary.add(*_received(*block))
        yield from left(summary)

    return run


def _taken(texts: pa.ChunkedArray, places: np.ndarray) -> pa.Array:
    """The texts at ``places`` in one array."""
    found = texts.take(pa.array(places))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _recount(filter_, blocks: int, max_words: int, buffer: int):
    """Second pass over texts: ``lang, words, phrase, n`` of the n-grams in the filter; no words: all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = filter_.value
        names: dict[str, int] = {}
        totals: list[int] = []
        held: list[tuple] = []
        size = 0

        def merge() -> None:
            """Sum the counts of equal n-grams, which leaves one block."""
            one, two, counts, lang, words = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
            spelt = pa.chunked_array([h[5] for h in held], type=pa.large_string())
            held.clear()
            order = np.lexsort((two, one))
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]))
            kept = order[heads]
            sums = np.add.reduceat(counts[order], heads)
            held.append((one[kept], two[kept], sums, lang[kept], words[kept], _taken(spelt, kept)))

        def flush() -> Iterator[pa.RecordBatch]:
            ((_, _, counts, lang, words, spelt),) = held
            held.clear()
            langs = pa.array(list(names))
            for i in range(0, len(counts), SPELT):
                part = slice(i, i + SPELT)
                columns = [langs.take(pa.array(lang[part])), pa.array(words[part]), spelt[part].cast(pa.string()), pa.array(counts[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])

        for batch in (part for whole in batches for part in slices(whole, COUNTED_BYTES)):
            grams = _Grams(batch.column(0), batch.column(1))
            number = np.array([names.setdefault(name, len(names)) for name in grams.langs], dtype=np.int64)
            totals += [0] * (len(names) - len(totals))
            for k, n in enumerate(np.bincount(grams.lang, minlength=len(grams.langs)).tolist()):
                totals[number[k]] += n
            for n in range(1, max_words + 1):
                places = grams.places(n) if len(grams.starts) >= n else np.zeros(0, dtype=np.int64)
                hashes = grams.hashes(n, places) if len(places) else np.zeros(0, dtype=_U)
                at = look_up(lanes, np.arange(len(places)), block_numbers(hashes, blocks), hashes)
                if not len(at):
                    continue
                one, two = hashes[at], grams.hashes(n, places[at], second=True)
                order = np.lexsort((two, one))
                heads = np.flatnonzero(np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]))
                counts = np.diff(np.append(heads, len(order)))
                kept = order[heads]
                first = places[at[kept]]
                lang = number[grams.lang[first]].astype(np.int32)
                held.append((one[kept], two[kept], counts, lang, np.full(len(kept), n, dtype=np.int32), grams.phrases(n, first)))
                size += len(kept)
            if size >= buffer // 2:
                merge()
                size = 0
                if len(held[0][0]) >= buffer:
                    yield from flush()
        if held:
            merge()
            yield from flush()
        if totals:
            columns = [pa.array(list(names)), pa.array([0] * len(totals), type=pa.int32()), pa.array([""] * len(totals)), pa.array(totals, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])

    return run


def frequent_ngrams(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    threshold: int = THRESHOLD,
    part_mass: int = PART_MASS,
    least_parts: int = LEAST_PARTS,
    buffer: int = BUFFER,
    filter_bytes: int = FILTER_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """``lang, words, phrase, n`` of all n-grams of 1 to ``max_words`` words that occur ``threshold`` times or more.

    Rows with ``words`` 0 tell how many words the language has in all.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has some six bytes with its space and begins an n-gram of each size
    wanted = max(least_parts, size * max_words // 6 // part_mass)
    coarse = min(wanted, fan)
    fine = coarse * -(-wanted // coarse)
    sent = texts.mapInArrow(_count(coarse, max_words, buffer), _BLOCKS)
    if fine > coarse:
        sent = sent.repartition(coarse, "part").mapInArrow(_regroup(fine, buffer), _BLOCKS)
    ordered = sent.repartition(fine, "part").sortWithinPartitions("part", F.col("hashes").isNotNull())
    left = scratch.table(ordered.mapInArrow(_summarise(threshold), "hash long, lanes long"), "left")
    blocks = max(1, min(filter_bytes * 8, left.count() * FILTER_BITS) // BLOCK_BITS)
    lanes = collect_blocks(left.select(block_column("hash", F.lit(blocks)).alias("block"), "lanes"), 0, blocks)
    shared = spark.sparkContext.broadcast(lanes)
    again = texts.mapInArrow(_recount(shared, blocks, max_words, buffer // 2), "lang string, words int, phrase string, n long")
    summed = again.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return scratch.table(summed.filter((F.col("n") >= threshold) | (F.col("words") == 0)), "frequent")


def _words(phrase: Column, first: int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def scored(frequent: DataFrame, max_words: int = MAX_WORDS, absorbed: int = ABSORBED, scale: int = SCALE) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the candidates that no longer one absorbs.

    Of the ways to cut a candidate in two, the one of the lowest score counts, the first of equals.
    Counts are multiplied as decimals, so products may pass 64 bits.
    """
    candidates = frequent.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = frequent.filter("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _words(F.col("phrase"), 1, F.col("k")))
    cuts = cuts.withColumn("right", F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("part_n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("part_n").alias("r")), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(38,0)") for c in "alr")
    cuts = cuts.withColumn("up", a * a * F.lit(scale).cast("decimal(38,0)")).withColumn("down", l * r)
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = candidates.filter("words > 2")
    held = None
    for size in range(2, max_words):
        of_size = longer.filter(F.col("words") > size)
        spans = F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, size), " "))
        inside = of_size.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("most"))
        held = inside if held is None else held.unionByName(inside)
    if held is not None:
        held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        best = best.join(held, ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {absorbed} * a")
    return best.select("lang", "phrase", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("long").alias("score"))


def collocations(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, threshold: int = THRESHOLD, **options) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts a phrase, ``l`` and ``r`` its two parts, ``n`` all words of the language; ``score`` is
    ``a * a / (l * r)`` in millionths. Texts without a language count as ``und``, null texts as empty
    ones; rows may repeat, and each counts. An empty table gives an empty result.
    """
    frequent = frequent_ngrams(docs, max_words, threshold, **options)
    found = scored(frequent, max_words)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each part first, so that no task sorts all candidates of a language
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = frequent.filter("words = 0").select(F.col("lang").alias("its"), F.col("n").alias("n"))
    ranked = ranked.join(totals, F.col("lang") == F.col("its"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same phrases as DuckDB SQL, which counts all n-grams.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM listed
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM listed
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM listed),
frequent AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 10),
candidates AS MATERIALIZED (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM frequent WHERE size >= 2),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, (SELECT unnest([1, 2]) AS k) WHERE k < size),
best AS (
  SELECT c.lang, c.size, c.phrase, c.a, min(struct_pack(score := 1000000 * c.a * c.a // (l.a * r.a), k := c.k, l := l.a, r := r.a)) AS b
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.first_part JOIN frequent r ON r.lang = c.lang AND r.phrase = c.rest
  GROUP BY c.lang, c.size, c.phrase, c.a),
held AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, best.a DESC, best.phrase) AS rank, best.phrase, best.a, b.l, b.r, b.score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase
  WHERE most IS NULL OR 100 * most < 50 * best.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
