"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded, documented sample of labelled rows (``MAX_EXAMPLES`` of each label) and the
``MAX_FEATURES`` terms that tell the labels apart best, so it can be broadcast whatever the corpus
holds. Document frequencies come from all documents, and every document is scored in one pass
without a shuffle. Terms are words and their first bytes, which catches inflected forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rollmark.llm.common import Scratch, prepare
from rollmark.llm.texts import NOT_ALNUM, batch_bytes, mix, run_hashes, word_hashes, word_spans

#: Labelled rows of each label that are indexed at most, chosen by a hash of their id.
MAX_EXAMPLES = 4096
MAX_FEATURES = 4096
NEIGHBOURS = 24
THRESHOLD = 0.3
#: Evidence (G squared) that a term needs; below it, chance explains its difference.
EVIDENCE = 18.0
#: Similarity that counts like one neighbour of the base rate: weak matches stay near the base rate.
DAMPING = 0.5
#: First bytes of a word that are terms of their own.
PREFIXES = (4, 5, 6)
_BLOCK = 64
_FILTER = 1 << 22


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of each prefix; a word that is no longer than the prefix has none (zero)."""
    out = [word_hashes(data, starts, ends)]
    for n in PREFIXES:
        made = mix(word_hashes(data, starts, np.minimum(ends, starts + n)) ^ np.uint64(n))
        out.append(np.where(ends - starts > n, made, np.uint64(0)))
    return out


def _counts(batch_texts: pa.Array, wanted: np.ndarray | None, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term and count for the distinct terms of each text, and a hash that near copies mostly share."""
    data, offsets = batch_bytes(batch_texts, lower=True)
    starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
    text_of = np.repeat(np.arange(len(batch_texts)), np.diff(first))
    texts, terms = [], []
    for hashes in _terms(data, starts, ends):
        at = np.flatnonzero(hashes if bits is None else bits[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
        if wanted is not None:
            place = np.minimum(np.searchsorted(wanted, hashes[at]), max(0, len(wanted) - 1))
            right = wanted[place] == hashes[at] if len(wanted) else np.zeros(len(at), dtype=bool)
            at = at[right]
            terms.append(place[right].astype(np.uint64))
        else:
            terms.append(hashes[at])
        texts.append(text_of[at])
    text, term = np.concatenate(texts), np.concatenate(terms)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])]) if len(text) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[new, len(text)])
    mark = np.zeros(0, dtype=np.uint64)
    if wanted is None:
        runs = run_hashes(word_hashes(data, starts, ends), 3)
        mark = np.full(len(batch_texts), np.iinfo(np.uint64).max, dtype=np.uint64)
        inside = text_of[: len(runs)]
        whole = np.arange(len(runs)) + 3 <= first[inside + 1]
        np.minimum.at(mark, inside[whole], runs[whole])
        # texts under three words: their whole
        for i in np.flatnonzero(mark == np.iinfo(np.uint64).max).tolist():
            mark[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return text[new], term[new], count, mark


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of examples: term, label, the mark of near copies."""
    for batch in batches:
        text, term, _, mark = _counts(batch.column(2), None, None)
        for i in range(0, len(text), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[s].view(np.int64)), batch.column(1).take(pa.array(text[s])), pa.array(mark[text[s]].view(np.int64))],
                names=["term", "toxic", "mark"],
            )


def _bits(wanted: np.ndarray) -> np.ndarray:
    bits = np.zeros(_FILTER, dtype=bool)
    bits[(wanted & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    return bits


def _vectors(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(wanted.value)
        for batch in batches:
            text, term, count, _ = _counts(batch.column(2), wanted.value, bits)
            edges = np.searchsorted(text, np.arange(len(batch) + 1)).tolist()
            packed = [[v.astype("<i4")[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for v in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, type=pa.binary()) for p in packed)], names=["doc_id", "terms", "counts"])

    return run


def _frequencies(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total, rows = _bits(wanted.value), np.zeros(len(wanted.value) + 1, dtype=np.int64), 0
        for batch in batches:
            _, term, _, _ = _counts(batch.column(0), wanted.value, bits)
            total += np.bincount(term.astype(np.int64), minlength=len(total))
            rows += len(batch)
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    return run


@dataclass
class Index:
    """Normalised vectors of the examples, by term and block, with the largest weight of each."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of an example in its label's share of all labelled rows
    ptr: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    base: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0]))

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt((value * value).sum())
        return (term, value / norm) if norm > 0 else (term[:0], value[:0])

    def fill(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Index the examples' vectors, in their order."""
        of = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term = np.concatenate([*(t for t, _ in rows), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        value = np.concatenate([*(v for _, v in rows), np.zeros(0)])
        order = np.lexsort((of, term))
        self.example, self.weight = of[order], value[order]
        self.ptr = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.block_max = np.zeros((len(self.terms), -(-max(1, len(rows)) // _BLOCK)))
        np.maximum.at(self.block_max, (term, of // _BLOCK), value)

    def _score(self, term: np.ndarray, value: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the blocks that are alive, with their cosine; postings of other blocks are passed over."""
        ids, parts = [], []
        for t, v in zip(term.tolist(), value.tolist(), strict=True):
            mine = self.example[self.ptr[t] : self.ptr[t + 1]]
            keep = alive[mine // _BLOCK]
            ids.append(mine[keep])
            parts.append(self.weight[self.ptr[t] : self.ptr[t + 1]][keep] * v)
        flat = np.concatenate(ids)
        total = np.bincount(flat, weights=np.concatenate(parts), minlength=len(self.ids))
        found = np.flatnonzero(total)
        return found, total[found]

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples, exactly: nearest first, equals by their order; ``leave`` is left out."""
        if not len(term):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        bound = value @ self.block_max[term]
        order = np.argsort(-bound, kind="stable")
        first = order[:8]
        alive = np.zeros(len(bound), dtype=bool)
        alive[first] = bound[first] > 0
        found, score = self._score(term, value, alive)
        keep = found != leave
        found, score = found[keep], score[keep]
        least = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        rest = (bound >= least - 1e-12) & (bound > 0)
        rest[first] = False
        if rest.any():
            more, more_score = self._score(term, value, rest)
            keep = more != leave
            found, score = np.concatenate([found, more[keep]]), np.concatenate([score, more_score[keep]])
        best = np.lexsort((found, -np.round(score, 12)))[:k]
        return found[best], np.minimum(score[best], 1.0)

    def vote(self, found: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic among the neighbours, weighted by similarity and by what an example stands for."""
        weight = score * score * self.weights[found]
        damping = DAMPING * DAMPING
        return float((weight @ self.labels[found] + damping * self.base) / (weight.sum() + damping))

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic regression of the examples' labels on their votes without themselves (pooled neighbours)."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # weight, labelled weight, weighted votes
        for v, y, w in zip(votes[order].tolist(), self.labels[order].tolist(), self.weights[order].tolist(), strict=True):
            pools.append([w, w * y, w * v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.knots = np.array([p[2] / p[0] for p in pools])
            self.levels = np.array([p[1] / p[0] for p in pools])

    def probability(self, vote: float) -> float:
        """The calibrated score; a thousandth of the raw vote keeps an order among equals."""
        return float(0.999 * np.interp(vote, self.knots, self.levels) + 0.001 * vote)


def is_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_features: int = MAX_FEATURES) -> Index:
    """The index of labelled examples. Labels of held-out rows, nulls and other values than 0 and 1 are not used."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(is_training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    picked = None
    for value in (0, 1):
        some = usable.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        picked = some if picked is None else picked.unionByName(some)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # at most 2 x max_examples rows
    text = text.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    examples = scratch.table(text.select("doc_id", "toxic", "text"), "examples")
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)

    spread = examples.mapInArrow(_explode, "term long, toxic int, mark long").distinct()
    seen = spread.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    size = max(1, positive + negative)
    with_term, p, n = F.col("p") + F.col("n"), F.col("p"), F.col("n")
    without = F.lit(size) - with_term

    def part(observed: Column, of_label: int, of_term: Column) -> Column:
        expected = of_term * of_label / size
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    evidence = 2 * (part(p, positive, with_term) + part(n, negative, with_term) + part(positive - p, positive, without) + part(negative - n, negative, without))
    chosen = seen.filter(with_term >= 4).withColumn("g", evidence).filter(F.col("g") >= EVIDENCE)
    chosen = chosen.orderBy(F.desc("g"), "term").limit(max_features).select("term")
    terms = np.sort(np.array([r["term"] for r in chosen.collect()], dtype=np.int64).view(np.uint64))

    wanted = spark.sparkContext.broadcast(terms)
    df = docs.select("text").mapInArrow(_frequencies(wanted), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    frequency = np.zeros(len(terms) + 1)
    for r in df:
        frequency[r["term"]] = r["df"]
    idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1e-9

    # a row for each example
    rows = examples.mapInArrow(_vectors(wanted), "doc_id long, terms binary, counts binary").collect()
    by_doc = {r["doc_id"]: [np.frombuffer(r[c], dtype="<i4").astype(np.int64) for c in ("terms", "counts")] for r in rows}
    people = sorted((r["toxic"], r["doc_id"]) for r in examples.select("doc_id", "toxic").collect())
    found = {}
    for _, doc in people:
        found[doc] = tuple(by_doc[doc])
    # like beside like: examples in a block share their rarest term, so its largest weights are close to all others
    rarest = {doc: int(t[np.argmax(idf[t])]) if len(t) else -1 for doc, (t, _) in found.items()}
    people.sort(key=lambda x: (x[0], rarest[x[1]], x[1]))
    ids, labels_ = np.array([d for _, d in people], dtype=np.int64), np.array([y for y, _ in people], dtype=float)
    share = np.array([totals.get(y, 1) / max(1, sizes.get(y, 1)) for y, _ in people])
    index = Index(terms, idf, ids, labels_, share / share.mean() if len(share) else share)
    index.base = float((share @ labels_) / share.sum()) if len(share) else 0.0
    vectors = [index.vector(*found[d]) for d in ids.tolist()]
    index.fill(vectors)
    votes = np.array([index.vote(*index.nearest(t, v, leave=i)) for i, (t, v) in enumerate(vectors)])
    index.calibrate(votes)
    scratch.clear()
    return index


def _texts_scores(column: pa.Array, index: Index, bits: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    text, term, count, _ = _counts(column, index.terms, bits)
    empty = index.probability(index.vote(np.zeros(0, dtype=np.int64), np.zeros(0)))
    scores = np.full(len(column), empty)
    near: list[list[int]] = [[] for _ in range(len(column))]
    likeness: list[list[float]] = [[] for _ in range(len(column))]
    edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        found, score = index.nearest(*index.vector(term[a:b].astype(np.int64), count[a:b]))
        t = int(text[a])
        scores[t] = index.probability(index.vote(found, score))
        near[t] = index.ids[found[:3]].tolist()
        likeness[t] = score[:3].tolist()
    return scores, near, likeness


def _scored(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(index.value.terms)
        for batch in batches:
            scores, near, likeness = _texts_scores(batch.column(1), index.value, bits)
            out = [batch.column(0), pa.array(scores), pa.array(near, type=pa.list_(pa.int64())), pa.array(likeness, type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "evidence", "evidence_similarity"])

    return run


def _kept(index, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(index.value.terms)
        for batch in batches:
            scores, _, _ = _texts_scores(batch.column(column), index.value, bits)
            yield batch.filter(pa.array(scores < threshold))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, evidence_similarity`` for every document.

    ``score`` is the calibrated probability of label 1, ``evidence`` the ids of the three nearest
    examples. Only the text is scored. A text without a term of the index (null and empty texts among
    them) gets the share that such texts have among the examples. Without usable labels every score
    is 0. A null ``doc_id`` is scored and counts as held out; repeated rows repeat their result. Of labels
    that repeat for an id the smallest is used, of texts the one with the least hash. An example that is
    in the index finds itself, as any copy of it does: a score depends on the text alone. An empty table
    gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    index = spark.sparkContext.broadcast(fit(docs, labels))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = source.mapInArrow(_scored(index), "doc_id long, score double, evidence array<long>, evidence_similarity array<double>")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
        "evidence_similarity",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; nothing is shuffled."""
    spark = prepare(docs.sparkSession)
    index = spark.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_kept(index, docs.columns.index("text"), threshold), docs.schema)
