"""LM scoring: an interpolated modified Kneser-Ney model, counted in Spark and kept as sorted hash arrays.

Words are counted first; a word's id is its rank among all hashes of words. Then counting goes level
by level. Tasks count the longest n-grams of ids in their own texts and send each shard of contexts a
compressed block. The task of a shard merges its blocks, writes a file of sorted arrays (contexts,
their totals, words and counts) and passes on, for each shorter n-gram, in how many distinct longer
ones it ends: the counts of the next level. The number of shards follows the size of the corpus, so a
shard fits a task. Shuffles and blocks go when the next level has been written. Workers map the files
into memory and look up the sorted contexts of a whole batch shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollmark.llm.common import Scratch, prepare, shuffles_dropped, write_file
from rollmark.llm.texts import WHITESPACE, batch_bytes, join_hash, mix, word_hashes, word_spans
from rollmark.sources.files import filesystem

ORDER = 2
#: Bytes of text whose n-grams go to one shard.
SHARD_BYTES = 16 << 20
#: Tokens that a task counts before it merges and sends them.
COUNT_TOKENS = 2_500_000
END = np.uint64(0x14057B7EF767814F)
#: Ids of the token before a text, and of words that the model doesn't have.
START = np.uint32(0)
UNKNOWN = np.uint32(0xFFFFFFFF)
_CODEC = pa.Codec("zstd", compression_level=1)

BLOCKS = "shard int, kind string, block binary"
TOTALS = "shard int, kind string, block binary, totals array<long>"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and where each text starts."""
    data, offsets = batch_bytes(column, lower=True)
    starts, ends, first = word_spans(data, offsets, WHITESPACE)
    hashes = word_hashes(data, starts, ends)
    out = np.full(len(hashes) + len(column), END, dtype=np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(column)), np.diff(first))] = hashes
    return out, first + np.arange(len(column) + 1)


def _before(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Ids of the tokens 1, 2, ... order - 1 places before each token; start tokens stand before a text."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out: list[np.ndarray] = []
    for back in range(1, order):
        before = np.full(len(tokens), START, dtype=np.uint32)
        inside = place >= back
        before[inside] = tokens[np.flatnonzero(inside) - back]
        out.append(before)
    return out


def context_key(before: list[np.ndarray]) -> np.ndarray:
    """64-bit key of a context, the nearest token first: one to one for up to two tokens, a hash for more."""
    near = before[0].astype(np.uint64)
    key = mix(near if len(before) == 1 else near << np.uint64(32) | before[1])
    for further in before[2:]:
        key = join_hash(key, further.astype(np.uint64))
    return key


def _heads(by: list[np.ndarray]) -> np.ndarray:
    """Where rows, sorted by some columns, differ from the row before."""
    new = np.ones(len(by[0]), dtype=bool)
    if len(new):
        new[1:] = by[0][1:] != by[0][:-1]
    for c in by[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _merge(by: list[np.ndarray], columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sum the counts of n-grams that are equal in one or two columns, sorted by these."""
    if not len(counts):
        return columns, counts
    order = np.argsort(by[0])
    if len(by) > 1:
        first = by[0][order]
        group = np.cumsum(np.r_[False, first[1:] != first[:-1]], dtype=np.uint64)
        order = order[np.argsort(group << np.uint64(32) | by[1][order])]
    at = _heads([c[order] for c in by])
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order].astype(np.int64), at)


def _distinct(columns: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers up to ``most``, sorted, and how often each occurs."""
    bits = np.uint64(max(1, int(most).bit_length()))
    n = len(columns[0])
    if int(bits) * len(columns) <= 64:
        packed = columns[0].astype(np.uint64)
        for c in columns[1:]:
            packed = packed << bits | c.astype(np.uint64)
        packed.sort()
        at = _heads([packed])
        packed = packed[at]
        out = []
        for _ in columns:
            out.append((packed & np.uint64((1 << int(bits)) - 1)).astype(np.uint32))
            packed = packed >> bits
        return out[::-1], np.diff(np.r_[at, n])
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = _heads(columns)
    return [c[at] for c in columns], np.diff(np.r_[at, n])


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The number of shards is a power of two; the top bits of a key name its shard."""
    return (keys >> np.uint64(65 - shards.bit_length())).astype(np.uint16 if shards <= 1 << 16 else np.uint32)


def _floors(shards: int) -> np.ndarray:
    """The least key of each shard."""
    bits = shards.bit_length() - 1
    return np.arange(shards, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """First all lowest bytes of the values, then the next ones, and so on; this is what compresses well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _block(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """A compressed block of distinct n-grams, sorted by their columns (the word last).

    Each context comes once, with the number of its words. The first column of the contexts, or a
    single column, is sent as differences. Nearly all counts fit a byte; the others come behind.
    """
    if len(columns) > 1:
        new = np.ones(len(counts), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
        at = np.flatnonzero(new)
        parts = [np.diff(columns[0][at], prepend=columns[0].dtype.type(0)), np.diff(np.r_[at, len(counts)]).astype(np.uint32), *(c[at] for c in columns[1:-1]), columns[-1]]
    else:
        parts = [np.diff(columns[0], prepend=columns[0].dtype.type(0))]
    parts += [np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.uint64)]
    sizes = np.array([columns[0].itemsize, *(len(p) * p.itemsize for p in parts)], dtype=np.int64)
    raw = b"".join([sizes.tobytes(), *map(_planes, parts)])
    return np.int64(len(raw)).tobytes() + _CODEC.compress(raw, asbytes=True)


def _unblock(block: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and counts of a block."""
    raw = _CODEC.decompress(block[8:], int(np.frombuffer(block, dtype=np.int64, count=1)[0]), asbytes=True)
    several = width > 1
    head = np.frombuffer(raw, dtype=np.int64, count=width + 3 + several)
    kind = np.uint32 if head[0] == 4 else np.uint64
    stops = np.cumsum(head[1:]) + head.nbytes
    parts = [raw[a:b] for a, b in zip(np.r_[head.nbytes, stops[:-1]], stops, strict=True)]
    columns = [np.cumsum(_values(parts[0], kind), dtype=kind)]
    if several:
        runs = _values(parts[1], np.uint32)
        columns = [np.repeat(c, runs) for c in (columns[0], *(_values(p, kind) for p in parts[2:-3]))]
        columns.append(_values(parts[-3], kind))
    counts = np.frombuffer(parts[-2], dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = _values(parts[-1], np.uint64)
    return columns, counts


def _dealt(columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of n-grams that are sorted by their shard and then by their columns."""
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(shard[a]), _block([c[a:b] for c in columns], counts[a:b])


def _grams(columns: list[np.ndarray], shards: int, bases: np.ndarray, names: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Blocks of n-grams of ids (the nearest token of the context first, the word last), equal ones counted.

    The columns are ids or, if there are ``names``, places of ids among these, which ascend. N-grams
    go by the key of their context, single words by the range of ids that their shard has.
    """
    columns, counts = _distinct(columns, bases[-1] if names is None else len(names))
    if names is not None:
        columns = [names[c] for c in columns]
    if len(columns) > 1:
        shard = _shard_of(context_key(columns[:-1]), shards)
    else:
        shard = (np.searchsorted(bases, columns[0], side="right") - 1).astype(np.uint32)
    order = np.argsort(shard, kind="stable")
    yield from _dealt([c[order] for c in columns], counts[order], shard[order])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    names = ["shard", "kind", "block", "totals"][: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def _count_words(shards: int):
    """Distinct token hashes and their counts, summed over what a task reads until there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        words, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            for shard, block in _dealt([words], counts, _shard_of(words, shards)):
                yield _batch([(shard, "words", block)])

        def more() -> tuple[np.ndarray, np.ndarray]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found = np.concatenate([words, found])
            (found,), n = _merge([found], [found], np.r_[counts, n])
            return found, n

        for batch in batches:
            held.append(_sequence(batch.column(0))[0])
            size += len(held[-1])
            if size >= COUNT_TOKENS:
                words, counts = more()
                held, size = [], 0
                if len(words) >= COUNT_TOKENS:
                    yield from send()
                    words, counts = words[:0], counts[:0]
        if held:
            words, counts = more()
        yield from send()

    return run


def _count(order: int, model):
    """Blocks of the longest n-grams, of the ids that the model has for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([np.diff(h[1]) for h in held])
            held.clear()
            distinct, which = np.unique(tokens, return_inverse=True)
            # ids ascend with the hashes, and the start token comes first
            names = np.r_[START, m.word_ids(distinct)[0]]
            places = (which + 1).astype(np.uint32)
            columns = [*_before(places, np.r_[0, np.cumsum(lengths)], order), places]
            del tokens, which
            for shard, block in _grams(columns, m.shards, m.bases, names):
                yield _batch([(shard, "grams", block)])

        for batch in batches:
            held.append(_sequence(batch.column(0)))
            size += len(held[-1][0])
            if size >= COUNT_TOKENS:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def _file(arrays: list[np.ndarray]) -> bytes:
    """Bytes of the arrays, each filled up to whole 8-byte words, after a head that has their lengths and widths."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], dtype=np.int64)
    return b"".join([head.tobytes(), *(p + bytes(-len(p) % 8) for p in parts)])


def _arrays(data: np.ndarray) -> list[np.ndarray]:
    """The arrays of a file again, without a copy; ``data`` is bytes, mapped or read."""
    n = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for length, width in head.tolist():
        out.append(data[at : at + length * width].view(f"u{width}"))
        at += length * width + -(length * width) % 8
    return out


def _small(values: np.ndarray) -> list[np.ndarray]:
    """Values as bytes; where 255 stands, the value is in the last array, its place in the one before."""
    large = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), large.astype(np.uint32), values[large].astype(np.uint64)]


def _at(small: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """The values of ``_small`` at some places."""
    out = small[0][places].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = small[2][np.searchsorted(small[1], places[large])]
    return out


def _lower(at, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place from ``low`` on, ``high`` at most, whose value isn't below the wanted one."""
    out = low.astype(np.int64)
    open_ = np.flatnonzero(low < high)
    place, size, wanted = out[open_], high[open_].astype(np.int64) - out[open_], wanted[open_]
    while len(open_):
        # the first half, rounded up, goes if its last value is below; where nothing is left, nothing goes
        half = (size + 1) >> 1
        place += np.where(at(place + half - 1) < wanted, half, 0)
        size -= half
        left = np.flatnonzero(size)
        if 2 * len(left) <= len(size):
            done = np.flatnonzero(size == 0)
            out[open_[done]] = place[done]
            open_, place, size, wanted = open_[left], place[left], size[left], wanted[left]
    return out


def _keys(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Sorted keys of a shard: where each of their ranges begins, and the lower 48 bits of each key at most."""
    top = shards.bit_length() - 1
    bits = max(16 - top, (len(keys) >> 3).bit_length())
    starts = np.searchsorted((keys << np.uint64(top)) >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [starts.astype(np.uint32), keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)]


def _find_key(parts: list[np.ndarray], shards: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in ``_keys``, and whether it is there."""
    starts, low, high = parts
    top = shards.bit_length() - 1
    range_ = ((wanted << np.uint64(top)) >> np.uint64(64 - (len(starts) - 1).bit_length() + 1)).astype(np.int64)
    mine = wanted & np.uint64((1 << 48) - 1)

    def at(places: np.ndarray) -> np.ndarray:
        return high[places].astype(np.uint64) << np.uint64(32) | low[places]

    ends = starts[range_ + 1].astype(np.int64)
    place = _lower(at, starts[range_], ends, mine)
    hit = place < ends
    hit[hit] = at(place[hit]) == mine[hit]
    return place, hit


def _grouped(rows: Iterator[tuple[int, str, bytes]]) -> Iterator[tuple[int, dict[str, list[bytes]]]]:
    """Blocks by shard, of rows that are sorted by shard."""
    now, blocks = None, {}
    for shard, kind, block in rows:
        if shard != now and now is not None:
            yield now, blocks
            blocks = {}
        now = shard
        blocks.setdefault(kind, []).append(block)
    if now is not None:
        yield now, blocks


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    """Shard, kind and block."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _gather(blocks: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All rows of some blocks, equal ones not yet summed."""
    parts = [_unblock(b, width) for b in blocks]
    return [np.concatenate([p[0][i] for p in parts]) for i in range(width)], np.concatenate([p[1] for p in parts])


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


#: Arrays of the files, as numbers of arrays. Words (level 0): hashes; tokens. Single words (level 1):
#: in how many distinct bigrams each ends, in the order of the words. N-grams: contexts that occur
#: once, and their word; the other contexts, where the n-grams of each begin, its total and how many
#: of its n-grams have count 1, 2 and more; the words of these n-grams, and their counts.
WORD_FILE = (1, 3)
END_FILE = (3,)
GRAM_FILE = (3, 1, 3, 1, 3, 3, 3, 3, 1, 3)


def _split(arrays: list[np.ndarray], layout: tuple) -> list[list[np.ndarray]]:
    edges = np.cumsum((0, *layout)).tolist()
    return [arrays[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _write_words(shards: int, folder: str):
    """Files of words: their hashes and how often they occur. The rank among all hashes makes a word's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _grouped(_rows(batches)):
            (words,), counts = _gather(blocks["words"], 1)
            (words,), counts = _merge([words], [words], counts)
            write_file(f"{folder}/0-{shard}", _file([words, *_small(counts)]))
            yield _batch([(shard, "totals", None, [len(words), int(counts.sum())])])

    return run


def _reduce(level: int, model, folder: str):
    """Write the files of a level's shards; return their totals and the blocks of the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for shard, blocks in _grouped(_rows(batches)):
            columns, counts = _gather(blocks.pop("grams"), level)
            key = context_key(columns[:-1])
            (key, *columns), counts = _merge([key, columns[-1]], [key, *columns], counts)
            word = columns[-1]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            totals = np.add.reduceat(counts, at)
            kinds = [np.add.reduceat(k.astype(np.int64), at) for k in (counts == 1, counts == 2, counts > 2)]
            sizes = np.diff(np.r_[at, len(key)])
            single = totals == 1
            rest = ~np.repeat(single, sizes)
            starts = np.r_[0, np.cumsum(sizes[~single])].astype(np.uint32)
            arrays = [*_keys(key[at][single], m.shards), word[~rest], *_keys(key[at][~single], m.shards), starts]
            arrays += [a for x in (totals, *kinds) for a in _small(x[~single])]
            write_file(f"{folder}/{level}-{shard}", _file([*arrays, word[rest], *_small(counts[rest])]))
            yield _batch([(shard, "totals", None, [*_of_counts(counts), len(counts), int(totals.sum())])])
            del key, arrays, rest
            below = [*columns[: level - 2], word]
            for lower, block in _grams(below, m.shards, m.bases):
                yield _batch([(lower, "grams", block, None)])

    return run


def _reduce_words(model, folder: str):
    """Files of single words: in how many distinct bigrams each ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for shard, blocks in _grouped(_rows(batches)):
            (ids,), n = _gather(blocks["grams"], 1)
            (ids,), n = _merge([ids], [ids], n)
            base, stop = m.bases[shard], m.bases[shard + 1]
            endings = np.zeros(int(stop - base), dtype=np.int64)
            endings[ids - base] = n
            write_file(f"{folder}/1-{shard}", _file(_small(endings)))
            kinds = [int((n == 1).sum()), int((n == 2).sum()), int((n > 2).sum())]
            yield _batch([(shard, "totals", None, [*_of_counts(n), int(n.sum()), *kinds])])

    return run


def discounts(of_counts: list[int]) -> np.ndarray:
    """What is taken off counts of 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = of_counts
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))])


@dataclass
class Model:
    """Where the arrays are and the few numbers that hold for all of them."""

    folder: str
    order: int
    shards: int
    tokens: int
    words: int
    bases: np.ndarray  # the first id of each shard of words, and one more
    shards_of: dict[int, list[int]]
    endings: int = 0
    rest: float = 1.0  # of the single words' probability that goes to all words alike
    discount: dict[int, np.ndarray] = field(default_factory=dict)
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _shard(self, level: int, shard: int) -> list[list[np.ndarray]] | None:
        """The arrays of a file: mapped if the store is mounted, otherwise read for this use alone."""
        if (level, shard) in self._open:
            return self._open[level, shard]
        if shard not in self.shards_of[level]:
            return None
        store, path = filesystem(f"{self.folder}/{level}-{shard}")
        local = store.type_name == "local"
        if local:
            data = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
        else:
            with store.open_input_file(path) as source:
                data = np.frombuffer(source.read(), dtype=np.uint8)
        arrays = _split(_arrays(data), WORD_FILE if level == 0 else END_FILE if level == 1 else GRAM_FILE)
        if local:
            self._open[level, shard] = arrays
        return arrays

    def _by_shard(self, level: int, keys: np.ndarray) -> Iterator[tuple[slice, int, list[list[np.ndarray]]]]:
        """Parts of sorted ``keys``, their shard and its arrays."""
        edges = np.r_[np.searchsorted(keys, _floors(self.shards)), len(keys)]
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            arrays = self._shard(level, shard)
            if arrays is not None:
                yield slice(edges[shard], edges[shard + 1]), shard, arrays

    def word_ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted words, and how often they occur."""
        ids, tokens = np.full(len(words), UNKNOWN, dtype=np.uint32), np.zeros(len(words))
        for part, shard, ((known,), n) in self._by_shard(0, words):
            at, hit = _find(known, words[part])
            at = at[hit]
            ids[part][hit] = at + int(self.bases[shard])
            tokens[part][hit] = _at(n, at)
        return ids, tokens

    def word_values(self, ids: np.ndarray) -> np.ndarray:
        """The probability of words without a context."""
        uniform = 1 / (self.words + 1)
        if not self.endings:
            return np.full(len(ids), uniform)
        endings = np.zeros(len(ids))
        shard = np.where(ids == UNKNOWN, -1, np.searchsorted(self.bases, ids, side="right") - 1)
        for k in self.shards_of[1]:
            mine = np.flatnonzero(shard == k)
            if len(mine):
                (n,) = self._shard(1, k)
                endings[mine] = _at(n, (ids[mine] - self.bases[k]).astype(np.int64))
        taken = self.discount[1][np.minimum(endings, 3).astype(np.int64)]
        return (endings - taken) / self.endings + self.rest * uniform

    def raise_order(self, level: int, context: np.ndarray, word: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities with one more token of context, from those with one less."""
        off = self.discount[level]
        order = np.argsort(context)
        keys, words = context[order], word[order]
        begins = np.r_[_heads([keys]), len(keys)]
        seen, sizes = keys[begins[:-1]], np.diff(begins)
        total, rest, counts = np.zeros(len(seen)), np.ones(len(seen)), np.zeros(len(word))
        for part, _, (once, (once_word,), several, (starts,), sums, ones, twos, more, (known,), n) in self._by_shard(level, seen):
            mine = slice(begins[part.start], begins[part.stop])
            its = np.repeat(np.arange(part.stop - part.start), sizes[part])
            wanted, count = words[mine], np.zeros(len(its))
            at, hit = _find_key(once, self.shards, seen[part])
            total[part][hit] = 1
            rest[part][hit] = off[1]
            asked = np.flatnonzero(hit[its])
            count[asked] = once_word[at[its[asked]]] == wanted[asked]
            others = np.flatnonzero(~hit)
            at[others], hit = _find_key(several, self.shards, seen[part][others])
            others = others[hit]
            here = at[others]
            sum_ = _at(sums, here).astype(float)
            total[part][others] = sum_
            rest[part][others] = sum(off[i + 1] * _at(k, here).astype(float) for i, k in enumerate((ones, twos, more))) / sum_
            there = np.zeros(part.stop - part.start, dtype=bool)
            there[others] = True
            asked = np.flatnonzero(there[its])
            place, wanted = at[its[asked]], wanted[asked]
            high = starts[place + 1].astype(np.int64)
            found = _lower(known.__getitem__, starts[place], high, wanted)
            there = np.flatnonzero(found < high)
            there = there[known[found[there]] == wanted[there]]
            count[asked[there]] = _at(n, found[there])
            counts[mine] = count
        total, rest = np.repeat(total, sizes), np.repeat(rest, sizes)
        below_ = below[order]
        own = (counts - off[np.minimum(counts, 3).astype(np.int64)]) / np.where(total > 0, total, 1)
        out = np.empty(len(word))
        out[order] = np.where(total > 0, own + rest * below_, below_)
        return out


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> tuple[Model, Scratch]:
    """Count and store a model of the texts in ``docs`` (column ``text``); the scratch folder holds its files."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "ngram")
    folder = scratch.path("model")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(4, (size // shard_bytes).bit_length())
    texts = docs.select("text")
    shards_of: dict[int, list[int]] = {k: [] for k in range(order + 1)}

    def reduced(blocks: DataFrame, step, level: int) -> tuple[DataFrame, list]:
        """What the step makes of all shards, and its totals: a row for each shard."""
        dealt = blocks.select("shard", "kind", "block").repartition(shards, "shard").sortWithinPartitions("shard")
        with shuffles_dropped(spark):
            made = scratch.table(dealt.mapInArrow(step, TOTALS), f"level{level}")
        rows = made.filter("kind = 'totals'").select("shard", "totals").collect()
        shards_of[level] = [r["shard"] for r in rows]
        return made.filter("kind = 'grams'"), rows

    _, rows = reduced(texts.mapInArrow(_count_words(shards), BLOCKS), _write_words(shards, folder), 0)
    in_shard = np.zeros(shards, dtype=np.int64)
    for r in rows:
        in_shard[r["shard"]] = r["totals"][0]
    # id 0 is the start token
    bases = 1 + np.r_[0, np.cumsum(in_shard)]
    words, tokens = int(in_shard.sum()), sum(r["totals"][1] for r in rows)
    if words + 1 >= UNKNOWN:
        raise ValueError("there are more words than ids")
    model = Model(folder, order, shards, tokens, words, bases, shards_of)
    shared = spark.sparkContext.broadcast(model)
    now = texts.mapInArrow(_count(order, shared), BLOCKS)
    sums: dict[int, list[int]] = {}
    for level in range(order, 0, -1):
        step = _reduce(level, shared, folder) if level > 1 else _reduce_words(shared, folder)
        now, rows = reduced(now, step, level)
        scratch.drop(f"level{level + 1}")
        sums[level] = np.sum([r["totals"] for r in rows], axis=0).tolist() if rows else [0] * 8
    model.discount = {k: discounts(sums[k][:4]) for k in sums}
    model.endings = sums[1][4]
    if model.endings:
        model.rest = sum(model.discount[1][i + 1] * sums[1][5 + i] for i in range(3)) / model.endings
    return model, scratch


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            tokens, first = _sequence(batch.column(1))
            if not len(batch):
                continue
            distinct, which = np.unique(tokens, return_inverse=True)
            ids, n = m.word_ids(distinct)
            base = np.log10((n + 1) / (m.tokens + m.words + 1))[which]
            p = m.word_values(ids)[which]
            ids = ids[which]
            before = _before(ids, first, m.order)
            for level in range(2, m.order + 1):
                p = m.raise_order(level, context_key(before[: level - 1]), ids, p)
            at = first[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(first)),
                    pa.array(np.add.reduceat((n > 0)[which].astype(np.int64), at)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(np.log10(p), at)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    The model learns from the documents whose crc32(doc_id as text) mod 7 is not 2 and scores all.
    A text (null: empty) is its words in ASCII lower case and an end token. Scores are log10 of
    probabilities; ``perplexity`` is 10 ** (-score / n_tokens). A null ``doc_id`` is held out;
    repeated rows are learned as often as they occur and repeat their result. If nothing is learned,
    all words are equally likely. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, _ = train(source.filter(is_training(F.col("doc_id"))), order, shard_bytes)
    scored = source.mapInArrow(_score(spark.sparkContext.broadcast(model)), SCORES)
    return scored.select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
