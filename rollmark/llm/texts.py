"""Words of a whole Arrow batch of texts as numpy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


#: Space, tab and the other ASCII line and page breaks.
WHITESPACE = _table(b" \t\n\x0b\x0c\r")
#: All ASCII characters but lower-case letters and digits; texts are lower-cased first.
NOT_ALNUM = _table(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longer words (bytes) are hashed by xxh3: polynomials modulo a power of two meet on long regular words.
LONG_WORD = 64
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xD1B54A32D192ED03
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from the hashes of each."""
    return mix(a * _U(_BASE) + (b ^ (b >> _U(29))) + _U(0x632BE59BD9B4E019))


def batch_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offset of each text; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return (LOWER[raw] if lower else raw), offsets - offsets[0]


def slices(batch: pa.RecordBatch, size: int, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, without a copy, with about ``size`` bytes of text in a column; each has a row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(lengths) - lengths
    heads = [*np.flatnonzero(np.diff(before // size, prepend=-1)).tolist(), len(batch)]
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (one more at the end)."""
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        size = _CHUNK + LONG_WORD + 1
        made = []
        for value in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, value, dtype=np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``second`` gives another, independent one.

    The hash is a polynomial over the bytes, read off running sums, then scrambled with the
    word's length. Words over ``LONG_WORD`` bytes are hashed one by one, with a seed for each hash.
    """
    power, inverse = _powers(_SECOND if second else _BASE)
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)
    stops = ends if not len(long) else np.where(lengths > LONG_WORD, starts, ends)
    edges = np.searchsorted(starts, np.arange(0, len(data) + _CHUNK, _CHUNK))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if i == j:
            continue
        zero = starts[i]
        part = data[zero : max(stops[i:j].max(), zero)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + _U(1)) * power[: len(part)], out=sums[1:])
        a, b = starts[i:j] - zero, stops[i:j] - zero
        out[i:j] = (sums[b] - sums[np.minimum(a, len(part))]) * inverse[a]
    out = mix(out ^ (lengths.astype(np.uint64) * _U(0xA0761D6478BD642F)))
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 7 + second)
    return out


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbouring words, built by doubling; runs over text ends are included."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    doubled, size, out, done = words, 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, done = doubled, size
            else:
                n = len(words) - done - size + 1
                out, done = join_hash(out[:n], doubled[done : done + n]), done + size
        if done == length:
            return out[: len(words) - length + 1]
        doubled, size = join_hash(doubled[: len(doubled) - size], doubled[size:]), size * 2


def least_of_run(values: np.ndarray, length: int) -> np.ndarray:
    """Least of every ``length`` neighbouring values."""
    size, out = 1, values
    while size * 2 <= length:
        out, size = np.minimum(out[: len(out) - size], out[size:]), size * 2
    n = len(values) - length + 1
    return np.minimum(out[:n], out[length - size : length - size + n])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all rows and the number that each row has."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
