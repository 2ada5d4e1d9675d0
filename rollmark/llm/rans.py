"""Static range asymmetric numeral system over interleaved lanes, as numpy arrays.

A table record holds the frequencies that all blocks after it share, up to the next table. A block of
tokens is laid out in rows of ``LANES``; each lane is a coder of its own with a 64-bit
state, and all lanes of a row advance together. A block starts with its checkpoint, the states of
all lanes, so blocks decode independently of each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LANES = 1024
#: Frequencies of all symbols sum to 2 ** SCALE.
SCALE = 20
MAGIC = b"RMA1"
TABLE = b"RMT1"
_TABLE_HEAD = struct.Struct("<4sIIII")  # magic, symbols, bytes that follow, scale, their crc32
_LOW = np.uint64(1 << 31)
_U = np.uint64
_HEAD = struct.Struct("<4sIIIIIQ")  # magic, documents, tokens, lanes, words, flags, crc32 of tokens and of all that follows
CONTINUES = 1


class Corrupt(ValueError):
    """A block whose bytes or tokens don't match their checksums."""


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2 ** scale``, at least 1 for every symbol that occurs, in proportion otherwise."""
    counts = np.asarray(counts, dtype=np.int64)
    total, size = int(counts.sum()), 1 << scale
    if not total:
        counts, total = np.ones_like(counts), len(counts)
    seen = np.flatnonzero(counts)
    if len(seen) > size:
        raise ValueError("more symbols than the scale has places for")
    out = np.zeros(len(counts), dtype=np.int64)
    out[seen] = np.maximum(1, (counts[seen].astype(float) * size / total).astype(np.int64))
    order = seen[np.argsort(-out[seen], kind="stable")]
    left = size - int(out.sum())
    if left > 0:
        out[order[0]] += left
    for i in order:
        if left >= 0:
            break
        take = min(-left, int(out[i]) - 1)
        out[i] -= take
        left += take
    return out


@dataclass
class Table:
    """Shared frequency table: frequency and first place of each symbol, and the symbol of each place."""

    frequency: np.ndarray
    start: np.ndarray
    symbol: np.ndarray
    scale: int

    @classmethod
    def of(cls, frequency: np.ndarray, scale: int = SCALE) -> Table:
        frequency = np.asarray(frequency, dtype=np.uint64)
        start = np.cumsum(frequency) - frequency
        symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))
        return cls(frequency, start, symbol, scale)

    def pack(self) -> bytes:
        """The table as a record."""
        seen = np.flatnonzero(self.frequency)
        body = zlib.compress(np.diff(seen, prepend=0).astype("<u4").tobytes() + self.frequency[seen].astype("<u4").tobytes(), 1)
        return _TABLE_HEAD.pack(TABLE, len(self.frequency), len(body), self.scale, zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: bytes, at: int = 0) -> tuple[Table, int]:
        """The table of the record at ``at``, and where the record ends."""
        if len(data) - at < _TABLE_HEAD.size:
            raise Corrupt("a table's head is cut off")
        magic, symbols, size, scale, check = _TABLE_HEAD.unpack_from(data, at)
        body = data[at + _TABLE_HEAD.size : at + _TABLE_HEAD.size + size]
        if magic != TABLE or len(body) != size or zlib.crc32(body) != check:
            raise Corrupt("the table doesn't match its checksum")
        values = np.frombuffer(zlib.decompress(body), dtype="<u4").astype(np.int64)
        steps, found = values[: len(values) // 2], values[len(values) // 2 :]
        frequency = np.zeros(symbols, dtype=np.int64)
        frequency[np.cumsum(steps)] = found
        return cls.of(frequency, scale), at + _TABLE_HEAD.size + len(body)

    def encode(self, tokens: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """States of the lanes and 32-bit words, in the order in which ``decode`` reads them."""
        lanes = max(1, min(lanes, len(tokens)))
        state = np.full(lanes, _LOW)
        words = []
        f_all, c_all = self.frequency[tokens], self.start[tokens]
        shift, scale = _U(63 - self.scale), _U(self.scale)
        for row in range((len(tokens) - 1) // lanes, -1, -1):
            f, c = f_all[row * lanes : (row + 1) * lanes], c_all[row * lanes : (row + 1) * lanes]
            x = state[: len(f)]
            full = x >= (f << shift)
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> _U(32), x)
            quotient = x // f
            state[: len(f)] = (quotient << scale) + (x - quotient * f) + c
        return state, np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)

    def decode(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        state, lanes, at = state.astype(np.uint64), len(state), 0
        out = np.empty(n, dtype=np.uint32)
        mask, scale = _U((1 << self.scale) - 1), _U(self.scale)
        for begin in range(0, n, lanes):
            size = min(lanes, n - begin)
            x = state[:size]
            place = x & mask
            symbol = self.symbol[place]
            out[begin : begin + size] = symbol
            x = self.frequency[symbol] * (x >> scale) + place - self.start[symbol]
            empty = np.flatnonzero(x < _LOW)
            if len(empty):
                if at + len(empty) > len(words):
                    raise Corrupt("the block ends early")
                x[empty] = (x[empty] << _U(32)) | words[at : at + len(empty)]
                at += len(empty)
            state[:size] = x
        if at != len(words) or not (state == _LOW).all():
            raise Corrupt("the block doesn't end where its tokens do")
        return out


def block(table: Table, ids: list[int | None], sizes: list[int], tokens: np.ndarray, continues: bool) -> bytes:
    """A block: head, documents (id, whether it has one, tokens here), checkpoint, words."""
    state, words = table.encode(tokens)
    body = b"".join(
        [
            np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes(),
            np.array([i is not None for i in ids], dtype=np.uint8).tobytes(),
            np.array(sizes, dtype="<u4").tobytes(),
            state.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    check = zlib.crc32(tokens.astype("<u4").tobytes()) << 32 | zlib.crc32(body)
    return _HEAD.pack(MAGIC, len(ids), len(tokens), len(state), len(words), CONTINUES * continues, check) + body


def blocks(table: Table | None, data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, bool]]:
    """Ids, sizes and tokens of the blocks in ``data``, and whether the last document goes on in the next."""
    at = 0
    while at < len(data):
        if data[at : at + 4] == TABLE:
            table, at = Table.unpack(data, at)
            continue
        if table is None or len(data) - at < _HEAD.size:
            raise Corrupt("a block's head is cut off, or it has no table")
        magic, n_docs, n, lanes, n_words, flags, check = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise Corrupt("not a block")
        at += _HEAD.size
        end = at + 13 * n_docs + 8 * lanes + 4 * n_words
        body = data[at:end]
        if len(body) != end - at or zlib.crc32(body) != check & 0xFFFFFFFF:
            raise Corrupt("the block's bytes don't match their checksum")
        ids = np.frombuffer(body, dtype="<i8", count=n_docs)
        has = np.frombuffer(body, dtype=np.uint8, count=n_docs, offset=8 * n_docs)
        sizes = np.frombuffer(body, dtype="<u4", count=n_docs, offset=9 * n_docs).astype(np.int64)
        state = np.frombuffer(body, dtype="<u8", count=lanes, offset=13 * n_docs)
        words = np.frombuffer(body, dtype="<u4", count=n_words, offset=13 * n_docs + 8 * lanes)
        tokens = table.decode(state, words, n)
        if zlib.crc32(tokens.astype("<u4").tobytes()) != check >> 32:
            raise Corrupt("the tokens don't match their checksum")
        yield [int(i) if h else None for i, h in zip(ids, has, strict=True)], sizes, tokens, bool(flags & CONTINUES)
        at = end
