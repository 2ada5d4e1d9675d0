"""Blocked Bloom filters: Spark sets the bits, numpy looks up. A hash has one block of 512 bits and one bit in each 64-bit lane of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rollmark.llm.texts import mix

LANES = 8
BLOCK_BITS = 64 * LANES
_U = np.uint64


def lane_bits(hashes: np.ndarray) -> np.ndarray:
    """Six bits for each lane: the bit that a hash sets there."""
    return mix(hashes + _U(0x632BE59BD9B4E019))


def block_numbers(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)


def block_column(hashes: str, blocks: Column) -> Column:
    """``block_numbers`` of a long column."""
    return F.shiftright(F.shiftrightunsigned(hashes, 32) * blocks, 32)


def collect_blocks(rows: DataFrame, start: int, size: int) -> np.ndarray:
    """The lanes of ``size`` blocks from ``start`` on, as a matrix of lanes by blocks; ``rows`` has ``block`` and ``lanes``.

    At most ``size`` rows of 72 bytes come to the driver.
    """
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(lanes, {6 * j}) & 63 as int))")).alias(f"lane{j}") for j in range(LANES)]
    found = rows.groupBy("block").agg(*bits).toArrow()
    out = np.zeros((LANES, size), dtype=_U)
    at = found.column("block").to_numpy() - start
    for j in range(LANES):
        out[j, at] = found.column(f"lane{j}").to_numpy().view(_U)
    return out


def look_up(lanes: np.ndarray, places: np.ndarray, blocks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Those of ``places`` whose hash may be in its block; ``blocks`` and ``hashes`` belong to the places."""
    bits = lane_bits(hashes)
    for lane in range(LANES):
        hit = (lanes[lane, blocks] >> ((bits >> _U(6 * lane)) & _U(63))) & _U(1) == 1
        places, blocks, bits = places[hit], blocks[hit], bits[hit]
    return places
