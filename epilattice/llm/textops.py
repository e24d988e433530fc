"""Vectorised text helpers for Arrow batches inside tasks: words, rolling hashes, and merged counting sketches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.settled import released

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32
#: Odd multipliers of the polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP = 1 << 19
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, STEP + 1)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (base, inverse))
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives freed memory back: a worker lives through many tasks, idle ones beside those at work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def steps(texts: pa.Array, size: int = STEP):
    """Cuts a string column into (first row, bytes, offsets) of about `size` bytes; null is the empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    release()


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where mask holds, cut at the texts' ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:n]
    ends[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i modulo 2^64, from 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def hashed(starts: np.ndarray, ends: np.ndarray, pre: np.ndarray, base: int) -> np.ndarray:
    """Position-free hashes of the spans, from prefix sums."""
    return mix((pre[ends] - pre[starts]) * powers(base, len(pre))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Words [^\\x20\\x09-\\x0D]+ : (starts, ends, hash of each, first word of each text and the end)."""
    starts, ends = spans(~SPACE[data], offs)
    source = UPPER[data] if lower else data
    h = hashed(starts, ends, prefix(source.astype(np.uint64) + np.uint64(1), BASES[0]), BASES[0])
    return starts, ends, h, np.searchsorted(starts, offs)


def windows(h: np.ndarray, first: np.ndarray, width: int, base: int = BASES[1]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside one text: (index of the first word, hash)."""
    counts = np.diff(first)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(first[1:], counts)[:n]  # the end of the text that holds the first word
    at = np.flatnonzero(np.arange(n) + width <= last)
    return at, hashed(at, at + width, prefix(h, base), base)


def sorted_sets(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch code[at[i]:at[i + 1]] sorted and without repeats, and where each one begins then."""
    code = code.copy()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        code[s:e].sort()
    new = np.ones(len(code), bool)
    if len(code):
        new[1:] = code[1:] != code[:-1]
        new[at[:-1][np.diff(at) > 0]] = True
    return code[new], np.concatenate([[0], np.cumsum(new)])[at]


# Counting sketches: each task counts into rows of cells, packs them, and Spark sums them block by block.

BLOCK = 1 << 20


def sketch_cells(h: np.ndarray, rows: int, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of a sketch with 2^bits cells a row."""
    out = []
    for r in range(rows):
        out.append((mix(h + np.uint64((r + 1) * BASES[0] % 2**64)) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def merged_sketch(parts: DataFrame, rows: int, bits: int, most: int) -> np.ndarray:
    """Sums the tasks' sketches, parts(block int, cells binary), up to `most`: an array of rows x 2^bits cells, of 8, 32
    or 64 bits as `most` needs; the tasks' cells are of the same kind. Sums are of 64 bits, so none wraps below `most`.

    Spark deals and sums the blocks; what reaches the driver is one sketch, whose size does not depend on the data.
    """
    kind = np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64

    def add(frame):
        total = np.uint64(0)
        for cells in frame["cells"]:
            total = total + np.frombuffer(zstandard.decompress(cells), kind).astype(np.uint64)
        packed = zstandard.compress(np.minimum(total, np.uint64(most)).astype(kind).tobytes(), 1)
        return frame[["block"]].head(1).assign(cells=[packed])

    def fold(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).applyInPandas(lambda f: add(f), "block int, cells binary")

    # first in groups of tasks, then all: no task holds a block of every part
    once = fold(parts.withColumn("_g", F.pmod(F.xxhash64("cells"), F.lit(16))), ["block", "_g"])
    out = np.zeros(rows << bits, kind)
    with released(parts.sparkSession):
        summed = fold(once, ["block"]).collect()
    for r in summed:
        cells = np.frombuffer(zstandard.decompress(bytes(r.cells)), kind)
        out[r.block * BLOCK : r.block * BLOCK + len(cells)] = cells
    return out.reshape(rows, 1 << bits)


def sketch_rows(counts: np.ndarray):
    """A task's sketch as Arrow batches of (block, cells); blocks without counts are left out."""
    flat = counts.reshape(-1)
    for b in range(0, len(flat), BLOCK):
        part = flat[b : b + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b // BLOCK], pa.int32()), "cells": pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())})
