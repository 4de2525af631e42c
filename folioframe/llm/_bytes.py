"""Small numpy helpers over UTF-8 bytes, used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INV = U64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are looked at together, so that temporary arrays stay small.
CHUNK = 1 << 18

_pow = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    if _pow["n"] < n:
        n = max(n, CHUNK)
        one = np.ones(n + 1, U64)
        one[1:] = BASE
        _pow["up"] = np.multiply.accumulate(one)
        one[1:] = INV
        _pow["down"], _pow["n"] = np.multiply.accumulate(one), n
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> U64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; see span_hash."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for spans with equal values, wherever they stand."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def columns(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def class_table(separators: str | range | list) -> np.ndarray:
    """True for the bytes of words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: What separates words for the two word definitions.
WHITE = class_table([0x20, *range(0x09, 0x0E)])
ALNUM = class_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word (start, end, row) in ``data``, whose rows begin at ``bounds[:-1]`` and end at ``bounds[-1]``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[data]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix(data.astype(U64) + U64(1)), starts, ends)
