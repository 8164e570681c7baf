"""Vectorised words and word hashes over the bytes of an Arrow string column.

Everything here works on one slice of a column (about half a megabyte of text, or one longer text), so the memory of a task doesn't
depend on how many rows an Arrow batch has. Nulls are empty texts; whoever has to tell them apart looks at the column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
#: Two primes under 2^31: polynomials modulo a power of two would give a Thue-Morse word and its complement the same value.
_PRIMES = (2147483629, 2147483587)
_BYTES = [np.random.default_rng(20240229 + k).integers(1, p, 256).astype(np.uint64) for k, p in enumerate(_PRIMES)]
_BASES = [int(np.random.default_rng(7 + k).integers(1 << 29, p - 1)) for k, p in enumerate(_PRIMES)]
_powers: list[list[np.ndarray]] = []


def word_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """For each byte whether it is part of a word, from the ranges of bytes that are not."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]+ on bytes: the bytes of a character beyond ASCII are all 0x80 or more.
NON_SPACE = word_table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on bytes, of text in lower case.
ALNUM = word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes of text and ``rows`` rows, or one row."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, at + rows, max(at + 1, to))
        yield at, to
        at = to


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts, with the end behind the last."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    text = whole[offsets[0] : offsets[-1]]
    return (LOWER[text] if lower else text), offsets - offsets[0]


def word_spans(text: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of its first word, with the end behind the last."""
    inside = table[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(text), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(text), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _geometric(base: int, prime: int, size: int) -> np.ndarray:
    """1, base, base^2, ... modulo prime, by doubling."""
    out = np.ones(1, U64)
    while len(out) < size:
        out = np.concatenate([out, out[: size - len(out)] * U64(pow(base, len(out), prime)) % U64(prime)])
    return out


def _power_tables(n: int) -> list[list[np.ndarray]]:
    """For each prime the powers of its base, and of the base's inverse."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        _powers[:] = [[_geometric(b, p, size), _geometric(pow(b, -1, p), p, size)] for b, p in zip(_BASES, _PRIMES, strict=True)]
    return _powers


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, the same wherever the word stands: polynomials modulo two primes, 62 bits in all, and the length."""
    out = np.zeros(len(starts), U64)
    for (power, inverse), prime, value in zip(_power_tables(len(text)), _PRIMES, _BYTES, strict=True):
        sums = np.zeros(len(text) + 1, U64)
        np.cumsum(value[text] * power[: len(text)] % U64(prime), out=sums[1:])
        out = out << U64(32) | (sums[ends] - sums[starts]) % U64(prime) * inverse[starts] % U64(prime)
    return mix(out + (ends - starts).astype(U64) * U64(_BASE))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that begin at each word, and whether the run stays inside the row of its first word."""
    n = len(words)
    inside = np.zeros(n, bool)
    counts = np.diff(first)
    for_rows = np.repeat(first[1:], counts)
    if n >= k:
        inside[: n - k + 1] = np.arange(n - k + 1) + k <= for_rows[: n - k + 1]
    out = np.zeros(n, U64)
    if n >= k:
        total = np.zeros(n - k + 1, U64)
        for j in range(k):
            total = total * U64(_BASE) + words[j : n - k + 1 + j]
        out[: n - k + 1] = mix(total)
    return out, inside


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
