"""Whole texts as flat numpy arrays inside tasks: words, fingerprints, windows.

A batch of texts is cut into slices of about a megabyte (a longer text is a slice of its
own), so a task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240117


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


BLANK_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))  # [^\x20\x09-\x0D]
PLAIN_WORDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit value for an ordered pair of 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(a.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + mix(b.astype(np.uint64)))


@dataclass(frozen=True)
class Slice:
    """Some consecutive texts of a batch: text ``k`` is ``data[offsets[k]:offsets[k + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        own = offsets[at : end + 1]
        yield Slice(at, data[own[0] : own[-1]], own - own[0])
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse.

    They live once in a worker process: a task brings its own copy of this module, and
    tables held there would pile up until Python collects its garbage.
    """
    held = sys.modules.setdefault("_rolling_powers", types.ModuleType("_rolling_powers")).__dict__
    if len(held.get("powers", ((), ()))[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        if n > 4 * SLICE_BYTES:  # one very long text: not kept
            return both[0], both[1]
        held["powers"] = (both[0], both[1])
    return held["powers"]


_CODES = np.random.default_rng(_SEED).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Fingerprints of any stretch of a slice, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def raw(self, length: int) -> np.ndarray:
        """Of every stretch of ``length`` bytes, not mixed."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]


@dataclass(frozen=True)
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # number of the text in its slice
    code: np.ndarray  # 64-bit fingerprint
    counts: np.ndarray  # words of each text


def words_of(part: Slice, kind: np.ndarray = BLANK_WORDS, lower: bool = True, breaks: int | None = None) -> tuple[Words, np.ndarray]:
    """Words of a slice and the bytes they were read from; ``breaks`` also ends a text's unit (lines)."""
    data = LOWER[part.data] if lower else part.data
    inside = kind[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[part.offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    doc = np.searchsorted(part.offsets, starts, side="right") - 1
    code = Rolling(data).of(starts, ends)
    return Words(starts, ends, doc, code, np.bincount(doc, minlength=len(part))), data


def windows(code: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each run of ``size`` consecutive words of a slice."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    base = np.uint64(0xC6A4A7935BD1E995)
    for k in range(size):
        out *= base
        out += code[k : k + n]
    return mix(out + np.uint64(size))


def in_one(doc: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words stay inside one text."""
    n = len(doc) - size + 1
    return doc[:n] == doc[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def characters(part: Slice) -> np.ndarray:
    """Prefix counts of code points: entry ``i`` is the number that start before byte ``i``."""
    out = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of several stretches, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift
