"""Bytes, words and rolling hashes of a block of texts, as numpy arrays.

Every function works on the whole texts of one block (a few MB), which Spark
hands to a task; nothing here knows about Spark.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the rolling hashes (arbitrary fixed odd 64-bit numbers).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that a task handles at once in a stream of batches, and that are hashed at once.
SLICE_BYTES, HASH_BYTES = 1 << 20, (1 << 20) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection for each seed)."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


@lru_cache(maxsize=6)
def _powers_upto(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    with np.errstate(over="ignore"):
        up = np.full(size, base, dtype=U64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), dtype=U64)
        down[0] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers_upto(base, 1 << max(16, int(n - 1).bit_length()))
    return up[:n], down[:n]


def rolling(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; see ``span_hash``."""
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up, dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end], the same wherever the span stands."""
    _, down = powers(base, len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * down[start]


def equal_spans(prefix: np.ndarray, base: int, size: int) -> np.ndarray:
    """``span_hash`` of the ``size`` values from each place on, without index arrays."""
    _, down = powers(base, len(prefix))
    with np.errstate(over="ignore"):
        out = prefix[size:] - prefix[:-size]
        out *= down[: len(out)]
    return out


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEY = mix(np.arange(256, dtype=U64), 11)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


class Block:
    """Texts of one block: ``data`` all bytes, ``offsets`` where each text begins."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all
            texts = pa.array([], pa.string())
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        if len(texts):
            off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
            data, off = data[off[0] : off[-1]], off - off[0]
        else:
            data, off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.data = _LOWER[data] if lower else data
        self.offsets = off

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, between: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of bytes outside ``between`` (by default
        [\\x20\\x09-\\x0D]), and for each text the number of the first word (with one entry more)."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self) + 1, np.int64)
        white = between[self.data]
        edge = np.zeros(n + 1, dtype=bool)  # where a text begins or all ends
        edge[self.offsets] = True
        solid = ~white
        start = solid.copy()
        start[1:] &= white[:-1] | edge[1:n]
        end = solid.copy()
        end[:-1] &= white[1:] | edge[1:n]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
        """A 64-bit hash of every word, a stretch of words at a time."""
        out = np.empty(len(starts), dtype=U64)
        at = 0
        while at < len(starts):
            origin = int(starts[at])
            stop = max(at + 1, int(np.searchsorted(ends, origin + HASH_BYTES, side="right")))
            a, b = starts[at:stop] - origin, ends[at:stop] - origin
            prefix = rolling(_BYTE_KEY[self.data[origin : int(ends[stop - 1])]], base)
            with np.errstate(over="ignore"):
                out[at:stop] = mix(span_hash(prefix, base, a, b) + (b - a).astype(U64))
            at = stop
        return out


def unique(values: np.ndarray, counts: bool = False):
    """Distinct values in order (and how often each stands), by sorting."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if not counts:
        return ordered[new]
    first = np.flatnonzero(new)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def windows(first: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the words at which a window of ``length`` words of one text
    starts. ``first``: per text the number of its first word."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    total = int(count.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in one of the spans [start, start + length)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Parts of a batch with at most ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at : at + 65536])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, n)
        at += n
