"""Words and their hashes, in bulk.

A word is a longest run of bytes other than space and \\x09-\\x0D in the UTF-8 text; bytes.split() cuts just there. Words are
found and hashed as arrays, without an object for each: a word's hash is a polynomial of its bytes modulo 2 ** 64 (each byte
value stands for a random number), read off prefix sums and mixed; two different words share one about once in 1.8e19 pairs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_libc = ctypes.CDLL(None)

#: No word is white space, so these hashes stand for no word.
END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\n")), np.uint64(xxhash.xxh3_64_intdigest(b"\t"))

M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A word of more bytes is hashed by itself, and bytes whose words are hashed at once where none is longer: they stay in the cache.
RUN, NEAR = 1 << 19, 1 << 14


def _powers(base: int) -> np.ndarray:
    out = np.full(RUN + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_random = np.random.default_rng(20240607)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE = int(_random.integers(1, 1 << 63)) * 2 + 1
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def lowered(raw: np.ndarray) -> np.ndarray:
    """An array of bytes with A-Z in lower case."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of an array of bytes."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)  # uint8 wraps around
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end]; both ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + NEAR, side="right"))
        if j <= i and ends[i] <= starts[i] + RUN:
            j = i + 1
        if j <= i:  # one word of more than RUN bytes
            out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.zeros(b - a + 1, dtype=np.uint64)
        terms = _BYTE[raw[a:b]]
        terms *= _POWER[: b - a]
        np.cumsum(terms, out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * _INVERSE[starts[i:j] - a]
        i = j
    return mix(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, each closed by a line break, and where each ends."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    return raw, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)


def hashed(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case if asked for, and the number of words of each text."""
    raw, borders = joined(texts)
    if lower:
        raw = lowered(raw)
    starts, ends = spans(raw)
    return hashes(raw, starts, ends), np.diff(np.searchsorted(starts, borders), prepend=0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(M2)
    return x ^ (x >> np.uint64(32))


INV1, INV2 = pow(M1, -1, 1 << 64), pow(M2, -1, 1 << 64)


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(INV2)
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * np.uint64(INV1)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of size words, text by text, and their numbers; a text of fewer words gives one hash of them all, one of none none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(M1) + h[k : n + k]
        out ^= out >> np.uint64(31)
    at = ragged(starts, number)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if not len(few):
        return mix(out[at]), number
    whole = np.zeros(len(at), dtype=np.uint64)
    fits = np.repeat(counts >= size, number)
    whole[fits] = out[at[fits]]
    place = np.cumsum(number) - number
    for i in few.tolist():
        v = 0
        for x in h[starts[i] : ends[i]].tolist():
            v = (v * M1 + x) % (1 << 64)
            v ^= v >> 31
        whole[place[i]] = v
    return mix(whole), number


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, size numbers each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


#: What drops large caches that a worker has from tasks of another operator.
drops: list[Callable[[], None]] = []


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most about limit bytes in the column, one row at least; a worker then gives memory back.

    Workers outlive their operators: what those have in drops goes first, unless the task is to keep it.
    """
    if drops and not keep:
        for drop in drops:
            drop()
        release()
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            n = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield b.slice(at, n - at)
            at = n
    release()


def release() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, each text closed by END, and the number of tokens of each."""
    words, counts = hashed(texts, lower=True)
    out = np.full(len(words) + len(texts), END, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, counts + 1
