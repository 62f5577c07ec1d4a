"""Polynomial hashes of whole Arrow batches of texts in numpy; no text becomes a Python string."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Texts are worked on together up to so many bytes; a longer text is worked on alone.
TOGETHER = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each of the bits over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * BASE + U(seed))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, TOGETHER + 1)
        back = pow(int(BASE), -1, 1 << 64)
        for name, base in (("up", int(BASE)), ("down", back)):
            step = np.full(size, base, dtype=U)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """s[i] is the sum of code * BASE ** place over the first i symbols: bytes, or words given by their hashes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U)
    codes = byte_codes(seed)[data] if data.dtype == np.uint8 else mix(data + U(seed) * BASE)
    np.cumsum(codes * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, wherever it lies."""
    _, down = powers(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def groups(texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of texts that are worked on together. A null text counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + together, side="right")) - 1)
        j = min(j, len(texts))
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, start, end) of every word; words end at white space and where a text ends."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_SPACE[data]
    first = np.zeros(len(data), dtype=bool)
    begins = offsets[:-1]
    first[begins[begins < len(data)]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts among them)."""
    of, starts, ends = words(data, offsets)
    each = mix(span_hashes(prefix_sums(data), starts, ends)) if len(of) else np.zeros(0, U)
    return each, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every window of `size` words; a shorter text with words is one window of all of them."""
    of, starts, ends = words(data, offsets)
    if not len(of):
        return of, np.zeros(0, U)
    each = mix(span_hashes(prefix_sums(data), starts, ends))
    n = np.bincount(of, minlength=len(offsets) - 1)
    out = np.zeros(len(of), dtype=U)
    up = powers(size + 1)[0]
    left = np.cumsum(n)[of] - np.arange(len(of))  # words from here to the text's end
    for j in range(size):
        here = np.flatnonzero(left > j)
        out[here] += each[here + j] * up[j + 1]
    place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    whole = (left >= size) | ((place == 0) & (n[of] < size))
    return of[whole], mix(out[whole])
