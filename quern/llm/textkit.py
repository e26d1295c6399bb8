"""Vectorised work on Arrow string columns: bytes and offsets in, numpy arrays out.

Every function looks at whole texts. Null texts count as empty. Chunks bound the memory of
the temporary arrays; one text longer than a chunk forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit constants."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(z) | np.uint64(1)


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BYTE_CODE = splitmix(256, 11)
_STEP = np.uint64(0x9FB21C651E98DF25)
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd constant, modulo 2**64."""
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 4096), _STEP)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of each text in the bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def run_hashes(raw: np.ndarray, keep: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash each run of kept bytes; runs also end at the offsets in breaks.

    Returns the runs' hashes, first bytes and lengths. A-Z are hashed as a-z.
    """
    at = np.flatnonzero(keep)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    cut = np.zeros(len(raw) + 1, bool)
    cut[breaks] = True
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    first |= cut[at]
    head = np.flatnonzero(first)
    length = np.diff(np.append(head, len(at)))
    return hash_runs(raw[at], head, length), at[head], length


def hash_runs(kept: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of adjacent, non-empty runs of kept, given their heads and lengths."""
    place = np.arange(len(kept)) - np.repeat(head, length)
    with np.errstate(over="ignore"):
        part = BYTE_CODE[LOWER[kept]] * powers(int(length.max()))[place]
        return mix64(np.add.reduceat(part, head) + length.astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (one more at the end)."""
    hashes, first, _ = run_hashes(raw, ~IS_WS[raw], offsets)
    return hashes, np.searchsorted(first, offsets)


_SHINGLE = splitmix(64, 23)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of k-word shingles; of a shorter text, one of its whole sequence; none without words."""
    for _, _, raw, offsets in chunks(texts):
        words, first = word_hashes(raw, offsets)
        with np.errstate(over="ignore"):
            if len(words) >= k:
                rolled = words[: len(words) - k + 1] * _SHINGLE[0]
                for j in range(1, k):
                    rolled = rolled + words[j : len(words) - k + 1 + j] * _SHINGLE[j]
                rolled = mix64(rolled)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= k:
                    s = np.sort(rolled[a : b - k + 1])
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    yield s[keep]
                elif b > a:
                    yield mix64((words[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
                else:
                    yield np.zeros(0, np.uint64)
