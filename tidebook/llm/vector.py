"""Numpy kernels over whole Arrow batches of texts: word hashes, shingle sets, SuperMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; temporaries take some 40 bytes a byte.
PIECE = 1 << 20
G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * G) | np.uint64(1)
for _upper in range(65, 91):
    CODES[_upper] = CODES[_upper + 32]
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
CODES[WHITE] = 0
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one: sums of powers modulo 2**64 can be made equal by words of a thousand letters.
LONG_WORD = 256
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(n, 4096) - 1, BASE, dtype=np.uint64))])
    return _powers


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(data: np.ndarray, separates: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the start of each word of some bytes; `separates` are the bytes between words, A-Z count as a-z."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    white = separates[data]
    first = ~white
    first[1:] &= white[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.arange(len(data), dtype=np.int32)
    since = at - np.maximum.accumulate(np.where(first, at, 0))
    since[white] = 0
    values = CODES[data] * powers(int(since.max()) + 1)[since]
    values[white] = 0
    hashes = mix(np.add.reduceat(values, starts))
    if since.max() >= LONG_WORD:
        last = ~white
        last[:-1] &= white[1:]
        ends = np.flatnonzero(last) + 1
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return hashes, starts


def words_of(text: bytes, separates: np.ndarray = WHITE) -> np.ndarray:
    """Word hashes of one text of any length, in pieces that end between words."""
    data, found, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            gaps = np.flatnonzero(separates[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + PIECE)
        found.append(word_hashes(data[at:end], separates)[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def words_of_each(batch: list[bytes], separates: np.ndarray = WHITE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of the texts, as (index of the first, one array per text), for runs of texts of about a piece."""
    i = 0
    while i < len(batch):
        n, j = 0, i
        while j < len(batch) and (j == i or n + len(batch[j]) < PIECE):
            n += len(batch[j]) + 1
            j += 1
        if j == i + 1:
            yield i, [words_of(batch[i], separates)]
        else:
            bounds = np.cumsum([0] + [len(x) + 1 for x in batch[i:j]])
            hashes, starts = word_hashes(np.frombuffer(b" ".join(batch[i:j]), np.uint8), separates)
            yield i, np.split(hashes, np.searchsorted(starts, bounds[1:-1]))
        i = j


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words together if there are fewer, but some."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mix(h * G + words[k : n - size + 1 + k])
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets), m) of sets of 64-bit hashes; m is prime.

    Each element visits all registers in an order of its own, one a round, and offers round + fraction: the
    ranks are correlated, as no element offers two registers the same rank. A register keeps the least
    offer, so what a round fills no later round changes, and a set stops early, when all registers are
    full. An order is ``(a + b * round) mod m`` with a and b from the element's hash.
    """
    sizes = np.array([len(s) for s in sets])
    full = np.full(len(sets) * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sizes.sum():
        return full.reshape(len(sets), m)
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    register = (mix(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
    stride = (mix(x + np.uint64(0x14057B7EF767814F)) % np.uint64(m - 1)).astype(np.int64) + 1
    base, empty, last = owner * m, np.ones(len(full), dtype=bool), np.uint64(np.iinfo(np.uint64).max - 1)
    for turn in range(m):
        at = base + register
        open_ = empty[at]
        slots = at[open_]
        np.minimum.at(full, slots, np.minimum(mix(x[open_] + G * np.arange(turn, turn + 1, dtype=np.uint64)), last))
        empty[slots] = False
        left = empty.reshape(len(sets), m).any(axis=1)
        go = left[owner]
        if not go.any():
            break
        if go.mean() < 0.7:
            x, owner, base, register, stride = x[go], owner[go], base[go], register[go], stride[go]
        register = register + stride
        register[register >= m] -= m
    return full.reshape(len(sets), m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature, as int64; keys of different bands differ."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + G), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * G + parts[:, :, k])
    return keys.view(np.int64)
