"""Word and window hashes of Arrow text columns, computed with numpy on the column's bytes.

A text is a run of bytes; a word is a longest run of bytes that ``is_word`` marks. A word's hash is the polynomial of its
bytes modulo the prime 2**61 - 1, finished by a mixer: two words of n bytes have equal hashes for n bases at most of the
2.3e18 there are, whatever their form, and equal words have equal hashes on every executor. Windows of few words are
polynomials modulo 2**64 over these well mixed values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: Bytes of words that white space separates: not space, not \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Maps A-Z to a-z and leaves other bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, base, U)
            down = np.full(size, inverse, U)
            up[0] = down[0] = 1
            have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:
            _powers[base] = have
    return have


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for each pair, independent of where the span lies.

    For windows of well mixed values only: spans of many few-valued items may collide by their form.
    """
    up, down = _powers_of(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(_BASE))


P = U((1 << 61) - 1)
#: A word's base, drawn once at random below the prime.
_WORD_BASE = 0x16B7A3F90D2C4E85
#: Longer words are hashed one by one: the sums below would overflow.
_LONG_WORD = 1 << 22
_prime_powers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for numbers below it."""
    low, half = U(0xFFFFFFFF), U(29)
    a1, a0, b1, b0 = a >> U(32), a & low, b >> U(32), b & low
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    total = (a1 * b1 << U(3)) + (middle >> half) + ((middle & U((1 << 29) - 1)) << U(32)) + (least >> U(61)) + (least & P)
    total = (total & P) + (total >> U(61))
    return np.where(total >= P, total - P, total)


def _prime_powers_of(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the word base modulo the prime, as lower and upper parts, and those of its inverse: at least n of each."""
    if not _prime_powers or len(_prime_powers[0][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for base in (_WORD_BASE, pow(_WORD_BASE, -1, int(P))):
            out = np.ones(size, U)
            have, step = 1, base
            while have < size:  # doubles what is there
                out[have : 2 * have] = times(out[:have], np.full(have, step, U))
                have, step = 2 * have, step * step % int(P)
            both.append(out)
        made = (both[0] & U(0xFFFFFFFF), both[0] >> U(32), both[1])
        if size > 1 << 23:
            return made
        _prime_powers[:] = [made]
    return _prime_powers[0]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes data[start:end] for each pair, independent of where they lie."""
    if not len(start):
        return np.zeros(0, U)
    *pieces, down = _prime_powers_of(len(data) + 1)
    length = end - start
    value = data.astype(U) + U(1)
    parts = []
    for piece in pieces:  # below 2**41 a byte: no overflow within a word
        total = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(value * piece[: len(data)], out=total[1:])
            parts.append(total[end] - total[start])
    low, high = parts
    half = high & U((1 << 29) - 1)
    total = (low & P) + (low >> U(61)) + (high >> U(29)) + (half << U(32))
    total = (total & P) + (total >> U(61))
    with np.errstate(over="ignore"):
        out = mix(times(np.where(total >= P, total - P, total), down[start]) ^ (length.astype(U) * U(_BASE)))
    for k in np.flatnonzero(length > _LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of several texts: hash, byte span of each, and the index of each text's first word (with the end)."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, fold: np.ndarray = AS_IS) -> Words:
    n = len(data)
    word = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], word[:-1])) if n else word
    after = np.concatenate((word[1:], [False])) if n else word
    start = np.flatnonzero(word & (~before | first[:n]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    hashes = strings(fold[data], start, end)
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def windows_of(w: Words, size: int, seed: int = 0x1B873593CC9E2D51) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they all lie in its text."""
    n = len(w.hashes)
    left = np.repeat(w.offsets[1:], w.counts) - np.arange(n)
    fits = left >= size
    out = np.zeros(n, U)
    at = np.flatnonzero(fits)
    out[at] = spans(w.hashes, at, at + size, seed | 1)
    return out, fits


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of pieces of a text column of about ``most`` bytes; null texts are empty.

    A text is never cut, so a piece holds one text at least.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
