"""Vectorised hashes of words and byte windows."""

from __future__ import annotations

import re

import numpy as np

from .common import LOWER, UPPER

U = np.uint64
#: Any odd base has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(7919)
#: Random 64-bit value of each byte.
BYTES = _rng.integers(0, 2**64, 256, dtype=U)
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    p, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, U)
    np.cumsum(BYTES[b] * p[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each b[start:end] from the prefix sums; equal strings, equal hashes."""
    _, inverse = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


#: Random value of each byte at each of the first places of a word.
PLACES = 64
AT_PLACE = _rng.integers(0, 2**64, (PLACES, 256), dtype=U).ravel()
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
CHUNK = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space) of a folded text, in order.

    A word's hash sums random values of its bytes at their places (tables for the first ones, a mixing function beyond), so words that
    differ anywhere have independent hashes, unlike those of a polynomial modulo 2^64.
    """
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        found = SPACE.search(text, end)
        end = found.start() if found else len(text)
        b = np.frombuffer(text, np.uint8, end - at, at)
        space = np.concatenate([[True], IS_SPACE[b], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        place = np.arange(len(b), dtype=np.int64)
        last = np.zeros(len(b), np.int64)
        last[starts] = starts
        place -= np.maximum.accumulate(last)
        value = AT_PLACE[np.minimum(place, PLACES - 1) << 8 | b]
        far = np.flatnonzero(place >= PLACES - 1)
        if len(far):
            value[far] = mixed(place[far].astype(U) * U(256) + b[far] + U(BASE))
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(value, out=sums[1:])
        out.append(mixed(sums[ends] - sums[starts] + (ends - starts).astype(U) * U(BASE)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)
