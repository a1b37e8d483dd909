"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

All the words that the operators ask for are cut at ASCII characters, which no other character's UTF-8 bytes contain, so
bytes can be classified one by one. A word's 64-bit hash is a polynomial of its bytes modulo 2**64, mixed at the end; a
window's is a polynomial of its words' hashes, mixed likewise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed in one go; text is cut there at a border of words.
SEGMENT = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_VALUE = mixed(np.arange(256), 77)


def _kinds(separators) -> np.ndarray:
    kinds = np.ones(256, bool)
    kinds[list(separators)] = False
    return kinds


#: Whether a byte belongs to a word that white space ends: [^\x20\x09-\x0D]+
SPACED = _kinds([0x20, *range(0x09, 0x0E)])
#: The same for words of digits, letters and all that isn't ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once lower-cased.
ALNUM = _kinds([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """data: bytes of all texts, one line feed after each; begin, end: of each word; first: for each text the number of
    its first word, and the number of all words at last; hash: of each word."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words of its text from each word on, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.begin))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + SEGMENT, side="right")))
        low, high = int(begin[a]), int(end[b - 1])
        n = max(SEGMENT, high - low)
        if n not in _tables:
            # An empty span may stand right behind the last byte.
            tables = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
            if n == SEGMENT:
                _tables[n] = tables
        else:
            tables = _tables[n]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * tables[0][: high - low], out=sums[1:])
        at = begin[a:b] - low
        out[a:b] = (sums[end[a:b] - low] - sums[at]) * tables[1][at]
        a = b
    return mixed(out, 0)


def words(texts: list[bytes | None], kinds: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of the texts, given as UTF-8; null is a text without words."""
    data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    if lower:
        data = _LOWER[data]
    edge = np.diff(kinds[data].astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return Words(data, begin, end, first, _hashes(data, begin, end) if hashed else np.empty(0, np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of `size` words that begins at each word, whatever texts they are of; the last size - 1 words
    begin none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += hashes[k : n + k]
    return mixed(out, size)


def hash_of(values: np.ndarray) -> int:
    """One 64-bit hash of a sequence of 64-bit values."""
    n = len(values)
    if not n:
        return 0
    return int(mixed(np.array([np.sum(values * _powers(_STEP, n), dtype=np.uint64) + np.uint64(n)]), 5)[0])


def utf8(column) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
