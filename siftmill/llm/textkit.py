"""Vectorised text kernels shared by the corpus operators.

Everything works on whole Arrow batches: the UTF-8 buffer of a string column is
viewed as bytes and cut into words with numpy, so no Python object is made per word.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of
the lower-cased text; in SQL ``regexp_extract_all(lower(text), WORD)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word pattern in RE2 syntax, for oracles.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
_KIND = np.where(np.arange(256) > 32, 2, 0).astype(np.int8)
_KIND[_IS_WORD] = _KIND[ord("A") : ord("Z") + 1] = 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[which] = np.multiply.accumulate(full)
    return have[:n]


@dataclass
class Words:
    """The words of a batch: ``hash[first[d]:first[d + 1]]`` are those of row d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, lo: int, hi: int) -> str:
        """Words lo..hi-1 (same row) as they stand, with what lies between them."""
        return self.data[self.start[lo] : self.end[hi - 1]].tobytes().decode("utf-8", "replace")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if off is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], one for each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n - 1), out=total[1:])
    lengths = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * _power("down", _INV, n)[start] + mix(lengths))


def words(column: pa.Array) -> Words:
    """Cut every text of a string column into words."""
    return cut(*utf8(pc.utf8_lower(column)), _IS_WORD.astype(np.int8))


def tokens(column: pa.Array) -> Words:
    """Cut every text, case as it is, into runs of letters and digits and runs of other signs."""
    return cut(*utf8(column), _KIND)


def cut(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, between: int = 32) -> Words:
    """Cut the rows of a UTF-8 buffer into runs of bytes of one kind, other than 0; ``between`` is a byte of kind 0."""
    n = len(raw)
    # a separator before every row keeps words of neighbouring rows apart
    data = np.full(n + len(offsets) - 1, between, np.uint8)
    if n:
        keep = np.ones(len(data), bool)
        keep[offsets[:-1] + np.arange(len(offsets) - 1)] = False
        data[keep] = raw
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = kinds[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    start, end = edge[kind[edge + 1] != 0], edge[kind[edge] != 0]
    bounds = np.append(offsets[:-1] + np.arange(len(offsets) - 1), len(data))
    return Words(data, start, end, span_hash(data, start, end), np.searchsorted(start, bounds))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether all of them lie in its row."""
    size = len(w.hash)
    out = np.zeros(size, np.uint64)
    ok = np.zeros(size, bool)
    if size >= n:
        base = np.uint64(0xD6E8FEB86659FD93)
        for i in range(n):
            out[: size - n + 1] = out[: size - n + 1] * base + w.hash[i : size - n + 1 + i]
        out = mix(out)
        left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(size)
        ok = left >= n
    return out, ok
