"""Words and word hashes of whole Arrow text columns, a few megabytes at a time, in numpy.

Both word rules of the operators are rules on bytes, because every byte of a non-ASCII character is over 0x7F:
SPACE takes runs of anything but 0x20 and 0x09-0x0D, ALNUM runs of 0-9, a-z (A-Z are lower-cased first) and
non-ASCII characters. Hashes are 64-bit polynomials of the lower-cased bytes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 3 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
LETTER = ALNUM.copy()
LETTER[48:58] = False

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["p"]) < n:
        for key, base in (("p", _P), ("i", _INV)):
            x = np.full(((n >> 18) + 2) << 18, base, dtype=np.uint64)  # room for pieces that are somewhat longer
            x[0] = 1
            _POW[key] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_pieces(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them), whole rows, about ``chunk`` bytes a piece."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + chunk, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """The words of a piece: ``low`` (lower-cased bytes), ``start``, ``end``, ``doc`` of each, ``first`` word of each row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.low = low = LOWER[buf]
        self.off, n = off, len(off) - 1
        flag = table[low]
        begin, end = flag.copy(), flag.copy()
        begin[1:] &= ~flag[:-1]
        end[:-1] &= ~flag[1:]
        at = off[:-1][off[:-1] < off[1:]]  # words end where a row ends
        begin[at] = flag[at]
        at = off[1:][off[:-1] < off[1:]] - 1
        end[at] = flag[at]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, inv = _powers(len(self.low) + 1)
        c = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * p[: len(self.low)], out=c[1:])
        return mix((c[self.end] - c[self.start]) * inv[self.start])

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


_Q = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 65)]


def windows(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the ``m`` words from each position in ``at`` on."""
    s = np.full(len(at), np.uint64(m), np.uint64)
    for k in range(m):
        s += h[at + k] * np.uint64(_Q[k % 64] ^ (k // 64 << 1))
    return mix(s)


def shingle_sets(w: Words, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with fewer words, the whole sequence as one; without, none."""
    h = w.hashes()
    at = np.arange(max(0, len(h) - size + 1))
    s = windows(h, at, size)
    for k, n in enumerate(w.count):
        a = w.first[k]
        if n >= size:
            yield np.unique(s[a : a + n - size + 1])
        else:
            yield windows(h, np.array([a]), int(n)) if n else np.zeros(0, np.uint64)
