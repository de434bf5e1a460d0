"""Words of whole texts as hashes: NumPy over the bytes of an Arrow batch, some megabytes at a time.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z. Its hash is the sum of one random
value for each pair of place and byte, modulo 2**64, mixed at the end. No arrangement of bytes makes two words collide
by design; any two have one hash with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
#: Places of a word with random values of their own; those of later ones are mixed from them and the round they are in.
_REACH = 64
_PLACE = _rng.integers(0, 2**64, (_REACH, 256), dtype=np.uint64)
_PLACE[:, 65:91] = _PLACE[:, 97:123]  # A-Z as a-z
_PLACE = _PLACE.ravel()
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words as runs of letters and digits, where other ASCII bytes part them.
PART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BLOCK = 1 << 20
_BITS = 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(column: pa.Array, limit: int = BLOCK):
    """Yields (first row, row offsets, bytes) for runs of rows of about limit bytes; a long text is a run of its own. Nulls are empty."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, off[at : end + 1] - off[at], data[off[at] : off[end]]
        at = end


def word_hashes(off: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a run of rows, and the place of each row's first word (one more at the end)."""
    rows = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(rows + 1, np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes(data[inside], end - start), start, end, np.searchsorted(start, off)


def _hashes(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words that make up letters, one after another; BLOCK letters at a time."""
    stop = np.cumsum(length)
    begin = stop - length
    out = np.zeros(len(length), np.uint64)
    for a in range(0, len(letters), BLOCK):
        b = min(a + BLOCK, len(letters))
        w0, w1 = int(np.searchsorted(stop, a, "right")), int(np.searchsorted(begin, b, "left"))
        edge = np.maximum(begin[w0:w1], a) - a
        place = np.arange(a, b) - np.repeat(begin[w0:w1], np.minimum(stop[w0:w1], b) - a - edge)
        far = np.flatnonzero(place >= _REACH)
        turn = (place[far] // _REACH).astype(np.uint64)
        place[far] %= _REACH
        v = _PLACE[(place << 8) | letters[a:b]]
        v[far] = mix(v[far] + mix(turn))
        out[w0:w1] += np.add.reduceat(v, edge)
    return mix(out)


class Table:
    """Sorted hashes with a bit table before them: find() gives the place of each hash, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys & _U((1 << _BITS) - 1)).astype(np.int64)] = True

    def maybe(self, h: np.ndarray) -> np.ndarray:
        return self.bits[(h & _U((1 << _BITS) - 1)).astype(np.int64)]

    def find(self, h: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.keys, h)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == h, k, -1) if len(self.keys) else np.full(len(h), -1)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yields (row, sorted distinct shingle hashes) of each row: windows of width words, with fewer words the whole sequence as one, without words none."""
    for at, off, data in blocks(column):
        h, _, _, cut = word_hashes(off, data)
        if len(h) >= width:
            s = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                s += h[k : len(h) - width + 1 + k] * _MIX[k]
            s = mix(s)
        for i in range(len(off) - 1):
            a, b = cut[i], cut[i + 1]
            if b - a >= width:
                x = np.sort(s[a : b - width + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield at + i, x[keep]
            elif b > a:
                yield at + i, mix((h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a))
            else:
                yield at + i, np.zeros(0, np.uint64)
