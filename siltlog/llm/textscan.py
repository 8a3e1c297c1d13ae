"""Vectorised word scanning over the UTF-8 bytes of many texts at once.

Words are maximal runs of bytes of a class. Both classes used here split UTF-8
at ASCII bytes only, so byte runs and character runs are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: [^\x20\x09-\x0D]
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z were lower-cased
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2**64, for i below n or more."""
    size = max(CHUNK + 4096, 1 << int(n - 1).bit_length() if n > CHUNK + 4096 else 0)
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        _POWERS[size] = (pair[0], pair[1])
    return _POWERS[size]


@dataclass
class Words:
    """Words of all texts in order. begin, end: byte positions in data; first: index of each text's first word, with one more entry for the end."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.begin), dtype=np.uint64)
        at = 0
        while at < len(self.begin):
            low = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + CHUNK, "right")))
            high = self.end[to - 1]
            power, inverse = _powers(int(high - low))
            run = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_TABLE[self.data[low:high]] * power[: high - low], out=run[1:])
            b = self.begin[at:to] - low
            out[at:to] = _mix((run[self.end[at:to] - low] - run[b]) * inverse[b])
            at = to
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (null: empty) one after another, and where each begins, with one more entry for the end."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return LOWER[data], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of the class `kind` (ALNUM or NOT_SPACE) in each text."""
    n = len(data)
    flag = np.zeros(n + 2, dtype=bool)
    flag[1:-1] = kind[data]
    start = flag[1:-1] & ~flag[:-2]
    stop = flag[1:-1] & ~flag[2:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    if n:
        start[full] = flag[1:-1][full]
        last = full[1:] - 1
        stop[last] = flag[1:-1][last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return Words(data, offsets, begin, end, np.searchsorted(begin, offsets, "left"))
