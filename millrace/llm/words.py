"""Words of many texts at once as numpy arrays.

Texts of a slice lie one after the other in a byte buffer, each closed by a separator byte, so that
word limits, hashes and windows are array operations instead of a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20  # bytes hashed per pass


def byte_table(separators: bytes) -> bytes:
    """Translation that lower-cases A-Z and maps every separator byte to a space."""
    table = bytearray(range(256))
    for upper in range(0x41, 0x5B):
        table[upper] = upper + 32
    for byte in separators:
        table[byte] = 0x20
    return bytes(table)


WHITE = byte_table(b"\x20\t\n\x0b\x0c\r")
#: Words are runs of digits, lower-cased letters and all bytes of other scripts.
ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))


class Packed:
    """Texts of a slice in one translated buffer with word limits.

    ``starts``/``ends`` are byte positions of words, ``first[d]:first[d + 1]`` the words of text ``d``.
    """

    def __init__(self, texts: pa.Array, translation: bytes) -> None:
        closed = pc.binary_join_element_wise(pc.cast(texts, pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        _, offsets, data = closed.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[closed.offset : closed.offset + len(closed) + 1]
        raw = memoryview(data)[offs[0] : offs[-1]] if len(closed) else b""
        self.bytes = bytes(raw).translate(translation)
        self.offsets = offs - offs[0] if len(closed) else np.zeros(1, np.int64)
        buffer = np.frombuffer(self.bytes, dtype=np.uint8)
        inside = np.empty(len(buffer) + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        np.not_equal(buffer, 0x20, out=inside[1:-1], casting="unsafe")
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.buffer = buffer

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_bytes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        inverse = pow(_PRIME, -1, 1 << 64)
        tables = []
        for base in (_PRIME, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(packed: Packed) -> np.ndarray:
    """64-bit hash of every word, from prefix sums of byte values times powers of an odd number."""
    starts, ends, out = packed.starts, packed.ends, np.empty(len(packed.starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        origin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, origin + _SEGMENT, "right")))
        size = int(ends[j - 1] - origin)
        powers, inverse = _power_tables(max(size, _SEGMENT))
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_bytes[packed.buffer[origin : origin + size]] * powers[:size], out=sums[1:])
        a, b = starts[i:j] - origin, ends[i:j] - origin
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingle_sets(packed: Packed, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word windows.

    A text of fewer words has its whole sequence as one window, a text without words has none.
    """
    words, first = word_hashes(packed), packed.first
    step = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled = mix(rolled * step + words[k : len(words) - size + 1 + k]) if len(rolled) else rolled
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * step + words[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
