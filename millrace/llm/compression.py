"""Compressed sizes under raw-content zstandard dictionaries.

A text is compressed in pieces, each with a fresh dictionary, so that the dictionary counts for the end of a long text
as much as for its beginning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard

PIECE_BYTES = 4096
LEVEL = 3


def raw_dictionary(texts: Sequence[bytes], size: int, excerpt: int = 1024) -> bytes:
    """Excerpts from the middle of as many texts as fit into ``size`` bytes."""
    parts, total = [], 0
    for text in texts:
        middle = max(0, (len(text) - excerpt) // 2)
        parts.append(text[middle : middle + excerpt])
        total += len(parts[-1]) + 1
        if total >= size:
            break
    return b"\n".join(parts)[:size]


class Compressor:
    def __init__(self, content: bytes, level: int = LEVEL) -> None:
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) >= 8:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            options["dict_data"] = dictionary
        self._compress = zstandard.ZstdCompressor(level=level, **options).compress

    def size(self, data: bytes) -> int:
        return len(self._compress(data))


def pieces(data: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """The whole text in pieces of near equal length; an empty text is one empty piece."""
    count = max(1, -(-len(data) // size))
    step = -(-len(data) // count) or 1
    return [data[i : i + step] for i in range(0, len(data), step)] or [b""]


def piece_sizes(compressors: Sequence[Compressor], parts: Sequence[bytes]) -> np.ndarray:
    """Compressed size of every piece (column) under every dictionary (row)."""
    return np.array([[c.size(p) for p in parts] for c in compressors], dtype=np.float64)
