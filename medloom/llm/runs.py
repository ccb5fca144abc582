"""Words of whole texts in pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(data: bytes, overlap: int, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, about ``size`` bytes at a time.

    Each later list begins with the last ``overlap`` words before it, so that runs of one word more
    than that are each seen whole and once. A text of at most ``size`` bytes is one list.
    """
    if len(data) <= size:
        yield data.split()
        return
    carried: list[bytes] = []
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, min(at + size, len(data)))
        end = gap.start() if gap else len(data)
        words = carried + data[at:end].split()
        yield words
        carried, at = words[len(words) - overlap :] if len(words) > overlap else words, end
        if not overlap:
            carried = []


def joined_runs(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` consecutive words, joined by one space."""
    if size == 1:
        return iter(words)
    text = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return (text[a:b] for a, b in zip(starts, ends[size - 1 :]))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a batch's texts; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
