"""Words of many texts at once, found in the UTF-8 bytes of an Arrow column.

Words are runs of bytes outside 0x20 and 0x09 to 0x0D. UTF-8 never uses these bytes inside a
longer character, so this equals splitting the text by the same characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Word spans of consecutive texts: word i is data[starts[i]:ends[i]]; text d has the words
    bounds[d] to bounds[d + 1]. ``first`` is the index of the first text in its column."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    first: int
    texts: int


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets, data


def word_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[Words]:
    """Words of the column in slices of whole texts, of about ``limit`` bytes each."""
    if not len(column):
        return
    offsets, data = text_bytes(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield _words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    space = SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), first, len(offsets) - 1)


def single_spaced(words: Words, lower: bool = False) -> Words:
    """The same words with each gap between them turned into one space."""
    data = LOWER[words.data] if lower else words.data.copy()
    space = SPACE[data]
    data[space] = 0x20
    keep = ~space
    keep[words.starts[words.starts > 0] - 1] = True
    place = np.cumsum(keep)
    return Words(
        data[keep],
        place[words.starts] - 1,
        place[words.ends - 1],
        words.bounds,
        words.first,
        words.texts,
    )
