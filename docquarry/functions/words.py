"""Words of texts within Arrow batches, by bytes: runs of anything but white space, as exprs.words() has them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docquarry.functions.exprs import SPACES

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[ord(x) for x in SPACES if x < "\x80"]] = True
_WIDE = [x.encode() for x in SPACES if x >= "\x80"]


class Words:
    """The words of a batch's texts, and the texts with their words joined by single blanks (`data`).

    first: the number of each row's first word, and of all words last; begin, end: a word's place in `data`.  A null text has no words.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        blank = _ASCII[data]
        wide = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))  # the first bytes of all others; texts are whole characters
        if len(wide):
            second, third = (data[np.minimum(wide + k, len(data) - 1)] for k in (1, 2))
            for x in _WIDE:
                found = wide[(data[wide] == x[0]) & (second == x[1]) & ((third == x[-1]) | (len(x) == 2))]
                for k in range(len(x)):
                    blank[found + k] = True
        edges = np.zeros(len(data) + 1, dtype=bool)
        edges[at] = True  # no word goes over the end of a row
        inside, before = ~blank, np.concatenate(([True], blank))
        begins = np.flatnonzero(inside & (edges[:-1] | before[:-1]))
        ends = np.flatnonzero(inside & (edges[1:] | np.concatenate((blank[1:], [True])))) + 1
        # a word's bytes, and the byte behind it unless the row ends there
        more = ~edges[ends]
        keep = inside | (blank & ~before[:-1] & ~edges[:-1])
        size = ends - begins
        self.data, self.first = data[keep], np.searchsorted(begins, at)
        stop = np.cumsum(size + more)
        self.begin = stop - size - more
        self.end = self.begin + size
        self.data[self.end[more]] = 32

    def joined(self, first: int, stop: int) -> bytes:
        """Words first..stop - 1 with blanks between them."""
        return self.data[self.begin[first] : self.end[stop - 1]].tobytes() if stop > first else b""

    def each(self) -> pa.BinaryArray:
        places = np.concatenate(([0], np.cumsum(self.end - self.begin))).astype(np.int32)
        inside = np.ones(len(self.data), dtype=bool)
        inside[self.end[self.end < np.append(self.begin[1:], len(self.data))]] = False
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.begin), [None, pa.py_buffer(places), pa.py_buffer(self.data[inside])])
