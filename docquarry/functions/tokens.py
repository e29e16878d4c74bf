"""Tokens of lower-cased texts within Arrow batches, by bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True


def tokenized(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """(tokens of each row, all tokens in order): the maximal runs of [A-Za-z0-9]; a null text has none.  Letters are taken as they are."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(len(texts), dtype=np.int64), pa.array([], pa.string())
    data, offsets = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = _INSIDE[data]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True  # no token goes over the end of a row
    begins = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edges[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    places = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(begins, offsets)), flat
