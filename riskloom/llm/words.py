"""Words of whole texts, split and coded by Arrow inside a task.

A word is a maximal run of characters other than space and U+0009 to U+000D, the
white space that Arrow's ASCII splitting knows.  Words are coded against the
distinct words of a slice of the batch, so work in Python is per distinct word
and the rest is numpy over codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


class Words:
    """Words of some rows: ``codes`` of all of them in order, row ``i`` at ``starts[i]:starts[i + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        values = split.flatten().dictionary_encode()
        codes = values.indices.to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        blank = pc.equal(values.dictionary, "").to_numpy(zero_copy_only=False)
        keep = ~blank[codes] if len(codes) else np.zeros(0, bool)
        ends = np.cumsum(lengths)
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.starts = np.concatenate([[0], kept[ends]])
        self.codes = codes[keep]
        self.distinct = pc.ascii_lower(values.dictionary) if lower else values.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for every distinct word."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(self.distinct.to_numpy(zero_copy_only=False), categorize=False)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each starts (one more at the end); null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def as_texts(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Texts from their UTF-8 bytes and starts, the inverse of ``text_bytes``."""
    parts = [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, parts).cast(pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words; run ``i`` starts at word ``i``."""
    size = max(0, len(word_hashes) - n + 1)
    out = np.full(size, np.uint64(n))
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:i + size])
    return out
