"""Words of whole texts in Arrow batches: runs of characters other than \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


@dataclass
class Words:
    """Word i of row r is `words[codes[start[r] + i]]`."""

    start: np.ndarray
    codes: np.ndarray
    words: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.start) - 1), self.counts)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most `most` bytes of `column`, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; a null text has none. `lower` maps A-Z only."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets, flat = lists.offsets.to_numpy(), lists.values
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(full)])[offsets].astype(np.int64)
    flat = flat.filter(pa.array(full))
    # not on `texts`: on a slice of a batch ascii_lower gives wrong offsets in some versions of pyarrow
    coded = (pc.ascii_lower(flat) if lower else flat).dictionary_encode()
    return Words(start - start[0], coded.indices.to_numpy(), coded.dictionary)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, alike in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text starts and the last one ends); a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    start = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, start - start[0]
