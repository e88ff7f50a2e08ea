"""Words of many texts at once: byte classes over a column's buffer, no loop over texts or words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20


def byte_class(kept: str) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes belong to a word, the byte they become): bytes of ``kept`` and all above 127; A-Z become a-z."""
    inside = np.zeros(256, bool)
    inside[[ord(c) for c in kept]] = True
    inside[128:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``. Both only name ASCII signs, so a byte above 127 is always inside.
BLANKS = {0x20, *range(0x09, 0x0E)}
WORDS = byte_class("".join(chr(c) for c in range(128) if c not in BLANKS))
LETTERS = byte_class("".join(chr(c) for c in range(128) if chr(c).isalpha()))


def text_slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``size`` bytes of text; one longer text is a run of its own."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    part = (ends[1:] - ends[0] - 1) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def words_of(texts: pa.StringArray, cls: tuple[np.ndarray, np.ndarray]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of a column without nulls, in order, and how many each text has."""
    inside, lower = cls
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    on = inside[data]
    begin = on.copy()
    begin[1:] &= ~on[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]  # a text's first byte begins a word whatever lies before it
    begin[first] = on[first]
    signs = lower[data[on]]
    starts = np.append(np.flatnonzero(begin[on]), len(signs)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(signs))
    return words, np.diff(np.searchsorted(np.flatnonzero(begin), ends))


def coded(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Each word's number and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(), d.dictionary
