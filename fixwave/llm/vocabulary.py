"""The words of a batch of texts as exact numbers: no hash stands for a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Words:
    """Words in order: the number of each among ``distinct``, the text it is in, and where it lies in ``data``.

    ``data`` has every word followed by one space, so words in a row are one stretch of it, joined by single spaces.
    """

    ids: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray
    distinct: pa.Array


def words(raw: list[bytes], blanks: bytes) -> Words:
    """The words of texts, cut at any of ``blanks`` (the first of which is put between texts)."""
    gap = np.zeros(256, bool)
    gap[list(blanks)] = True
    data = np.frombuffer(blanks[:1].join(raw) + blanks[:1], np.uint8)
    solid = ~gap[data]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    owner = np.searchsorted(begin, start, side="right") - 1
    solid[stop] = True  # the blank behind each word stays, as a space
    body = data[solid]
    size = stop - start
    at = np.cumsum(size + 1) - size - 1
    body[at + size] = 32
    ends = np.concatenate([[0], np.cumsum(size)])
    packed = np.delete(body, at + size) if len(at) else body
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed.tobytes())])
    coded = array.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), owner, at, at + size, body, coded.dictionary)
