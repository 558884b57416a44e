"""Words and word shingles of texts, as 64-bit hashes computed for a whole batch at once."""

from __future__ import annotations

import numpy as np

from fixwave.llm.rolling import Rolling, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.random.default_rng(5).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (letters A-Z lowered), the text each is in, and where it begins and ends in that text's bytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, start, side="right") - 1
    return Rolling(data, 2).of(start, stop), owner, start - begin[owner], stop - begin[owner]


def grams(word: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within a text, and the word each begins with."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc += word[k : k + n] * _PLACE[k % len(_PLACE)]
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(acc[inside]), inside


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles in order of hash; of a text with fewer words, the whole sequence; none without words."""
    word, owner, _, _ = words(texts)
    count = np.bincount(owner, minlength=len(texts))
    key, first = grams(word, owner, size)
    parts = np.split(key, np.cumsum(np.bincount(owner[first], minlength=len(texts)))[:-1])
    ends = np.cumsum(count)
    out = []
    for part, n, end in zip(parts, count.tolist(), ends.tolist()):
        if 0 < n < size:
            part = mix(np.array([np.sum(word[end - n : end] * _PLACE[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
        out.append(np.unique(part))
    return out
