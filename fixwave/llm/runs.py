"""Periodic runs of words, by Lyndon arrays over an ordered alphabet (the method of Ellert and Fischer).

Every run has Lyndon roots under one of two orders of the alphabet, an order and its reverse, and each such root is the longest
Lyndon word at its start: it ends at the next smaller suffix. ``lyndon`` finds these ends from left to right on a stack. How far
two suffixes agree is not looked up in suffix structures or hashes: the match that reaches furthest so far is kept, and a pair
of suffixes within its second copy takes over what is known of the same pair in the first copy, or goes on matching at the
reach. So symbols are compared once each, and the time is linear. A root and how far it goes on to either side give the run.

Before that, places where no run can be are ruled out, without loss. From the second period on, each word of a run of period q
occurred q words earlier. So a run that is long enough leaves max(16, 2q) words or more in a row that each occurred at most q
words before. Stretches of such words, for q doubling, widened by the period and a word on either side, hold every run whole;
``lyndon`` goes over their union.

Words are numbered by first place in a batch, which is an exact code; any order of the alphabet serves. A document is read by one
task, a batch of about ``SLICE`` bytes at a time; nothing is shuffled. One document takes memory in proportion to its length.

Defined results: a null text is an empty one, has no words and no run; repeated rows each get their result; an empty table gives
an empty one; among runs of equal exponent the one with the smallest start, then period, is reported; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fixwave.llm import vocabulary
from fixwave.llm.common import prepare, slices

SLICE = 1 << 20
LEAST, TIMES = 24, 3
BLANKS = b" \t\n\x0b\x0c\r"
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place, where the next smaller suffix starts (the length of ``x``: none), and how far both agree.

    A suffix that is another's prefix is smaller.
    """
    n = len(x)
    nxt, agree = [n] * n, [0] * n  # the edge to the next smaller suffix
    prv, back = [-1] * n, [0] * n  # the edge to the previous smaller suffix
    left, right, reach = 0, 0, 0  # x[left:] and x[right:] agree up to ``reach`` of the latter
    for r in range(1, n):
        j = r - 1
        shift = right - left
        while j >= 0:
            if r >= reach:
                h = 0
                far = True
            elif right == r:
                # the pair (left, r) was met just before: j is the previous smaller suffix of left, so both edges tell
                h, most = back[left], reach - r
                far = h == most
                h = h if h < most else most
            elif j >= right:
                if nxt[j - shift] == r - shift:
                    h = agree[j - shift]
                elif prv[r - shift] == j - shift:
                    h = back[r - shift]
                else:
                    h = reach - r
                far = r + h >= reach
                h = min(h, reach - r)
            else:
                h, far = reach - r, True
            a, b = j + h, r + h
            if far:
                while b < n and x[a] == x[b]:
                    a += 1
                    b += 1
            if b >= reach:
                left, right, reach, shift = j, r, b, r - j
            if b < n and x[a] < x[b]:
                prv[r], back[r] = j, b - r
                break
            nxt[j], agree[j] = r, b - r
            j = prv[j]
    return nxt, agree


def runs_of(x: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` periods (two or more), in order."""
    found, n = set(), len(x)
    for seq in (x, [-v for v in x]):
        nxt, agree = lyndon(seq)
        for i in range(n):
            p = nxt[i] - i
            h = agree[i]
            if h <= (times - 2) * p or i + p >= n:  # the first root of a run of so many periods agrees with the next for more
                continue
            if i >= p and nxt[i - p] == i and agree[i - p] == h + p:
                continue  # the root before is in the same run
            back = 0
            while back < p and back < i and x[i - 1 - back] == x[i + p - 1 - back]:
                back += 1
            if back < p and back + p + h >= max(least, times * p):
                found.add((i - back, back + p + h, p))
    return sorted(found)


def stretches(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """[begin, end) of pieces of the words that hold, with a word to spare on either side, every run of their documents."""
    n = len(ids)
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1]) if n else np.empty(0, np.int64)
    lengths = np.diff(np.append(first, n))
    begin = np.repeat(first, lengths)
    key = begin * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    since = np.full(n, n + 1, np.int64)  # how many words ago the word occurred in its document
    since[order[1:][same]] = (order[1:] - order[:-1])[same]
    mark = np.zeros(n + 1, np.int64)
    longest, low, high = int(lengths.max()) if n else 0, 1, (least - 1) // times
    while low <= longest // times:
        # runs of a period from low to high have so many words in a row that occurred at most ``high`` words before
        need = max(least - high, (times - 1) * low)
        edge = np.diff((since <= high).astype(np.int8), prepend=0, append=0)
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = to - at >= need
        at, to = at[long], to[long]
        np.add.at(mark, np.maximum(at - high - 1, begin[at]), 1)
        np.add.at(mark, np.minimum(to + 1, n), -1)
        low, high = high + 1, 2 * high + 1
    inside = np.cumsum(mark[:-1]) > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cut = inside & np.isin(np.arange(n), first)  # a piece ends with its document
    at = np.union1d(np.flatnonzero(edge == 1), np.flatnonzero(cut))
    to = np.union1d(np.flatnonzero(edge == -1), np.setdiff1d(np.flatnonzero(cut), np.flatnonzero(edge == 1)))
    return np.stack([at, to], axis=1)


def runs_in(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each owner's words (start within the owner), for owners that have any; ids and owners in order of words."""
    out: dict[int, list] = {}
    ends = np.searchsorted(owner, owner, side="right")
    begins = np.searchsorted(owner, owner, side="left")
    for at, to in stretches(ids, owner, least, times).tolist():
        low, high = int(begins[at]), int(ends[at])
        for start, length, period in runs_of(ids[at:to].tolist(), least, times):
            if (start or at == low) and (at + start + length < to or to == high):  # else it may go on: another piece holds it whole
                out.setdefault(int(owner[at]), []).append((at + start - low, length, period))
    return out


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length by period, compared exactly; then of the smallest start and period."""
    top = runs[0]
    for r in runs[1:]:
        if (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
            top = r
    return top


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:-1]) == 0


def refolded(doc_id: int, n: int) -> np.ndarray | None:
    """The original word that each word of a document becomes, by the crc32 of its id; None leaves it as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _found(texts: list[str | None], orders: list) -> list[tuple]:
    """The result columns of each text; ``orders``: for each, a function from its number of words to the words it becomes, or None."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    both = vocabulary.words(raw, BLANKS)
    ids, owner = both.ids, both.owner
    count = np.bincount(owner, minlength=len(raw))
    begin = np.cumsum(count) - count
    new = [f and f(int(n)) for f, n in zip(orders, count)]
    for k, order in enumerate(new):
        if order is not None:
            ids[begin[k] : begin[k] + count[k]] = ids[begin[k] + order]
    found = runs_in(ids, owner)
    out = []
    for k, text in enumerate(raw):
        runs, words = sorted(found.get(k, [])), text.split()  # bytes are split at the same six blanks
        if new[k] is not None:
            words = [words[i] for i in new[k].tolist()]
        if runs:
            start, length, period = best(runs)
            top = (start, length, period, 1000 * length // period)
            words = [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]
        else:
            top = (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        out.append((len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    return out


def find(docs: DataFrame, fold: bool = False) -> DataFrame:
    """Per row: the number of runs, the run of greatest exponent, and hashes of all runs and of the words left without repeats.

    ``fold``: words are first repeated as ``refolded`` says, which plants runs in a tenth of all documents.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, size=SLICE):
            keys = batch.column("doc_id").to_pylist()
            orders = [(lambda n, d=d: refolded(d, n)) if fold and d is not None else None for d in keys]
            rows = _found(batch.column("text").to_pylist(), orders)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *[c.split()[0] for c in RESULT.split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
