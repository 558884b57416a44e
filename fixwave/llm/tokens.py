"""Byte-level BPE over Arrow batches: each distinct pre-token is encoded once per worker by the tokenizers library.

Byte-level BPE works within pre-tokens, so the ids of a text are the ids of its pre-tokens in order. ``Encoder`` cuts a
whole batch of texts into pre-tokens with numpy, hashes them, and asks the library only for those not met before. Texts
with code points whose class could differ between Unicode versions go to the library whole; both ways give equal ids.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from fixwave.llm.common import slices

FAST_BELOW = 0x250  # Latin blocks; letters, digits and spaces there are the same in all Unicode versions
_OTHER, _LETTER, _DIGIT, _SPACE, _SLOW = range(5)
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")
_MAX_CACHED = 1_500_000  # pre-tokens a worker remembers (about 60 MB); beyond it the cache starts anew


def _classes() -> np.ndarray:
    out = np.full(FAST_BELOW, _OTHER, np.uint8)
    for c in range(FAST_BELOW):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0xA0]] = _SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = _SLOW
    return out


class Encoder:
    """Encode Arrow string arrays with a tokenizer file of the tokenizers library (byte-level BPE, no special tokens)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cls = _classes()
        rng = np.random.default_rng(20)
        self.table = rng.integers(1, 2**63, FAST_BELOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mult = np.uint64(0x9E3779B97F4A7C15)
        self.inv = np.uint64(pow(int(self.mult), -1, 2**64))
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes the byte-level alphabet shows as they are
        self.visible = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.up = self.down = np.ones(1, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # hashes in order, and the slot of each
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool = np.empty(0, np.uint32)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.mult)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.inv)]), dtype=np.uint64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts concatenated, and the number of ids of each; a null counts as empty."""
        texts = [t or "" for t in texts]
        groups, size = [[]], 0
        for i, t in enumerate(texts):  # about a million characters at a time
            if size > 1_000_000:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += len(t)
        done = [self._encode([texts[i] for i in g]) for g in groups]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(t) for t in texts], np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lens)
        slow = np.zeros(len(texts), bool)
        odd = np.flatnonzero(cp >= FAST_BELOW)
        cls = self.cls[np.minimum(cp, FAST_BELOW - 1)]
        odd = np.union1d(odd, np.flatnonzero(cls == _SLOW))
        slow[np.searchsorted(ends, odd, side="right")] = True
        for s in self.special:
            slow |= np.array([s in t for t in texts], bool)
        if slow.any():
            fast_ids, fast_n = self._encode([t for t, x in zip(texts, slow) if not x]) if not slow.all() else (np.empty(0, np.uint32), np.empty(0, np.int64))
            direct = iter([np.array(e.ids, np.uint32) for e in self.tok.encode_batch([t for t, x in zip(texts, slow) if x], add_special_tokens=False)])
            parts = iter(np.split(fast_ids, np.cumsum(fast_n)[:-1]) if len(fast_n) else [])
            out = [next(direct) if x else next(parts) for x in slow]
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        if not len(cp):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self._starts(cp, cls, ends[lens > 0])
        key = self._hash(cp, starts)
        uniq, inverse = np.unique(key, return_inverse=True)
        slot = self._lookup(uniq, inverse, cp, starts)[inverse]
        n = self.n[slot].astype(np.int64)
        total = np.cumsum(n)
        step = np.ones(total[-1], np.int64)  # indices into the pool: runs of consecutive ids
        heads = total - n
        step[heads] = self.at[slot] - np.concatenate([[0], (self.at[slot] + n - 1)[:-1]])
        ids = self.pool[np.cumsum(step)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def _starts(self, cp: np.ndarray, cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: class runs, with a single space before a run drawn into it."""
        size = len(cp)
        new = np.empty(size, bool)  # the first character of a class run or of a text
        new[0] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        text = np.zeros(size + 1, bool)
        text[0] = text[ends] = True
        new |= text[:-1]
        last = np.empty(size, bool)
        last[:-1], last[-1] = new[1:], True
        space = cls == _SPACE
        # a white-space run gives its last character away, unless the text ends there
        tail = space & last & ~text[1:]
        start = new.copy()
        start[tail] = True
        drawn = np.flatnonzero(tail & (cp == 32))
        start[drawn + 1] = False
        quote = np.flatnonzero((cp == 39) & new & last & start)
        if len(quote):
            self._contractions(cp, cls, quote, start, text)
        return np.flatnonzero(start)

    @staticmethod
    def _contractions(cp, cls, quote, start, text) -> None:
        size = len(cp)
        for q in quote.tolist():
            for c in _CONTRACTED:
                end = q + 1 + len(c)
                if end <= size and not text[q + 1 : end].any() and all(cp[q + 1 + i] == ord(x) for i, x in enumerate(c)):
                    start[q + 1 : end] = False
                    if end < size and not text[end] and cls[end] == _LETTER:
                        start[end] = True
                    break

    def _hash(self, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size = len(cp)
        self._powers(size + 1)
        acc = np.cumsum(self.table[cp] * self.up[:size], dtype=np.uint64)
        ends = np.append(starts[1:], size)
        before = np.where(starts > 0, acc[starts - 1], np.uint64(0))
        key = (acc[ends - 1] - before) * self.down[starts]
        key ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        return key

    def _lookup(self, uniq, inverse, cp, starts) -> np.ndarray:
        """The slot of each distinct pre-token; those not met before are encoded and stored first."""
        if len(self.n) > _MAX_CACHED:
            self._reset()
        slot = np.full(len(uniq), -1, np.int64)
        for keys, slots in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                hit = keys[at] == uniq
                slot[hit] = slots[at[hit]]
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            first = np.empty(len(uniq), np.int64)
            first[inverse[::-1]] = np.arange(len(starts) - 1, -1, -1)
            ends = np.append(starts[1:], len(cp))
            words = [cp[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in first[fresh].tolist()]
            ids = [[t.id for t in self.model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.visible))] for w in words]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))
            slot[fresh] = np.arange(len(self.n), len(self.n) + len(n))
            self.at = np.concatenate([self.at, np.cumsum(n) - n + len(self.pool)])
            self.n = np.concatenate([self.n, n])
            self.pool = np.concatenate([self.pool, flat])
            self.runs.append((uniq[fresh], slot[fresh]))
            while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):  # sorted runs of at least doubling length
                (k, a), (j, b) = self.runs.pop(), self.runs.pop()
                order = np.argsort(keys := np.concatenate([j, k]), kind="stable")
                self.runs.append((keys[order], np.concatenate([b, a])[order]))
        return slot


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; Spark reuses its workers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize_partition(path: str, end_id: int, as_list: bool):
    """A mapInArrow function from (doc_id, text) to (doc_id, ids, n_tokens, part, part_offset).

    ids are little-endian unsigned 32-bit integers, or a list of ints; each document ends with ``end_id``. Offsets run
    on from batch to batch, so that a part needs only the total of the parts before it for its place in the whole.
    """

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        for batch in slices(batches):
            ids, n = enc.encode(batch.column("text").to_pylist())
            n = n + 1
            ends = np.cumsum(n)
            full = np.full(int(ends[-1]), end_id, np.uint32)
            body = np.ones(len(full), bool)
            body[ends - 1] = False
            full[body] = ids
            offsets = np.concatenate([[0], ends])
            if as_list:
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(full.view(np.int32)))
            else:
                out = binaries(full, offsets)
            cols = [batch.column("doc_id"), out, pa.array(n, pa.int64()), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + ends - n, pa.int64())]
            at += int(ends[-1])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "part", "part_offset"])

    return run


def binaries(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array of the bytes of runs of ids."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
