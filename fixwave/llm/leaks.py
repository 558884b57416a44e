"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, and exact edit verification.

Distances are edits of words (a word with a typing error counts as one). An item of m words is held to be in a document if
some stretch of it is within ``share`` * m edits.

- Where windows can be: a stretch within the bound has a run of floor(m / (edits + 1)) words of its item unchanged. Windows are
  laid around every run of words that any item has, of the sizes of all items whose runs are as long, whichever item it is.
- Items and windows are embedded by the same random walks (at each step a random bit of the word says whether the walk goes on
  to the next word), which turn edits into substitutions. Samples of two embedded positions are LSH keys; windows and items
  that share a key are candidates. Sizes are classes: an item's class is at most a twentieth below its size.
- How many walks: for each class, stretches at the bound (by dropped and by added words, and off by half a stride) are made up
  and embedded, and walks added until the share ``recall`` of them meets its item. Of a class that MOST walks can't bring
  there, and of items of fewer than ``min_words`` words, which allow no edits, all places where one of the item's own runs
  would put it are candidates: that loses nothing.
- Candidates are verified by exact dynamic programming. ``exact`` verifies every seeded place instead, to measure recall.

The benchmark is the stated query set: it is held in blocks of bounded size, each run against all documents.

Defined results: a null text has no leaks; items of fewer than ``min_words`` words must be there without edits; items without
words, or null, are not looked for; repeated items and repeated documents are each reported (one row for each document and item_id of its best stretch,
the first of equals); an empty table of either kind gives no rows; other columns are kept by ``clean``, ignored by ``find``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import prepare, slices
from fixwave.llm.rolling import mix
from fixwave.llm.shingles import grams, words

STEPS = 2  # steps of a walk for each word of an item
KEYS, SAMPLED = 8, 2  # keys of a walk, and embedded positions in each
FEW, MOST = 8, 48  # walks
TRIALS = 150
CELLS = 1 << 21  # embedded positions held at once
BLOCK_CHARS = 16 << 20  # items that a task holds at once
SLICE = 1 << 20


def edits(m: int, share: float, min_words: int) -> int:
    return int(share * m + 1e-9) if m >= min_words else 0


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least number of edits between the item and any stretch of the text, and where the first such stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist(), 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != np.uint64(w)), row[1:] + 1)
        row = np.minimum.accumulate(best - step) + step
    return int(row.min()), int(row.argmin())


def size_class(m: int) -> int:
    """The greatest class that is at most m; classes are a twentieth apart, or one word."""
    g = 1
    while g + max(1, g // 20) <= m:
        g += max(1, g // 20)
    return g


def embed(word: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, walks: int) -> np.ndarray:
    """(steps, walks, starts): what random walks from each start meet; at its end a walk meets nothing (0) and stays."""
    salts = np.random.default_rng(17).integers(1, 2**63, (MOST, 1), dtype=np.uint64)[:walks]
    at = np.broadcast_to(start, (walks, len(start))).copy()
    out = np.empty((steps, walks, len(start)), np.uint64)
    for j in range(steps):
        x = np.where(at < end, word[np.minimum(at, len(word) - 1)], np.uint64(0))
        out[j] = x
        at += (((x ^ (x >> np.uint64(29))) * (salts + np.uint64(2 * j)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
    return out


def lsh_keys(embedded: np.ndarray, size: int) -> np.ndarray:
    """(keys, starts) of windows of a size: each joins two positions of one walk over as many words."""
    rng = np.random.default_rng(size)
    picks = rng.integers(0, STEPS * size, (MOST, KEYS, SAMPLED))
    walks = embedded.shape[1]
    w = np.repeat(np.arange(walks), KEYS)
    x, y = (embedded[picks[:walks, :, k].ravel(), w] for k in range(SAMPLED))
    salt = (np.arange(walks * KEYS, dtype=np.uint64) + np.uint64(1))[:, None] * np.uint64(0xD6E8FEB86659FD93)
    key = (x * np.uint64(0x9E3779B97F4A7C15)) ^ ((y + salt) * np.uint64(0xC2B2AE3D27D4EB4F))
    return key ^ (key >> np.uint64(32))


def stride(allowed: int) -> int:
    return 1 + allowed // 16


def walks_needed(size: int, largest: int, allowed: int, recall: float) -> int:
    """The walks that make the share ``recall`` of made-up stretches at the bound meet their item; 0 if MOST don't."""
    rng = np.random.default_rng(size)
    step = stride(allowed)
    meets = []
    for drop in (True, False):
        items, texts = [], []
        for _ in range(TRIALS):
            item = rng.integers(1, 2**63, largest, dtype=np.uint64)
            where = rng.choice(largest, min(allowed, largest - 1), replace=False)
            text = np.delete(item, where) if drop else np.insert(item, where, rng.integers(1, 2**63, len(where), dtype=np.uint64))
            pad = rng.integers(1, 2**63, 2 * (STEPS * size + step), dtype=np.uint64)
            items.append(item[:size])
            texts.append(np.concatenate([pad[: 2 * step], text, pad[2 * step :]]))
        flat, ends = np.concatenate(items), np.cumsum([len(x) for x in items])
        first = ends - size
        mine = lsh_keys(embed(flat, first, ends, STEPS * size, MOST), size)
        flat, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
        first = ends - [len(x) for x in texts] + 2 * step
        met = np.zeros((MOST * KEYS, TRIALS), bool)
        for off in (-step, 0, step):
            met |= lsh_keys(embed(flat, first + off + step // 2, ends, STEPS * size, MOST), size) == mine
        meets.append(np.maximum.accumulate(met.reshape(MOST, KEYS, TRIALS).any(axis=1), axis=0).mean(axis=1))
    good = np.flatnonzero(np.minimum(*meets) >= recall)
    return max(FEW, int(good[0]) + 1) if len(good) else 0


class Items:
    """A block of benchmark items: their words, the edits they allow, their runs, and their LSH keys by size class."""

    def __init__(self, rows: list, share: float, recall: float, min_words: int, exact: bool = False):
        rows = [(i, t) for i, t in rows if t is not None]
        word, owner, _, _ = words([t for _, t in rows])
        count = np.bincount(owner, minlength=len(rows)) if len(rows) else np.empty(0, int)
        parts = np.split(word, np.cumsum(count)[:-1]) if len(rows) else []
        self.items = [(i, p) for (i, _), p in zip(rows, parts) if len(p)]
        self.size = np.array([len(p) for _, p in self.items], np.int64)
        self.allowed = np.array([edits(len(p), share, min_words) for _, p in self.items], np.int64)
        classes: dict[int, list[int]] = {}
        for k, (_, p) in enumerate(self.items):
            classes.setdefault(size_class(len(p)) if self.allowed[k] and not exact else 0, []).append(k)
        seeds: dict[tuple[int, bool], list] = {}
        self.tables: dict[int, dict[int, tuple]] = {}  # by length of run, then by class: walks, filter, keys and their items
        for g, ks in sorted(classes.items()):
            walks = walks_needed(g, int(self.size[ks].max()), int(self.allowed[ks].max()), recall) if g else 0
            for k in ks:
                p = self.items[k][1]
                run = max(1, len(p) // (int(self.allowed[k]) + 1))
                key, at = grams(p, np.zeros(len(p), np.int64), run)
                seeds.setdefault((run, walks > 0), []).append((key, at, np.full(len(key), k)))
            if walks:
                flat = np.concatenate([self.items[k][1][:g] for k in ks])
                first = np.arange(len(ks)) * g
                key = lsh_keys(embed(flat, first, first + g, STEPS * g, walks), g)
                item = np.broadcast_to(np.array(ks), key.shape).ravel()
                key = key.ravel()
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
                for run in {max(1, int(self.size[k]) // (int(self.allowed[k]) + 1)) for k in ks}:
                    self.tables.setdefault(run, {})[g] = (walks, seen, key[order], item[order])
        self.seeds, self.runs = {}, {}
        for (run, hashed), found in seeds.items():
            key, at, item = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key, kind="stable")
            if hashed:
                self.runs[run] = np.unique(key)
            else:
                self.seeds[run] = (key[order], at[order], item[order])

    def _windows(self, word, owner, first, last):
        """(run, starts): where windows are laid, for each length of run."""
        for run, known in self.runs.items():
            key, at = grams(word, owner, run)
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = at[known[place] == key]
            if len(hit):
                sizes = [k for g in self.tables[run] for k in np.flatnonzero(self.size >= g).tolist() if size_class(int(self.size[k])) == g]
                back, step = int(max(self.size[k] + self.allowed[k] for k in sizes)) - run, stride(int(min(self.allowed[k] for k in sizes)))
                text = owner[hit]
                edge = np.zeros(len(word) + 1, np.int32)
                np.add.at(edge, np.maximum(hit - back, first[text]), 1)
                np.add.at(edge, hit + 1, -1)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                yield run, start[(start - first[owner[start]]) % step == 0]

    def candidates(self, word, owner, first, last):
        """(text, item, start) of windows that share a key with an item."""
        out = [np.empty((3, 0), np.int64)]
        for run, start in self._windows(word, owner, first, last):
            tables = self.tables[run]
            walks, steps = max(t[0] for t in tables.values()), STEPS * max(tables)
            size = max(1, CELLS // (walks * steps))
            for k in range(0, len(start), size):
                at = start[k : k + size]
                embedded = embed(word, at, last[owner[at]], steps, walks)
                for g, (some, seen, table, item) in tables.items():
                    key = lsh_keys(embedded[:, :some], g)
                    row, col = np.nonzero(seen[(key & np.uint64(0xFFFF)).astype(np.int64)])
                    key = key[row, col]
                    low, high = np.searchsorted(table, key), np.searchsorted(table, key, side="right")
                    n = high - low
                    which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    place = at[np.repeat(col, n)]
                    out.append(np.unique(np.stack([owner[place], item[which], place]), axis=1))
        return np.concatenate(out, axis=1)

    def regions(self, word: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(text, item, first word, end): where items may be, widened by their edits; what overlaps is one region."""
        found = [self.candidates(word, owner, first, last)]
        for size, (seed, offset, items) in self.seeds.items():
            key, at = grams(word, owner, size)
            low, high = np.searchsorted(seed, key), np.searchsorted(seed, key, side="right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            which = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(owner[at[hit]], n), items[which], np.repeat(at[hit], n) - offset[which]]))
        text, item, start = np.concatenate(found, axis=1)
        if not len(text):
            return
        a = np.maximum(start - self.allowed[item], first[text])
        b = np.minimum(start + self.size[item] + self.allowed[item], last[text])
        order = np.lexsort((a, item, text))
        text, item, a, b = text[order], item[order], a[order], b[order]  # of one text and item, b rises with a
        new = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0) | (a[1:] > b[:-1])])
        yield from zip(text[new].tolist(), item[new].tolist(), a[new].tolist(), b[np.r_[new[1:] - 1, len(b) - 1]].tolist())

    def leaks(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(index of the text, item_id, edits, bytes where the stretch begins and ends) of each leak."""
        if not self.items:
            return []
        word, owner, begin, stop = words(texts)
        first = np.searchsorted(owner, np.arange(len(texts)))
        last = np.searchsorted(owner, np.arange(len(texts)), side="right")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, k, a, b in self.regions(word, owner, first, last):
            item, m, allowed = self.items[k][1], int(self.size[k]), int(self.allowed[k])
            known = best.get((t, k), (m + 1, 0, 0))[0]
            if known == 0 or np.isin(item, word[a:b]).sum() < m - allowed:  # words that stay are in the region
                continue
            d, end = best_stretch(item, word[a:b])
            if d <= allowed and d < known:
                _, back = best_stretch(item[::-1], word[a : a + end][::-1])
                best[t, k] = (d, a + end - back, a + end)
        return [(t, self.items[k][0], d, int(begin[a]), int(stop[max(a, e - 1)])) for (t, k), (d, a, e) in sorted(best.items())]


def blocks(benchmark: DataFrame, share: float, recall: float, min_words: int, exact: bool = False):
    """The items, in blocks of about BLOCK_CHARS characters at most."""
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + 2 * chars // BLOCK_CHARS if chars > BLOCK_CHARS else 1
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()
        yield Items(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), share, recall, min_words, exact)


def find(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99, min_words: int = 5, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): leaks of benchmark items; the stretch lies within these bytes of the text."""
    prepare(docs.sparkSession)
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    out = None
    for items in blocks(benchmark, share, recall, min_words, exact):

        def run(batches, items=items):
            for batch in slices(batches, size=SLICE):
                found = items.leaks(batch.column("text").to_pylist())
                if found:
                    t, i, d, a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(t)), pa.array(i), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "item_id", "edits", "start", "stop"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start long, stop long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99, min_words: int = 5) -> DataFrame:
    """The documents, all columns as they were, that hold no benchmark item."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for items in blocks(benchmark, share, recall, min_words):

        def run(batches, items=items):
            for batch in slices(batches, at, SLICE):
                good = np.ones(batch.num_rows, bool)
                good[[t for t, *_ in items.leaks(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def brute_force(texts: list[str | None], items: list[tuple], share: float = 0.2, min_words: int = 5) -> set[tuple]:
    """(index of the text, item_id, edits) straight from the definition; for tests."""
    out = set()
    for t, text in enumerate(texts):
        for i, item in items:
            w, v = (words([x])[0] for x in (item, text))
            if item is not None and len(w):
                d, _ = best_stretch(w, v)
                if d <= edits(len(w), share, min_words):
                    out.add((t, i, d))
    return out
