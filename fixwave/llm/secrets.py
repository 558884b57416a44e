"""Secret scans: base patterns, and probabilistic automata inferred from the credentials that they find.

The base patterns label credentials in all texts. For each kind, a prefix tree of a bounded, documented sample of distinct
labelled values is generalised by merging states whose futures are statistically compatible (Hoeffding bounds on stopping
and on each symbol, checked down the tree); the merged states are a probabilistic automaton of the kind's format, and a
further one is inferred in the same way from tokens outside base spans.

Every token of every whole text is a candidate and is scored, those of base spans too: its log-likelihood under each kind's
automaton less that under the automaton of ordinary tokens, plus the log of how many credentials of the kind there are to a
token in all texts, is its log-odds of being a credential. The level of a kind is the log-likelihood for each character that
all but the least likely twentieth of its labelled values reach; what a token lacks of it is taken off its odds. A token
clear of base spans is added, as kind ``format``, where the odds favour a kind whose level it reaches. Base spans always stay.

Learning, not scanning, is bounded: ``sample`` distinct values of each kind, of at most ``longest`` characters, by least hash.

Defined results: a null text is an empty one and has no spans; repeated rows each get their result; of spans at one place
the kind listed first comes first; an empty table, or one without labelled values, gets no added spans; where all tokens are
credentials, ordinary ones are taken to be uniform; positions are code points; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, prepare, slices

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Shorter runs fail the length check and leave no other match in them, so the patterns ask for the length at once.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens: dots only within, and padding only at the end.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
#: Alphabet of the automata: hexadecimal and other letters by case, digits, the rest.
SYMBOLS = {c: s for s, cs in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/=", "-_.")) for c in cs}
WIDTH = 7
UNIFORM = -math.log(WIDTH + 1)
_CODES = np.array([SYMBOLS.get(chr(c), 0) for c in range(128)], np.uint8)
SPAN = "array<struct<kind:int,start:int,stop:int,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of each base match, in order of start and kind."""
    out = [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


class Automaton:
    """States with counts of stopping and of each symbol; built as a prefix tree, then merged."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.go: list[dict[int, int]] = [{}]
        self.seen: list[dict[int, int]] = [{}]
        self.stop, self.total, self.alpha = [0], [0], alpha
        for v in values:
            at = 0
            for c in v:
                s = SYMBOLS[c]
                self.total[at] += 1
                self.seen[at][s] = self.seen[at].get(s, 0) + 1
                if s not in self.go[at]:
                    self.go[at][s] = len(self.go)
                    self.go.append({})
                    self.seen.append({})
                    self.stop.append(0)
                    self.total.append(0)
                at = self.go[at][s]
            self.total[at] += 1
            self.stop[at] += 1
        self._merge()

    def _differ(self, a: int, m: int, b: int, n: int) -> bool:
        return abs(a / m - b / n) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(m) + 1 / math.sqrt(n))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self.total[p], self.total[q]
            if not m or not n:
                continue
            if self._differ(self.stop[p], m, self.stop[q], n):
                return False
            for s in {*self.seen[p], *self.seen[q]}:
                if self._differ(self.seen[p].get(s, 0), m, self.seen[q].get(s, 0), n):
                    return False
                if s in self.go[p] and s in self.go[q]:
                    todo.append((self.go[p][s], self.go[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the automaton at p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.stop[p] += self.stop[q]
            self.total[p] += self.total[q]
            for s, n in self.seen[q].items():
                self.seen[p][s] = self.seen[p].get(s, 0) + n
            for s, child in self.go[q].items():
                if s in self.go[p]:
                    todo.append((self.go[p][s], child))
                else:
                    self.go[p][s] = child

    def _merge(self) -> None:
        """Layer by layer from the root, each state is folded into the first compatible one of its layer.

        States of different layers are never merged: a credential's length is part of its format, and counts of random
        characters thin out so fast down a prefix tree that single branches would be compatible with anything.
        """
        kept, layer = [], [0]
        while layer:
            kept += layer
            ahead: list[int] = []
            into: dict[int, int] = {}
            below = sorted({q for p in layer for q in self.go[p].values()}, key=lambda q: (-self.total[q], q))
            for q in below:
                r = next((r for r in ahead if self._compatible(r, q)), None)
                if r is None:
                    ahead.append(q)
                else:
                    into[q] = r
                    self._fold(r, q)
            for p in layer:
                self.go[p] = {x: into.get(q, q) for x, q in self.go[p].items()}
            layer = ahead
        red = kept
        place = {q: i for i, q in enumerate(red)}
        self.go = [{s: place[t] for s, t in self.go[q].items()} for q in red]
        self.seen, self.stop, self.total = ([x[q] for q in red] for x in (self.seen, self.stop, self.total))
        # as tables, with a last state for what has left the automaton: there all goes on evenly
        n = len(red)
        self.to = np.full((n + 1, WIDTH), n, np.int32)
        self.cost = np.full((n + 1, WIDTH), UNIFORM)
        self.ends = np.full(n + 1, UNIFORM)
        for q in range(n):
            whole = math.log(self.total[q] + 0.5 * (WIDTH + 1))
            for x in range(WIDTH):
                self.cost[q, x] = math.log(self.seen[q].get(x, 0) + 0.5) - whole
                self.to[q, x] = self.go[q].get(x, n)
            self.ends[q] = math.log(self.stop[q] + 0.5) - whole

    def logliks(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, together: int = 64) -> np.ndarray:
        """Log-probability of each stretch of ``codes``, stop included; all stretches take a step at once, long ones go on alone."""
        order = np.argsort(-size, kind="stable")
        at, out = np.zeros(len(size), np.int32), np.zeros(len(size))
        ordered = size[order]
        for k in range(min(together, int(ordered[0]) if len(ordered) else 0)):
            now = order[: np.searchsorted(-ordered, -k)]
            x = codes[start[now] + k]
            out[now] += self.cost[at[now], x]
            at[now] = self.to[at[now], x]
        for i in order[: np.searchsorted(-ordered, -together)].tolist():
            q, total, to, cost = int(at[i]), float(out[i]), self.to.tolist(), self.cost.tolist()
            for x in codes[start[i] + together : start[i] + size[i]].tolist():
                total += cost[q][x]
                q = to[q][x]
            at[i], out[i] = q, total
        return out + self.ends[at]

    def loglik(self, value: str) -> float:
        """Log-probability for each character."""
        return float(self.logliks(*_coded([value]))[0]) / len(value)


def _coded(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    return _CODES[np.frombuffer("".join(values).encode("ascii"), np.uint8)], np.cumsum(size) - size, size


class Formats:
    """One automaton for each labelled kind and one of ordinary tokens, the level that labelled values reach, and prior odds."""

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str], counts: dict[int, int]):
        self.models = {k: Automaton(v) for k, v in labelled.items() if v}
        self.plain = Automaton(ordinary) if ordinary else None
        self.level = {k: sorted(m.loglik(v) for v in labelled[k])[len(labelled[k]) // 20] for k, m in self.models.items()}
        tokens = max(1, counts.get(3, 0))
        self.prior = {k: math.log(max(1, counts.get(k, 0)) / tokens) for k in self.models}

    def scores(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each value is a credential, and whether it is one: where that is over one half.

        A value that is short of the level that labelled values reach is unlike the kind as well as unlike words: whatever the
        odds between these two, its own are below even, by what it is short.
        """
        chance, accepted = np.zeros(len(values)), np.zeros(len(values), bool)
        if not self.models or not values:
            return chance, accepted
        coded = _coded(values)
        size = coded[2]
        plain = self.plain.logliks(*coded) if self.plain else (size + 1) * UNIFORM
        for k, m in self.models.items():
            own = m.logliks(*coded)
            short, odds = own - self.level[k] * size, own - plain + self.prior[k]
            odds = np.where(short < 0, np.minimum(odds, short), odds)
            chance = np.maximum(chance, 1 / (1 + np.exp(-np.clip(odds, -700, 700))))
            accepted |= odds > 0
        return chance, accepted


def clear_tokens(text: str, base: list) -> list[tuple[int, int, str]]:
    """(start, end, value) of every token of a text that is clear of its base spans."""
    out, k = [], 0
    blocks: list[tuple[int, int]] = []  # base spans, merged
    for _, s, e, _ in base:
        if blocks and s <= blocks[-1][1]:
            blocks[-1] = (blocks[-1][0], max(e, blocks[-1][1]))
        else:
            blocks.append((s, e))
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while k < len(blocks) and blocks[k][1] <= s:
            k += 1
        if k == len(blocks) or blocks[k][0] >= e:
            out.append((s, e, m[0]))
    return out


def survey(docs: DataFrame, sample: int, longest: int) -> DataFrame:
    """(kind, value, mark, n): of each run of rows, how many credentials of each kind and tokens (kind 3) it holds, and the
    ``sample`` distinct values of each that have the least hash."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found: list[set] = [set() for _ in KINDS]
            n = [0] * len(KINDS)
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for k, _, _, v in base:
                    found[k].add(v)
                    n[k] += 1
                all_ = TOKEN.findall(text or "")
                n[3] += len(all_)
                found[3].update((v for *_, v in clear_tokens(text, base)) if base else all_)
            rows = [(k, None, None, n[k]) for k in range(len(KINDS)) if n[k]]
            for k, values in enumerate(found):
                marks = sorted((xxhash.xxh64_intdigest(v) - (1 << 63), v) for v in values if len(v) <= longest)
                rows += [(k, v, h, 0) for h, v in marks[:sample]]
            cols = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "value", "mark", "n"])

    return docs.select("text").mapInArrow(run, "kind int, value string, mark long, n long")


def infer(docs: DataFrame, sample: int = 400, longest: int = 4096) -> Formats:
    """Automata from at most ``sample`` distinct values of each kind and of ordinary tokens; counts are those of all texts."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.save(survey(docs, sample, longest), "survey")
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    def values(kind: int) -> list[str]:
        some = rows.where((F.col("kind") == kind) & F.col("value").isNotNull()).select("mark", "value").distinct()
        return [r["value"] for r in some.orderBy("mark", "value").limit(sample).collect()]

    formats = Formats({k: values(k) for k in range(3)}, values(3), counts)
    scratch.drop("survey")
    return formats


def find(docs: DataFrame, sample: int = 400, longest: int = 4096) -> DataFrame:
    """(doc_id, base, spans, n_tokens, top_score): base spans, and all spans, each in order of start and kind and with its
    score; how many tokens were scored; and the highest score of a token clear of base spans."""
    formats = infer(docs, sample, longest)
    names = ("kind", "start", "stop", "score")

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            all_ = [TOKEN.findall(t) for t in texts]
            values = list(set().union(*all_, *({v for *_, v in spans} for spans in base)))
            score, accepted = formats.scores(values)
            chance, good = dict(zip(values, score.tolist())), {values[i] for i in np.flatnonzero(accepted).tolist()}
            own, full, top = [], [], []
            for text, spans, toks in zip(texts, base, all_):
                scored = [(k, s, e, chance[v]) for k, s, e, v in spans]
                clear = clear_tokens(text, spans) if spans or not good.isdisjoint(toks) else None
                added = [(3, s, e, chance[v]) for s, e, v in clear or () if v in good]
                own.append([dict(zip(names, x)) for x in scored])
                full.append([dict(zip(names, x)) for x in sorted(scored + added, key=lambda x: (x[1], x[0]))])
                top.append(max(map(chance.__getitem__, set(toks if clear is None else (v for *_, v in clear))), default=0.0))
            cols = [pa.array(own, kind), pa.array(full, kind), pa.array([len(t) for t in all_], pa.int64()), pa.array(top, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "base", "spans", "n_tokens", "top_score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN}, spans {SPAN}, n_tokens long, top_score double")


def digest(found: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans, all spans as text, how many tokens were scored, how many were added and the scores."""
    kind = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 6).cast("string")), ",").alias("scores")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), "n_tokens", added, F.round("top_score", 6).alias("top_score"), scores)
