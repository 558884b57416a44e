"""Quality scores: random Fourier features of document statistics, a ridge fit, and isotonic calibration.

Statistics of each whole text (shares of character classes, doubled symbols, word shapes, repetition) are standardised and
mapped to random Fourier features of a Gaussian kernel. Each of a fixed number of partitions sums its part of the normal
equations; only those sums (a few hundred kB each) come to the driver. Raw scores of held-back training rows are counted in
a fixed number of bins, to which pool-adjacent-violators fits a rising curve.

Labels are used of rows whose crc32(doc_id as text) mod 5 is not 0 alone: rows with 1 to 3 fit the ridge, rows with 4 the
calibration. ``max_rows`` bounds the labelled rows taken (by a hash of doc_id); the statistics, scores and decisions cover
all documents. Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null text is an empty one and gets the score of its (zero) statistics; a null label isn't used, of
repeated labels of one doc_id the mean is; repeated documents each get their score; without labels of both kinds every
score is 0.5; an empty table gives an empty frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, prepare, slices

NAMES = ("log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper", "digit", "symbol", "stop", "doubled", "bar", "non_ascii", "newline", "same_as_last", "distinct", "symbol_words", "symbol_ended", "capitals", "vowels")
PARTITIONS, BINS = 16, 1024
_UP, _LOW, _DIGIT, _SPACE, _STOP, _SYMBOL, _HIGH = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = _UP, _LOW, _DIGIT, _HIGH
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[ord(c) for c in ".,;:?'-"]] = _STOP
    out[:9] = out[14:32] = _SYMBOL
    return out


CLASSES = _classes()


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), len(NAMES)))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)  # a space after each text, so that words don't meet
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    cls = CLASSES[data]

    def per_text(x):
        return np.add.reduceat(x, begin, dtype=np.int64)

    n = np.maximum(size, 1)
    upper, lower, digit, symbol, high = (per_text(cls == c) for c in (_UP, _LOW, _DIGIT, _SYMBOL, _HIGH))
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & (cls[1:] == _SYMBOL)
    word = cls != _SPACE
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, starts, side="right") - 1
    words = np.bincount(owner, minlength=len(raw))
    per_word = lambda x: np.bincount(owner, weights=x, minlength=len(raw))
    m = np.maximum(words, 1)
    length = ends - starts
    letters = np.concatenate([[0], np.cumsum((cls == _UP) | (cls == _LOW) | (cls == _HIGH) | (cls == _DIGIT))])
    capitals = np.concatenate([[0], np.cumsum(cls == _UP)])
    spelt = letters[ends] - letters[starts]
    power = np.cumprod(np.full(int(length.max()) + 1 if len(length) else 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    mixed = (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(word, mixed, np.uint64(0)), dtype=np.uint64)])
    key = total[ends] - total[starts]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    _, first = np.unique(key * np.uint64(0xD6E8FEB86659FD93) + owner.astype(np.uint64), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(raw))
    last = cls[ends - 1]
    vowel = np.isin(data, np.frombuffer(b"aeiouAEIOU", np.uint8))
    columns = (
        np.log1p(size) / 4, np.log1p(words) / 4, np.log1p(size / m), per_word(length > 14) / m, per_word(length < 3) / m,
        upper / n, digit / n, symbol / n, per_text(cls == _STOP) / n, per_text(doubled) / n, per_text(data == 124) / n, high / n, per_text(data == 10) / n,
        per_word(same) / m, distinct / m, per_word(spelt == 0) / m, per_word(last == _SYMBOL) / m, per_word((spelt > 1) & (capitals[ends] - capitals[starts] >= 2)) / m, per_text(vowel) / np.maximum(upper + lower, 1),
    )
    for i, c in enumerate(columns):
        out[:, i] = c if i < 3 or NAMES[i] in ("distinct", "vowels", "short_words") else np.sqrt(c)  # small shares count
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each document."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            x = statistics(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, size: int = 256, width: float = 1.0, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, float), np.where(np.asarray(scale, float) > 1e-9, scale, 1.0)
        self.w = rng.normal(0, 1 / (width * len(NAMES) ** 0.5), (len(NAMES), size))
        self.shift = rng.uniform(0, 2 * np.pi, size)
        self.beta = np.zeros(size + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def z(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.shift) * (2 / self.w.shape[1]) ** 0.5
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.z(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.beta.any():  # nothing to learn from
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.curve) + 0.001 * raw, 0, 1)  # the rest keeps the order within a level


def rising(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing curve nearest to weighted points in order of ``at``."""
    blocks: list[list[float]] = []
    for x, v, w in zip(at.tolist(), value.tolist(), weight.tolist()):
        blocks.append([v, w, x * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, x1 = blocks.pop()
            v0, w0, x0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, x0 + x1])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def held(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(feats: DataFrame, labels: DataFrame, max_rows: int = 200_000, ridge: float = 1.0) -> Model:
    """Fit to labels (doc_id, quality) of rows that aren't held out; ``max_rows`` bounds how many are taken."""
    spark = feats.sparkSession
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    marks = marks.where(held(F.col("doc_id")) != 0)
    share = max_rows / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = feats.join(marks, "doc_id").select("x", "y", (held(F.col("doc_id")) == 4).alias("calibrate"))
    rows = Scratch(spark, "quality").save(rows, "labelled")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not 0 < sums["y"] < sums["n"]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model([sums[f"m{i}"] for i in range(len(NAMES))], [sums[f"s{i}"] for i in range(len(NAMES))])

    def equations(batches):
        a, b = np.zeros((len(model.beta), len(model.beta))), np.zeros(len(model.beta))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            z, y = model.z(x), batch.column("y").to_numpy()
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    def solve(part):
        a, b = np.zeros((len(model.beta), len(model.beta))), np.zeros(len(model.beta))
        for r in part.select("x", "y").repartition(PARTITIONS).mapInArrow(equations, "a binary, b binary").toLocalIterator():
            a += np.frombuffer(r["a"]).reshape(a.shape)
            b += np.frombuffer(r["b"])
        penalty = np.full(len(b), ridge * 1e-3 * max(1.0, a[-1, -1]) ** 0.5)
        penalty[-1] = 1e-6
        return np.linalg.solve(a + np.diag(penalty), b)

    model.beta = solve(rows.where("not calibrate"))
    bins = rows.where("calibrate").mapInArrow(_binned(model), "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    at, value, weight = (np.array(v, float) for v in ([(r["bin"] + 0.5) / BINS for r in bins], [r["y"] for r in bins], [r["n"] for r in bins]))
    if len(bins) and 0 < (value * weight).sum() < weight.sum():
        model.curve = rising(at, value, weight)
    else:
        model.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _binned(model: Model):
    def run(batches):
        for batch in batches:
            raw = model.raw(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(raw * BINS, BINS - 1).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    return run


def score(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    feats = Scratch(docs.sparkSession, "quality").save(features(docs), "features")
    model = fit(feats, labels)

    def run(batches):
        for batch in batches:
            s = model.score(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = feats.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The documents, all columns as they were, that score at least ``accept``."""
    model = fit(Scratch(docs.sparkSession, "quality").save(features(docs), "features"), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, at):
            good = model.score(statistics(batch.column(at).to_pylist())) >= accept
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
