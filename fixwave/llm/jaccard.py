"""N-gram Jaccard join: sets of shingles as count vectors, bounded by summed coordinate minima, verified one by one.

Equal sets are one node from the start. Sets that can reach the threshold share one of their first few elements in any
common order (prefix filtering); elements that recur much come last in that order, so that what many documents quote opens
no block of its own. Within a block:

- every set is first tried with one leader, the set that meets most others, and what links to it is merged;
- blocks that then still hold two components, of whatever size, are searched by R-tree (blocks of the same sets are one):
  the sets' count vectors (elements hashed into groups, one count for each group) are packed by sort, tile and recursion (by
  size, then by the count of half the groups) into leaves of FAN sets, leaves into nodes of FAN leaves, and so on to one root;
  a box holds the greatest count of each group, the least and greatest size, and whether it is of one component. Pairs of
  boxes are descended from the root with itself; a pair is passed over where the summed minima of coordinates can't reach the
  overlap that the threshold asks for, where sizes differ too much, or where all is one component;
- surviving pairs of different components are verified on the sets themselves.

A link skipped this way is within a component already, so components lose nothing. Blocks of more than CHUNK sets are tiled by
bands of size (links are within a band or from one to the next) and the bands cut into chunks; pairs of chunks are trees of
their own. Tiles of many blocks are searched together, so that a task works on arrays whatever the sizes of its blocks.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; repeated rows share a
set, hence a component; the component's name is its least doc_id (nulls come last); an empty table gives an empty frame;
other columns are ignored. Elements and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, lookup, prepare, slices
from fixwave.llm.graph import components
from fixwave.llm.rolling import mix
from fixwave.llm.shingles import shingle_sets

GROUPS = 256  # coordinates of a count vector, at least; a count is a byte and stops at 255, which the bound allows for
DENSE = 8  # elements for each coordinate, at most: of more, summed minima of unrelated sets come near the sets' size
FAN = 4  # children of a node of the tree
CHUNK = 2048  # sets of a block that one tree holds
TILE = 8192  # rows of blocks that are searched together, about
PAIRS = 8192  # pairs of boxes compared at once
MAX_COMMON = 200_000  # elements put last in the order, at most; it is a fixed 1.6 MB
SLICE = 1 << 20


def set_id(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix(s: np.ndarray, common: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The elements of which any set that reaches the threshold must share one."""
    n = len(s)
    keep = n - (percent * n + 99) // 100 + 1
    if not len(common):
        return s[:keep]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    last = common[at] == s
    rare = s[~last]
    if len(rare) >= keep:
        return rare[:keep]
    often = s[last][np.argsort(place[at[last]], kind="stable")]
    return np.concatenate([rare, often[: keep - len(rare)]])


def groups(n: int) -> int:
    """Coordinates for a set of n elements: a power of two times GROUPS, so that vectors of unlike lengths can be folded to one."""
    g = GROUPS
    while g * DENSE < n:
        g *= 2
    return g


def counts(s: np.ndarray) -> np.ndarray:
    g = groups(len(s))
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % g, minlength=g), 255).astype(np.uint8)


def folded(v: np.ndarray, g: int) -> np.ndarray:
    """The count vector over g groups, from one over a multiple of them."""
    return v if len(v) == g else np.minimum(v.reshape(-1, g).sum(axis=0, dtype=np.int64), 255).astype(np.uint8)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of a and b: no overlap is larger than this (a full count may stand for more)."""
    least = np.minimum(a, b)
    full = (least == 255).any(axis=1)
    return np.where(full, np.iinfo(np.int64).max, least.sum(axis=1, dtype=np.int64))


def needed(n, m, percent: int):
    """The least overlap of sets of n and m elements at the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def common_elements(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that recur much, in order of hash, and their places from rarest to most frequent. Only an order hangs on them."""

    def run(batches):
        held, total = [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], names=["element", "n"])

        for batch in slices(batches, size=SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            held += sets
            total += sum(map(len, sets))
            if total > 1_000_000:
                yield counted()
                held, total = [], 0
        if held:
            yield counted()

    often = docs.select("text").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where("n >= 16")
    rows = often.orderBy(F.desc("n"), "element").limit(MAX_COMMON).toPandas()
    key = rows["element"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.arange(len(key), 0, -1, dtype=np.int64)[order]


def _identified(size: int, kind: str):
    def run(batches):
        for batch in slices(batches, size=SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            ids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n_shingles", "set_id"])

    return run


def _prefixes(size: int, common, place, percent: int):
    def run(batches):
        for batch in slices(batches, size=SLICE):
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), size) if len(s)]
            ids = {set_id(s): s for s in sets}  # copies within the slice once
            parts = [prefix(s, common, place, percent) for s in ids.values()]
            if parts:
                n = [len(p) for p in parts]
                cols = [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(list(ids), np.int64), n))]
                yield pa.RecordBatch.from_arrays(cols, names=["element", "set_id"])

    return run


def _values(size: int, of):
    """A mapInArrow function: of each wanted set, the bytes of ``of`` (its count vector, or the elements themselves)."""

    def run(batches):
        for batch in slices(batches, size=SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            own = [len(s) > 0 and set_id(s) == i for s, i in zip(sets, batch.column("set_id").to_pylist())]
            batch, sets = batch.filter(pa.array(own)), [s for s, x in zip(sets, own) if x]  # not another text of a repeated doc_id
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([of(s).tobytes() for s in sets], pa.binary())], names=["set_id", "value"])

    return run


def _bounded(percent: int):
    """A mapInArrow function: pairs (a, b, n, m, va, vb) whose summed minima allow a link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                va, vb = ([np.frombuffer(v, np.uint8) for v in batch.column(c).to_pylist()] for c in ("va", "vb"))
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
                good = np.empty(batch.num_rows, bool)
                size = np.array([min(len(x), len(y)) for x, y in zip(va, vb)])
                for g in np.unique(size).tolist():
                    rows = np.flatnonzero(size == g)
                    x, y = (np.array([folded(v[i], g) for i in rows.tolist()]) for v in (va, vb))
                    good[rows] = bound(x, y) >= needed(n[rows], m[rows], percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verified(percent: int):
    """A mapInArrow function: pairs (a, b, ea, eb) of sets that are similar enough."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ea"), batch.column("eb")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class Forest:
    """R-trees over the count vectors of many blocks, one tree for each block, built and descended level by level.

    ``side`` and ``across``: in blocks marked by ``across`` only sets of different sides are pairs.
    """

    def __init__(self, block, n, comp, vectors, percent: int, side=None, across=None):
        self.percent, self.visited = percent, 0
        many = np.bincount(block)
        # sort, tile, recurse: slabs in order of size, and within slabs the count of the first half of the groups
        order = np.lexsort((comp, n, block))
        place = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
        leaves = -(-many // FAN)
        slab = place // (FAN * np.maximum(1, np.ceil(leaves / np.ceil(np.sqrt(np.maximum(leaves, 1)))).astype(np.int64)))[block[order]]
        half = vectors[:, : vectors.shape[1] // 2].sum(axis=1, dtype=np.int64)
        order = order[np.lexsort((half[order], slab, block[order]))]
        self.order = order
        zero = np.zeros(len(block), np.int64)
        side, across = (zero if x is None else np.asarray(x) for x in (side, across))
        self.across = across[order].astype(bool)
        n, comp, side = n[order], comp[order], side[order]
        self.levels = [{"block": block[order], "top": vectors[order], "low": n, "high": n, "c0": comp, "c1": comp, "s0": side, "s1": side, "across": self.across}]
        while len(self.levels) == 1 or len(self.levels[-1]["block"]) > len(np.unique(block)):
            below = self.levels[-1]
            of = below["block"]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
            start = np.flatnonzero(place % FAN == 0)
            level = {c: np.maximum.reduceat(below[c], start) for c in ("top", "high", "c1", "s1")} | {c: np.minimum.reduceat(below[c], start) for c in ("low", "c0", "s0")}
            self.levels.append(level | {"block": of[start], "across": below["across"][start], "start": start, "size": np.diff(np.r_[start, len(of)])})

    def _fits(self, level, i, j):
        x = self.levels[level]
        self.visited += len(i)
        one = (x["c0"][i] == x["c1"][i]) & (x["c0"][j] == x["c1"][j]) & (x["c0"][i] == x["c0"][j])
        alike = x["across"][i] & (x["s0"][i] == x["s1"][i]) & (x["s0"][j] == x["s1"][j]) & (x["s0"][i] == x["s0"][j])
        near = (100 * x["high"][i] >= self.percent * x["low"][j]) & (100 * x["high"][j] >= self.percent * x["low"][i])
        keep = np.flatnonzero(near & ~one & ~alike)
        i, j = i[keep], j[keep]
        good = bound(x["top"][i], x["top"][j]) >= needed(x["low"][i], x["low"][j], self.percent)
        return i[good], j[good]

    def pairs(self):
        """Index pairs of sets of different components that the bounds allow, in pieces."""
        roots = np.arange(len(self.levels[-1]["block"]))
        todo = [(len(self.levels) - 1, roots[k : k + PAIRS], roots[k : k + PAIRS]) for k in range(0, len(roots), PAIRS)]
        while todo:
            level, i, j = todo.pop()
            i, j = self._fits(level, i, j)
            if level == 0:
                if len(i):
                    yield self.order[i], self.order[j]
                continue
            x = self.levels[level]
            n, m = x["size"][i], x["size"][j]
            at = np.repeat(np.arange(len(i)), n * m)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            p, q = x["start"][i][at] + k // m[at], x["start"][j][at] + k % m[at]
            keep = p < q if level == 1 else p <= q
            p, q = p[keep], q[keep]
            todo += [(level - 1, p[k : k + PAIRS], q[k : k + PAIRS]) for k in range(0, len(p), PAIRS)]


def _searched(percent: int):
    """An applyInPandas function: the pairs that the trees of a tile's blocks find, and a row of how many pairs of boxes they met."""

    def run(pdf):
        import pandas as pd

        block = pdf.groupby(["element", "ib", "i", "jb", "j"], sort=False).ngroup().to_numpy(np.int64)
        vectors = np.array([folded(np.frombuffer(v, np.uint8), GROUPS) for v in pdf["vector"]])
        across = ((pdf["ib"] != pdf["jb"]) | (pdf["i"] != pdf["j"])).to_numpy()
        forest = Forest(block, pdf["n"].to_numpy(np.int64), pdf["comp"].to_numpy(np.int64), vectors, percent, pdf["side"].to_numpy(np.int64), across)
        ids = pdf["set_id"].to_numpy(np.int64)
        found = [(np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])) for p, q in forest.pairs()]
        a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        pairs = pd.DataFrame({"a": a, "b": b}).drop_duplicates()
        count = pd.DataFrame({"a": [0], "b": [0], "visited": [forest.visited]})
        return pd.concat([pairs.assign(visited=0), count], ignore_index=True).astype("int64")

    return run


def links(docs: DataFrame, percent: int = 80, size: int = 5, trace: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, n_shingles, set_id), and links between different sets (a, b) that span all components.

    ``trace``, if given, is told how many ``rows`` of open blocks the trees indexed and how many pairs of boxes they ``visited``.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "jaccard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    sets = scratch.save(docs.mapInArrow(_identified(size, kind), f"doc_id {kind}, n_shingles long, set_id long"), "sets")
    common, place = common_elements(docs, size)
    # elements that two sets or more have in their prefixes; prefixes are cheap to compute, so they are made twice, not kept
    rows = docs.mapInArrow(_prefixes(size, common, place, percent), "element long, set_id long")
    shared = rows.groupBy("element").agg(F.count("*").alias("many")).where("many > 1").select("element")
    rows = scratch.save(rows.join(shared, "element", "left_semi").distinct(), "shared", compression="lz4")
    blocks = rows.groupBy("element").agg(F.count("*").alias("many")).where("many > 1")
    rows = scratch.save(rows.join(blocks, "element"), "blocks", compression="lz4")
    scratch.drop("shared")
    # vectors and elements of the sets that are in a block
    one = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("of"), F.first("n_shingles").cast("int").alias("n"))
    met = scratch.save(rows.groupBy("set_id").agg(F.sum("many").alias("meets")).join(one, "set_id"), "met")
    vectors = scratch.save(_fetch(docs, met, size, counts).withColumnRenamed("value", "vector"), "vectors", compression="lz4")
    # each set with the leader of each of its blocks
    ranked = rows.join(_small(met.select("set_id", "meets")), "set_id")
    leaders = ranked.groupBy("element").agg(F.max(F.struct("meets", "set_id")).alias("l")).select("element", F.col("l.set_id").alias("leader"))
    pairs = rows.join(leaders, "element").where("leader <> set_id").select(F.least("leader", "set_id").alias("a"), F.greatest("leader", "set_id").alias("b")).distinct()
    near = _verify(scratch, "near", docs, pairs, met, vectors, percent, size)
    # blocks that still hold different components
    roots = components(near)
    comp = met.join(roots, met["set_id"] == roots["node"], "left").select("set_id", "n", F.coalesce("root", "set_id").alias("comp"))
    comp = scratch.save(comp, "comp")
    rows = rows.select("element", "set_id").join(_small(comp), "set_id")
    open_ = rows.groupBy("element").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("many")).where("low <> high").select("element", "many")
    rows = scratch.save(rows.join(open_, "element"), "open", compression="lz4")
    more = _search(scratch, rows, vectors, percent, trace)
    rest = _verify(scratch, "rest", docs, more, met, vectors, percent, size)
    return sets, near.unionByName(rest)


def _small(df: DataFrame) -> DataFrame:
    """The frame, to be met by a shuffle, whatever its size: plans are the same for inputs of every size."""
    return df.hint("merge")


def _fetch(docs: DataFrame, wanted: DataFrame, size: int, of) -> DataFrame:
    """(set_id, value) of the wanted sets (set_id, of: a document that has it), computed from the texts again."""
    wanted = _small(wanted.select("set_id", F.col("of").alias("__of")))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__of"])).select("set_id", "text")
    return texts.mapInArrow(_values(size, of), "set_id long, value binary").dropDuplicates(["set_id"])


def _verify(scratch: Scratch, name: str, docs: DataFrame, pairs: DataFrame, met: DataFrame, vectors: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) that link: first by size, then by summed minima, then by their elements, fetched for those pairs alone."""
    n = _small(met.select("set_id", "n"))
    pairs = pairs.join(n.select(F.col("set_id").alias("a"), "n"), "a").join(n.select(F.col("set_id").alias("b"), F.col("n").alias("m")), "b")
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    both = pairs.join(vectors.select(F.col("set_id").alias("a"), F.col("vector").alias("va")), "a").join(vectors.select(F.col("set_id").alias("b"), F.col("vector").alias("vb")), "b")
    pairs = scratch.save(both.select("a", "b", "n", "m", "va", "vb").mapInArrow(_bounded(percent), "a long, b long"), f"{name}-bounded")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    elements = scratch.save(_fetch(docs, met.join(wanted, "set_id", "left_semi"), size, _itself), f"{name}-elements", compression="lz4")
    both = pairs.join(elements.select(F.col("set_id").alias("a"), F.col("value").alias("ea")), "a").join(elements.select(F.col("set_id").alias("b"), F.col("value").alias("eb")), "b")
    found = scratch.save(both.select("a", "b", "ea", "eb").mapInArrow(_verified(percent), "a long, b long"), name)
    scratch.drop(f"{name}-elements")
    return found


def _itself(s: np.ndarray) -> np.ndarray:
    return s


def _search(scratch: Scratch, rows: DataFrame, vectors: DataFrame, percent: int, trace: dict | None) -> DataFrame:
    """Pairs of different components within open blocks that the trees over their count vectors allow."""
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    distinct = rows.groupBy("element", "many").agg(*marks).groupBy("m1", "m2", "many").agg(F.min("element").alias("element"))
    rows = rows.join(distinct.select("element"), "element", "left_semi")
    whole = rows.where(F.col("many") <= CHUNK).select("element", *[F.lit(0).alias(c) for c in ("ib", "i", "jb", "j")], "set_id", "n", "comp", F.lit(0).cast("long").alias("side"))
    # larger blocks: bands of size, each a little wider than the threshold's ratio, and chunks of bands
    wide = F.floor(F.log(F.col("n")) / F.lit(1.001 * float(np.log(100 / percent)) if percent < 100 else 1.0)).cast("int")
    large = rows.where(F.col("many") > CHUNK).withColumn("band", wide)
    chunks = large.groupBy("element", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    beside = lambda d, name: chunks.select("element", (F.col("band") + d).alias("band"), F.col("chunks").alias(name))
    large = large.join(chunks, ["element", "band"]).join(beside(-1, "above"), ["element", "band"], "left").join(beside(1, "below"), ["element", "band"], "left")
    large = large.withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    cell = lambda ib, i, jb, j: F.struct(ib.alias("ib"), i.alias("i"), jb.alias("jb"), j.alias("j"))
    band, chunk = F.col("band"), F.col("chunk")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(
        F.transform(upto(F.col("chunks")), lambda k: cell(band, F.least(chunk, k), band, F.greatest(chunk, k))),
        F.transform(upto(F.col("above")), lambda k: cell(band, chunk, band + 1, k)),
        F.transform(upto(F.col("below")), lambda k: cell(band - 1, k, band, chunk)),
    )
    side = (band.cast("long") * 1_000_000 + chunk).alias("side")
    large = large.select("element", F.explode(cells).alias("c"), "set_id", "n", "comp", side).select("element", "c.*", "set_id", "n", "comp", "side")
    cells = scratch.save(whole.unionByName(large), "cells", compression="lz4")
    total = cells.count()
    tile = F.pmod(F.xxhash64("element", "ib", "i", "jb", "j"), F.lit(-(-total // TILE) or 1)).alias("tile")
    found = cells.join(vectors.select("set_id", "vector"), "set_id").select(tile, *cells.columns, "vector").groupBy("tile").applyInPandas(_searched(percent), "a long, b long, visited long")
    found = scratch.save(found, "found")
    if trace is not None:
        trace |= {"rows": total, "visited": found.agg(F.coalesce(F.sum("visited"), F.lit(0))).first()[0]}
    return found.where("visited = 0").select("a", "b").distinct()


def classes(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    scratch = Scratch(docs.sparkSession, "classes")
    sets, edges = links(docs, percent, size)
    one = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    roots = components(edges)
    one = scratch.save(one.join(roots, one["set_id"] == roots["node"], "left").select("set_id", "least", F.coalesce("root", "set_id").alias("c")), "roots")
    names = scratch.save(one.groupBy("c").agg(F.min("least").alias("component_id")), "names")
    named = scratch.save(lookup(one.select("set_id", "c"), names, "c").select("set_id", "component_id"), "named")
    out = lookup(sets, named, "set_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents, all columns as they were, less those linked to one of a lesser doc_id (of equal doc_ids, the lesser hash
    of the text). Documents without words link with nothing and stay; rows equal in doc_id and text are one."""
    key = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"))
    found = classes(docs.select(key.alias("doc_id"), "text"), percent, size)
    keep = found.select(F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("k")).distinct()
    keep = keep.select(F.col("k.doc_id").alias("of"), F.col("k.mark").alias("mark"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs["doc_id"].alias("of"), F.xxhash64(docs["text"]).alias("mark"))
    kept = rows.join(keep, rows["of"].eqNullSafe(keep["of"]) & rows["mark"].eqNullSafe(keep["mark"]), "left_semi")
    return kept.dropDuplicates(["of", "mark"]).select("d.*")


def brute_force(texts: dict[int, str | None], percent: int = 80, size: int = 5) -> dict[int, tuple[int, int]]:
    """The same for a small table, straight from the definition; for tests."""
    import re

    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}
