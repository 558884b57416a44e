"""Joins that Spark has no operator for, as compositions of equi-joins and windows; and lookups with their rejects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixwave.operators import pieces

#: A dimension that was checked to be at most this many rows may be broadcast.
SMALL_ROWS = 100_000
#: About how many pairs of rows one task of ``meeting`` looks at.
TASK_PAIRS = 20_000_000
#: About how many points of one place are gathered into one before pairs are looked for.
GATHERED = 1_000
#: So many earlier rows are put beside an array of later ones at once.
HANDFUL = 64
#: A span of time is joined in so many buckets, so that pairs looked at are few more than pairs within it.
STEPS = 8
#: Buckets are wider than needed by this, which is far beyond what division rounds.
SLACK = 1 + 1e-9


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has at most ``rows`` rows; otherwise leave the choice of join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(facts: DataFrame, names: DataFrame, on: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts with the ``key`` of their name, and those whose name is unknown."""
    found = facts.join(small(names.select(on, key).dropDuplicates([on])), on, "left")
    return found.where(F.col(key).isNotNull()), found.where(F.col(key).isNull()).drop(key)


def asof_linear(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of right interpolated linearly at its time; rows outside right's range are dropped.

    Both sides are put in one order, in ranges; the last point before and the next after are carried along and over the edges
    of ranges, so that no group is one task's. Where right has several points of one time, the last by value stands.
    """
    points = right.groupBy(*by, at).agg(F.max(F.struct(*values)).alias("__p")).select(*by, at, F.struct(F.col(at).alias("t"), "__p.*").alias("__p"))
    rows = left.withColumn("__row", F.struct(*[F.col(c) for c in left.columns]))
    both = rows.select(*by, at, "__row", F.lit(None).cast(points.schema["__p"].dataType).alias("__p"))
    both = both.unionByName(points.select(*by, at, F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), "__p"))
    both = pieces.split(both, [*by, at])  # points of the row's own time count on both sides
    both = pieces.around(both, by, at, "__p", "__a", "__b")
    both = both.where("__row is not null and __a is not null and __b is not null")
    share = F.coalesce(F.try_divide(F.col(at) - F.col("__a.t"), F.col("__b.t") - F.col("__a.t")), F.lit(0.0))
    return both.select("__row.*", *[(F.col(f"__a.{v}") + share * (F.col(f"__b.{v}") - F.col(f"__a.{v}"))).alias(v) for v in values])


def meeting(one: DataFrame, two: DataFrame, on: list[str], sizes: tuple[str, str] = ("1", "1")) -> DataFrame:
    """The inner join of ``one`` and ``two`` where pairs far outnumber rows: it is dealt over tasks by pairs, not by bytes.

    Rows of each key are counted first; ``sizes`` says for how many rows a row of each side stands. There are as many tasks as the pairs need, which bytes of rows would not tell, and a key of
    very many pairs is cut into blocks of both sides' rows, each pair of which meets once. No side is broadcast, nothing left out.
    """
    n = one.groupBy(*on).agg(F.sum(F.expr(sizes[0])).alias("__n1")).join(two.groupBy(*on).agg(F.sum(F.expr(sizes[1])).alias("__n2")), on)
    n = n.withColumn("__pairs", F.col("__n1").cast("double") * F.col("__n2"))
    total, most = n.agg(F.coalesce(F.sum("__pairs"), F.lit(0.0)), F.coalesce(F.max("__pairs"), F.lit(0.0))).first()
    if total <= TASK_PAIRS // 8:
        return one.join(two, on)
    unit = TASK_PAIRS / 4
    if most > unit:
        cut = lambda x, y: F.ceil(F.sqrt(F.col("__pairs") / unit * F.col(x) / F.col(y)))  # noqa: E731  about equal copies of both sides
        hot = small(n.where(F.col("__pairs") > unit).select(*on, cut("__n1", "__n2").alias("__c1"), cut("__n2", "__n1").alias("__c2")))
        one, two = _blocks(one, hot, on, "__i", "__c1", "__j", "__c2"), _blocks(two, hot, on, "__j", "__c2", "__i", "__c1")
        on = [*on, "__i", "__j"]
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS))
    return one.repartition(tasks, *on).hint("merge").join(two.repartition(tasks, *on), on).drop("__i", "__j")


def _blocks(rows: DataFrame, hot: DataFrame, on: list[str], own: str, parts: str, other: str, others: str) -> DataFrame:
    """Rows of hot keys dealt into ``parts`` blocks by all their columns, once for each block of the other side."""
    columns = rows.columns
    rows = rows.join(hot, on, "left")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1).cast("long")) - 1)
    return rows.select(*columns, F.pmod(F.xxhash64(*columns), F.coalesce(parts, F.lit(1).cast("long"))).alias(own), F.explode(copies).alias(other))


def copies(df: DataFrame, at: list[str]) -> tuple[DataFrame, int] | None:
    """The number ``__n`` of rows of each ``at``, and the most of them; None unless two rows of a kind are usual."""
    n = df.na.drop(subset=at).groupBy(*at).agg(F.count("*").alias("__n"))  # a null meets nothing
    kinds, total, most = n.agg(F.count("*"), F.sum("__n"), F.max("__n")).first()
    return (n, most) if kinds and total >= 2 * kinds else None


def gathered(df: DataFrame, at: list[str], keep: list[str]) -> DataFrame | None:
    """Rows of equal ``at`` as one, with the array ``__rows`` of their ``keep``; None unless two rows of a kind are usual.

    Of more than ``GATHERED`` rows there are several arrays of about so many, dealt by what the rows keep.
    """
    if (found := copies(df, at)) is None:
        return None
    rows = df.na.drop(subset=at).select(*at, F.struct(*keep).alias("__r"))
    if found[1] > GATHERED:
        parts = found[0].where(F.col("__n") > GATHERED).select(*at, F.ceil(F.col("__n") / GATHERED).alias("__n"))
        rows = rows.join(small(parts), at, "left").withColumn("__n", F.pmod(F.xxhash64("__r"), F.coalesce("__n", F.lit(1).cast("long"))))
    else:
        rows = rows.withColumn("__n", F.lit(0))
    return rows.groupBy(*at, "__n").agg(F.sort_array(F.collect_list("__r")).alias("__rows")).drop("__n")


def _spread(pairs: DataFrame) -> DataFrame:
    """All pairs of the rows ``__rows_1`` with the rows ``__rows_2``, made one by one where the arrays met."""
    return pairs.withColumn("__rows_1", F.explode("__rows_1")).withColumn("__rows_2", F.explode("__rows_2"))


def range_pairs(df: DataFrame, by: list[str], at: str, least, most, keep: list[str], first: list[str] = (), second: list[str] = ()) -> DataFrame:
    """Pairs of rows of one group with least < later - earlier < most, which meet in time buckets of an eighth of ``most``.

    Both rows have ``keep``; ``first`` is kept of the earlier one only, ``second`` of the later one. Earlier rows meet the buckets
    that any later row may be in. Pairs may far outnumber rows, so they are counted first. If they are many, rows are shuffled
    once, by stretches of time (``_stretches``), and copied to the buckets they meet only in the task that has the stretch. There a
    handful of earlier rows gets the bucket's later rows as an array (of bounded size, ``_run``); both are in order of time, so that
    pairs come out in an order that packs well.
    """
    width = most / STEPS * SLACK
    near = max(0, math.floor(least / width / SLACK))
    kept = list(dict.fromkeys([*keep, *first, *second]))
    rows = df.na.drop(subset=[*by, at]).select(*by, F.col(at).alias("__t"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(kept)])
    own = rows.columns[len(by) :]
    columns = {at: "__t"} | {c: f"__k{k}" for k, c in enumerate(kept)}
    sides = [{"__t": "t" + side} | {columns[c]: c + side for c in [*keep, *extra]} for side, extra in (("_1", first), ("_2", second))]
    named = lambda side: [F.col(c).alias(x) for c, x in side.items()]
    bucket = F.floor(F.col("__t") / F.lit(width))
    n, total, heaviest, spans, most_later = _bucket_pairs(rows.groupBy(*by, bucket.alias("__b")).agg(F.count("*").alias("__n2")), by, near)
    if total <= TASK_PAIRS // 8:
        met = rows.select(*by, *named(sides[0]), F.explode(F.sequence(bucket + near, bucket + STEPS)).alias("__b")).join(rows.select(*by, *named(sides[1]), bucket.alias("__b")), [*by, "__b"])
    else:
        span = STEPS * max(1, spans // (4 * _tasks(rows, total)))
        cells, on = _stretches(rows.withColumn("__b", bucket), by, own, n, total, heaviest, spans, span)
        ahead, on = _ahead(cells.withColumn("__b", bucket), on, own, list(sides[1].keys()), near, span), [*on, "__b"]
        if most_later > (run := _run(most_later)):
            cuts = n.where(F.col("__n2") > run).select(*by, "__b", F.lit(1).cast("long").alias("__c1"), F.ceil(F.col("__n2") / run).alias("__c2"))
            ahead, on = _cut(ahead, cuts, [*by, "__b"], ["__rows", "__one"], "__x", "__y"), [*on, "__x", "__y"]
        whole = Window.partitionBy(*on).orderBy("__one", "__rows").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = ahead.withColumn("__later", F.collect_list("__one").over(whole)).where(F.col("__role") == 1).select(*by, F.inline("__rows").alias(*own), "__later")
        met = met.select(*by, *named(sides[0]), F.inline("__later").alias(*sides[1].values()))
    gap = F.col("t_2") - F.col("t_1")
    ends = [[*list(side.values())[1:], next(iter(side.values()))] for side in sides]
    return met.where((gap > least) & (gap < most)).select(*by, *ends[0], *ends[1])


def _ahead(cells: DataFrame, on: list[str], own: list[str], later: list[str], near: int, span: int) -> DataFrame:
    """Rows for each bucket ``__b`` that they meet: earlier ones (``__role`` 1) a handful at a time, as an array ``__rows`` in order of
    time, so that what is put beside them is put there once for all of these; later ones (2) one by one as ``__one``, with the columns ``later``."""
    order = Window.partitionBy(*on, "__role", "__b").orderBy(*own)
    some = cells.withColumn("__c", F.floor((F.row_number().over(order) - 1) / HANDFUL)).groupBy(*on, "__role", "__b", "__c").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("__rows"))
    there = lambda role: F.col("__role").bitwiseAND(role) > 0
    low, high = F.greatest(F.col("__b") + near, F.col("__p") * span), F.least(F.col("__b") + STEPS, F.col("__p") * span + span - 1)
    one = lambda x: F.struct(*[x[c].alias(c) for c in later])
    ahead = F.transform(F.filter(F.sequence(low, F.greatest(low, high)), lambda b: there(1) & (b <= high)), lambda b: F.struct(b.alias("__b"), F.lit(1).alias("__role"), F.get(F.transform(F.slice("__rows", 1, 0), one), F.lit(0)).alias("__one")))
    here = F.transform(F.filter("__rows", lambda _: there(2)), lambda x: F.struct(F.col("__b").alias("__b"), F.lit(2).alias("__role"), one(x).alias("__one")))
    met = some.select(*on, "__rows", F.inline(F.concat(ahead, here)).alias("__b", "__role", "__one"))
    return met.withColumn("__rows", F.when(F.col("__role") == 1, F.col("__rows")))


def _run(most_later: int) -> int:
    """Of how many later rows an array is made: half of a bucket's, so that earlier rows are seldom copied, within bounds."""
    return min(max(GATHERED, most_later // 2), 20 * GATHERED)


def _bucket_pairs(n: DataFrame, by: list[str], near: int) -> tuple[DataFrame, float, float, int, int]:
    """Rows ``__n1`` and ``__n2`` that meet in each bucket and their ``__pairs``; all pairs, the most of a span of STEPS buckets, spans with any, most later rows of a bucket."""
    ahead = n.select(*by, F.explode(F.sequence(F.col("__b") + near, F.col("__b") + STEPS)).alias("__b"), F.col("__n2").alias("__n1"))
    n = ahead.groupBy(*by, "__b").agg(F.sum("__n1").alias("__n1")).join(n, [*by, "__b"]).withColumn("__pairs", F.col("__n1").cast("double") * F.col("__n2"))
    spans = n.groupBy(*by, F.floor(F.col("__b") / STEPS)).agg(F.sum("__pairs").alias("__pairs"), F.max("__n2").alias("__n2"))
    return n, *spans.agg(F.coalesce(F.sum("__pairs"), F.lit(0.0)), F.max("__pairs"), F.count("*"), F.max("__n2")).first()


def _tasks(df: DataFrame, pairs: float) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))


def _stretches(rows: DataFrame, by: list[str], own: list[str], n: DataFrame, total: float, heaviest: float, spans: int, span: int) -> tuple[DataFrame, list[str]]:
    """Rows dealt over tasks by stretches ``__p`` of ``span`` buckets, and the keys they are dealt by.

    A row goes to its own stretch, and to the next one if later rows of that may be in reach. ``__role`` says whether it is there
    as the earlier (1) or the later one (2) of a pair, or both (3). What has more than a partition's share of all pairs is cut into
    blocks, which takes more copies.
    """
    part, on = (lambda b: F.floor(b / span)), [*by, "__p"]
    home = part(F.col("__b"))
    places = F.transform(F.sequence(home, part(F.col("__b") + STEPS)), lambda p: F.struct(p.alias("__p"), F.when(p == home, 3).otherwise(1).alias("__role")))
    rows = rows.select(*by, *own, F.inline(places).alias("__p", "__role"))
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = max(TASK_PAIRS / 4, total / shares)
    dealt = on
    if heaviest * (span // STEPS) > unit:
        parts = n.groupBy(*by, part(F.col("__b")).alias("__p")).agg(*[F.sum(c).alias(c) for c in ("__n1", "__n2", "__pairs")]).where(F.col("__pairs") > unit)
        cut = lambda x, y: F.ceil(F.sqrt(F.col("__pairs") / unit * F.col(x) / F.col(y)))  # noqa: E731  about equal copies of both roles
        rows = _cut(rows, parts.select(*on, cut("__n1", "__n2").alias("__c1"), cut("__n2", "__n1").alias("__c2")), on, own, "__i", "__j")
        dealt = [*on, "__i", "__j"]
    tasks = _tasks(rows, total)
    if spans < 4 * total / TASK_PAIRS:  # so few keys should not meet in one task by chance
        tasks = max(shares, 4 * min(tasks, spans + 2 * shares))
    return rows.repartition(tasks, *dealt), dealt


def _cut(rows: DataFrame, cuts: DataFrame, at: list[str], own: list[str], i: str, j: str) -> DataFrame:
    """Rows dealt into blocks where ``cuts`` has their ``at``: ``__c1`` of earlier rows by ``__c2`` of later ones, so that each pair meets once."""
    columns, one = [c for c in rows.columns if c != "__role"], F.lit(1).cast("long")
    rows = rows.join(small(cuts), at, "left").withColumn("__c1", F.coalesce("__c1", one)).withColumn("__c2", F.coalesce("__c2", one))
    x, y = F.pmod(F.xxhash64(F.lit(i), *own), "__c1"), F.pmod(F.xxhash64(F.lit(j), *own), "__c2")
    role, block = F.col("__role"), lambda x, y, role: F.struct(x.alias(i), y.alias(j), role.alias("__role"))
    earlier = F.transform(F.filter(F.sequence(one - 1, F.col("__c2") - 1), lambda k: role != 2), lambda k: block(x, k, F.when((role == 3) & (k == y), 3).otherwise(1)))
    later = F.transform(F.filter(F.sequence(one - 1, F.col("__c1") - 1), lambda k: (role == 2) | ((role == 3) & (k != x))), lambda k: block(k, y, F.lit(2)))
    return rows.select(*columns, F.inline(F.concat(earlier, later)).alias(i, j, "__role"))


def windows_of(at: Column, first: Column, last: Column, step: int, width: int) -> Column:
    """Centres, at multiples of ``step``, of the windows [centre - width/2, centre + width/2) that hold ``at``.

    Centres run from the first multiple at or after first + width/2 to the last at or before last - width/2.
    """
    half = F.lit(width / 2.0)
    low = F.greatest(F.floor((at - half) / step) + 1, F.ceil(F.floor(first + half) / step))
    high = F.least(F.floor((at + half) / step), F.floor(F.floor(last - half) / step))
    none = F.array().cast("array<bigint>")
    return F.when(high >= low, F.transform(F.sequence(low, F.greatest(high, low)), lambda k: k * step)).otherwise(none)


def interval_join(df: DataFrame, by: list[str], at: str, step: int, width: int) -> DataFrame:
    """Each row once for every sliding window that holds it, with the window's ``centre``; an equi-expansion, no theta join."""
    bounds = df.groupBy(*by).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    rows = df.join(bounds, by)
    return rows.withColumn("centre", F.explode(windows_of(F.col(at), F.col("__first"), F.col("__last"), step, width))).drop("__first", "__last")


def near_pairs(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of different points within ``radius``: an equi-join on grid cells, one side also in the eight cells around.

    There may be many more pairs than points; see ``meeting``. Points of one place are met as one where that is usual
    (``gathered``); their pairs are made after it.
    """
    own = gathered(df, [x, y], [key])
    if own is None:
        return near(df, key, x, y, radius).where(F.col(f"{key}_1") != F.col(f"{key}_2")).select(F.col(f"{key}_1").alias("k_1"), "x_1", "y_1", F.col(f"{key}_2").alias("k_2"), "x_2", "y_2")
    pairs = _spread(near(own, "__rows", x, y, radius, "size({})"))
    pairs = pairs.select(F.col("__rows_1")[key].alias("k_1"), "x_1", "y_1", F.col("__rows_2")[key].alias("k_2"), "x_2", "y_2")
    return pairs.where(F.col("k_1") != F.col("k_2"))


def near(df: DataFrame, keep: str, x: str, y: str, radius: float, size: str = "1") -> DataFrame:
    """(keep_1, x_1, y_1, keep_2, x_2, y_2) of all pairs within ``radius``, each row with itself too.

    ``size`` says for how many points a row stands, as SQL with a place for the name of the kept column.
    """
    side = radius * SLACK
    cx, cy = F.floor(F.col(x) / side), F.floor(F.col(y) / side)
    around = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    one = df.select(F.col(keep).alias(f"{keep}_1"), F.col(x).alias("x_1"), F.col(y).alias("y_1"), F.explode(around).alias("c")).select(f"{keep}_1", "x_1", "y_1", "c.cx", "c.cy")
    two = df.select(F.col(keep).alias(f"{keep}_2"), F.col(x).alias("x_2"), F.col(y).alias("y_2"), cx.alias("cx"), cy.alias("cy"))
    gap = F.hypot(F.col("x_1") - F.col("x_2"), F.col("y_1") - F.col("y_2"))
    return meeting(one, two, ["cx", "cy"], (size.format(f"{keep}_1"), size.format(f"{keep}_2"))).where(gap <= radius).drop("cx", "cy")


def banded(df: DataFrame, value: str, bands: DataFrame, limit: str, label: str) -> DataFrame:
    """The label of the smallest limit that a value doesn't exceed; null above all limits.

    ``bands`` is a threshold table of a few rows; it becomes one sorted array on every row rather than a range join.
    """
    table = bands.agg(F.sort_array(F.collect_list(F.struct(F.col(limit).alias("l"), F.col(label).alias("c")))).alias("__bands"))
    rows = df.crossJoin(F.broadcast(table))  # one row
    return rows.withColumn(label, F.get(F.filter("__bands", lambda b: F.col(value) <= b["l"]), F.lit(0))["c"]).drop("__bands")


def last_values(df: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """The latest value of each column in each group."""
    return df.groupBy(*by).agg(*[F.max_by(v, at).alias(v) for v in values])


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(present, on, "left_anti")


def combinations(df: DataFrame, by: list[str], key: str, repeat: bool = False) -> DataFrame:
    """Unordered pairs of keys within a group; with ``repeat`` also each with itself."""
    one, two = df.select(*by, F.col(key).alias("a")), df.select(*by, F.col(key).alias("b"))
    return one.join(two, by).where(F.col("a") <= F.col("b") if repeat else F.col("a") < F.col("b"))
