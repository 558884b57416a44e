"""What a user may see and change, and the small predicates and figures of dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Curves of the score error over the variation of an interval (a / (x + b) + c), and days of named durations.
SCORE_ERROR = {"hyper": (-0.6324, 7.7640, 0.1255), "const_low": (0.0, 1.0, 0.02), "const_high": (0.0, 1.0, 0.1255)}
DURATION_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def visible(df: DataFrame) -> DataFrame:
    """Rows that are not hidden; an unknown flag hides nothing."""
    return df.where(~F.coalesce(F.col("is_hidden"), F.lit(False)))


def active_first(deployments: DataFrame, project: int) -> DataFrame:
    """A project's deployments that are not hidden, active ones first."""
    return visible(deployments.where(F.col("projectID") == project)).orderBy(F.desc("is_active"), "ID")


def permissions(projects: DataFrame, user: int, groups: list[int], viewers: DataFrame, collaborators: DataFrame, granted: list[str]) -> DataFrame:
    """``can_view``, ``can_change`` and ``can_delete`` of each project for a user of these groups with these permissions.

    Owners may do all; collaborators what they were granted; viewers see if granted; everybody sees what is public.
    """
    member = lambda t, name: t.where(F.col("groupID").isin(groups)).select(F.col("projectID").alias("ID"), F.lit(True).alias(name)).distinct()
    rows = projects.join(member(collaborators, "__c"), "ID", "left").join(member(viewers, "__v"), "ID", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    owner, helper, viewer = yes(F.col("ownerID") == user), yes(F.col("__c")), yes(F.col("__v"))
    may = lambda name: F.lit(name in granted)
    return rows.withColumns({
        "can_view": yes(F.col("is_public")) | owner | ((helper | viewer) & may("view")),
        "can_change": owner | (helper & may("can_change")),
        "can_delete": owner | (helper & may("can_delete")),
    }).drop("__c", "__v")


def allowed(rows: DataFrame, rights: DataFrame, right: str = "can_view") -> DataFrame:
    """Rows of the projects that the rights allow, as a semi join."""
    return rows.join(rights.where(right).select(F.col("ID").alias("projectID")), "projectID", "left_semi")


def score_error(variation: Column, curve: str = "const_high") -> Column:
    a, b, c = SCORE_ERROR[curve]
    return F.lit(a) / (variation + b) + c


def duration_days(name: Column) -> Column:
    """Days of a duration by name in any case, or by number; null for anything else."""
    out = F.expr("try_cast(null as int)")
    for k, v in DURATION_DAYS.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return F.coalesce(out, name.try_cast("int"))


def plot_frame(value: Column, centre: float, half: int, scale: float) -> Column:
    """A coordinate's pixel in a frame of 2 * half pixels around the centre; cut towards zero before it is shifted."""
    return ((value - centre) / scale).cast("int") + half


def from_plot_frame(pixel: Column, centre: float, half: int, scale: float) -> Column:
    return (pixel - half) * scale + centre


def expected_pulses(seconds: Column, pulse_interval: Column, found: Column) -> tuple[Column, Column]:
    """(expected, missed) pulses of a time; null without an interval."""
    total = F.try_divide(seconds, pulse_interval)
    return total, total - found


def noise(signals: DataFrame, by: list[str], channels: int = 4) -> DataFrame:
    """Mean and spread of each site's signal power (edsp less the noise trace) and noise power of one channel."""
    trace = sum((F.col(f"nc{c}{c}r") for c in range(2, channels + 1)), F.col("nc11r"))
    power = {"signal": F.col("edsp") - trace, "noise": trace / channels}
    return signals.groupBy(*by).agg(*[f(x).alias(f"{n}_{k}") for k, x in power.items() for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def bounding_box(df: DataFrame, by: list[str], x: str, y: str, weight: str | None = None, share: float = 0.9) -> DataFrame:
    """Least and greatest coordinates of each group; by ``weight``, of points above that share of the group's greatest."""
    if weight:
        top = df.groupBy(*by).agg(F.max(weight).alias("__top"))
        df = df.join(top, by).where(F.col(weight) > share * F.col("__top"))
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for f, n in ((F.min, "min"), (F.max, "max"))])


def newest(df: DataFrame, by: list[str], name: str, cap: int = 20) -> DataFrame:
    """The last folders by name of each group, newest first; the cap is how many one run takes in.

    Sorting stops at the cap: Spark keeps the first of each group in every partition before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(name)))
    return df.select(*by, name).distinct().withColumn("place", rank).where(F.col("place") <= cap)


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def pulse_index(index: Column, appended: Column, channels: int = 4) -> Column:
    """Where a pulse is in a full ring buffer after samples were appended: one place down a whole frame, to -1 once it left."""
    frames = F.floor(appended / channels)
    return F.when(index >= 0, F.greatest(index - frames, F.lit(-1))).otherwise(index)


def calibration_samples(samples: DataFrame, band3: float, band10: float, angle: float, distance: float) -> DataFrame:
    """Samples narrow, level, far and unobstructed enough to calibrate by; what isn't known to be so is left out."""
    return samples.where((F.col("band3") < band3) & (F.col("band10") < band10) & (F.abs("elevation_angle") < angle) & (F.col("distance") > distance) & F.col("can_see"))
