"""Complex pairs, levels, times, text and blanks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATIONS = {"day": 86_400, "week": 7 * 86_400, "month": 30 * 86_400, "year": 365 * 86_400}
Complex = tuple[Column, Column]


def conj(z: Complex) -> Complex:
    return z[0], -z[1]


def times(x: Complex, y: Complex) -> Complex:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]


def power(z: Complex) -> Column:
    return z[0] * z[0] + z[1] * z[1]


def phase(z: Complex) -> Column:
    return F.atan2(z[1], z[0])


def turned(z: Complex, angle: Column) -> Complex:
    """z times exp(i angle)."""
    return times(z, (F.cos(angle), F.sin(angle)))


def inner(xs: list[Complex], ys: list[Complex]) -> Complex:
    """Sum of x times the conjugate of y."""
    re, im = F.lit(0.0), F.lit(0.0)
    for x, y in zip(xs, ys):
        p = times(x, conj(y))
        re, im = re + p[0], im + p[1]
    return re, im


def decibels(p: Column, q: Column) -> Column:
    return 10 * F.log10(F.try_divide(p, q))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def local_text(epoch: Column, zone: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local wall-clock text of seconds since 1970."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), fmt)


def epoch_of(local: Column, zone: str) -> Column:
    """Seconds since 1970 of local wall-clock text."""
    return F.unix_timestamp(F.to_utc_timestamp(local, zone))


def padded(value: Column, width: int = 16) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def shortened(value: Column, width: int) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value)


def site_label(name: Column) -> Column:
    """``site12`` as ``Site 12``."""
    return F.regexp_replace(F.initcap(name), r"^([A-Za-z]+)([0-9]+)$", "$1 $2")


def colour_index(name: Column, n: int) -> Column:
    return F.pmod(F.crc32(name.cast("binary")), F.lit(n)).cast("int")


def shade(value: Column, most: Column) -> Column:
    """Two hexadecimal digits, ff for nothing down to 14 for the most."""
    return F.lower(F.lpad(F.hex(F.floor(255 - 235 * F.coalesce(F.try_divide(value, most), F.lit(0.0))).cast("long")), 2, "0"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def blank_to(value: Column, kind: str, otherwise: float) -> Column:
    return F.coalesce(blank_to_null(value).cast(kind), F.lit(otherwise).cast(kind))


def null_to_text(value: Column, text: str = "NULL") -> Column:
    return F.coalesce(value.cast("string"), F.lit(text))
