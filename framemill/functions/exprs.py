"""Column helpers: little-endian bytes, shifts and the roundings of the image operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, offset: int | Column) -> Column:
    """The unsigned byte of a binary column at a 0-based offset; null beyond its end."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.nullif(F.hex(F.substring(data, at, F.lit(1))), F.lit("")), 16, 10).cast("bigint")


def u32_at(data: Column, offset: int) -> Column:
    """The little-endian 32-bit integer at a 0-based offset."""
    h = F.hex(F.substring(data, offset + 1, 4))
    turned = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.when(F.length(h) == 8, F.conv(turned, 16, 10).cast("bigint"))


def le_bytes(value: Column, size: int) -> Column:
    """value as size little-endian bytes."""
    h = F.lpad(F.hex(value.cast("bigint")), size * 2, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1)]))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("bigint")


def div(a: Column, b: int) -> Column:
    """Integer quotient of non-negative integers."""
    return F.floor(a / b).cast("int")


def format_datetime(at: Column) -> Column:
    """A time as the containers write it, in the session's time zone."""
    return F.date_format(at, "yyyy:MM:dd HH:mm:ss")
