"""Column expressions shared by the operators.

Time arithmetic is done on TIMESTAMP_NTZ with ``timestampdiff`` so results do
not depend on the session time zone (Parquet timestamps of the inputs load as
NTZ).  Ratios use ``try_divide`` because ANSI mode raises on ``/0``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(col: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (zone free)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(col).cast("timestamp_ntz"))


def hours_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in fractional hours, as DOUBLE."""
    micros = F.timestamp_diff("MICROSECOND", _c(start).cast("timestamp_ntz"),
                              _c(end).cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(3_600_000_000.0)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole days from ``start`` to ``end`` (date parts, like DATE_DIFF('day'))."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def hash_fraction(keys: Sequence[str | Column], seed: int, buckets: int = 1000) -> Column:
    """Deterministic bucket in [0, buckets) from md5(key ':' seed).

    The first 8 hex digits of md5 give a 32-bit unsigned integer, so the
    split does not depend on partitioning or row order and is reproducible
    in any SQL engine that has md5.
    """
    parts = [_c(k).cast("string") for k in keys]
    text = F.concat_ws("|", *parts) if len(parts) > 1 else parts[0]
    h = F.md5(F.concat(text, F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def round_double(col: str | Column, digits: int = 6) -> Column:
    return F.round(_c(col).cast("double"), digits)


def lit_date(value: str) -> Column:
    return F.lit(value).cast("date")


def lit_ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def json_int(col: str | Column, field: str) -> Column:
    """Integer field of a small JSON object string, e.g. '{"k": 5}' (NULL if it is none)."""
    return F.get_json_object(_c(col), f"$.{field}").try_cast("bigint")


def trunc_ntz(col: str | Column, unit: str) -> Column:
    """Truncate a wall-clock timestamp to month / day / hour as TIMESTAMP_NTZ
    without passing through the session time zone."""
    c = _c(col).cast("timestamp_ntz")
    zero = F.lit(0)
    if unit == "month":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), zero, zero, zero)
    if unit == "day":
        return c.cast("date").cast("timestamp_ntz")
    if unit == "hour":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), zero, zero)
    raise ValueError(f"unsupported unit {unit}")


def wallclock_instant(col: str | Column) -> Column:
    """TIMESTAMP (instant) whose UTC reading equals the wall-clock value, for
    APIs that need TIMESTAMP (watermarks, window()).  Zone-free."""
    return F.timestamp_micros(epoch_us(col))


def instant_wallclock(col: str | Column) -> Column:
    """Inverse of :func:`wallclock_instant`: back to TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(col)),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
