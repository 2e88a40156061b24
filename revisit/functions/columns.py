"""Column helpers. All are JVM-side expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(_c(a), _c(b))


def nan_to_null(c) -> Column:
    """NaN -> NULL. Spark orders NaN above all numbers, pandas treats it as missing."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def floor_div(x, n: int) -> Column:
    """Integer floor division of a BIGINT by a positive constant, exact."""
    x = _c(x)
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("bigint")


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch (floor), as BIGINT."""
    return floor_div(epoch_micros(ts), 1_000_000)


def seconds_component(gap_seconds) -> Column:
    """The ``seconds`` field of a timedelta: whole seconds modulo one day.

    86,410 s gives 10 and -1 s gives 86,399, as a timedelta's day/second split.
    """
    return F.pmod(F.floor(_c(gap_seconds)), F.lit(86400))


def hex_prefix_int(s) -> Column:
    """First 8 hex digits of md5(s) as a BIGINT (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(_c(s).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_bucket(s, n: int) -> Column:
    """Deterministic bucket in [0, n) from the md5 prefix of ``s``."""
    return F.pmod(hex_prefix_int(s), F.lit(n))


def seconds_to_interval(seconds) -> Column:
    """Seconds (DOUBLE) as a day-time interval, for output like a timedelta."""
    s = _c(seconds)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
