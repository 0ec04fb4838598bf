"""Column functions on event times.  The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisor and largest bucket of the logarithmic time-gap scale.
GAP_LOG_STEP = 0.301
GAP_BUCKETS = 128


def epoch_seconds_rounded(ts: Column) -> Column:
    """Whole epoch seconds, the fraction rounded half to even."""
    micros = F.unix_micros(ts.cast("timestamp"))
    whole = F.floor(micros / F.lit(1_000_000.0)).cast("long")
    rest = micros - whole * 1_000_000
    up = (rest > 500_000) | ((rest == 500_000) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + up.cast("int")).cast("int")


def epoch_seconds_truncated(ts: Column) -> Column:
    """Whole epoch seconds, the fraction cut off toward zero."""
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)).cast("long").cast("int")


def decompose_time(epochs: Column) -> Column:
    """Epoch seconds -> array of [year, month, day, hour, minute, second] per element."""

    def fields(second: Column) -> Column:
        ts = F.timestamp_seconds(second)
        return F.array(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), F.second(ts))

    return F.transform(epochs, fields)


def time_gap_bucket(gap: Column) -> Column:
    """Logarithmic bucket of a gap in seconds, 0 .. GAP_BUCKETS."""
    scaled = F.log(F.greatest(F.abs(gap), F.lit(1)).cast("double")) / F.lit(GAP_LOG_STEP)
    return F.least(F.floor(scaled), F.lit(GAP_BUCKETS)).cast("int")
