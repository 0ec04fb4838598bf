"""Column functions on scores and metric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUNDERS = {"ceil": F.ceil, "floor": F.floor, "around": lambda c: F.bround(c, 0)}

# Fixed value: decimal places of a reported metric.
METRIC_PLACES = 5


def threshold_flag(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, F.lit(1)).otherwise(F.lit(0))


def round_scores(score: Column, method: str) -> Column:
    if method not in _ROUNDERS:
        raise NotImplementedError(f"no rounding method named {method!r}; choose from {sorted(_ROUNDERS)}")
    return _ROUNDERS[method](score).cast("double")


def round_metric(value: Column, places: int = METRIC_PLACES) -> Column:
    return F.round(value, places)
