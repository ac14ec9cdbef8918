"""Numbers with guards."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibel(power: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(power + F.lit(floor))


def truncate(x: Column) -> Column:
    """Toward zero."""
    return x.cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def guarded_ratio(a: Column, b: Column, floor: float = 0.0) -> Column:
    """a / b, and 0 where b is not above the floor."""
    return F.when(b > floor, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)
