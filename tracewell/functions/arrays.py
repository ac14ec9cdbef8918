"""Whole-array functions, all inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.operators.windows import array_mean, array_std, let


def moments(x: Column) -> dict[str, Column]:
    return {"mean": array_mean(x), "std": array_std(x), "max": F.array_max(x), "min": F.array_min(x)}


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def argmax(x: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(x, F.array_max(x)) - 1


def argsort(x: Column) -> Column:
    """0-based positions in ascending order of value, ties by position."""
    pairs = F.transform(x, lambda e, j: F.struct(e.alias("e"), j.alias("j")))
    return F.transform(F.array_sort(pairs), lambda p: p["j"])


def percentile_of(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    at = F.lit(float(q)) * (F.size(x) - 1)
    low = F.floor(at).cast("int")

    def between(ordered: Column) -> Column:
        a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
        return a + (b - a) * (at - low)

    return let(F.array_sort(x), between)


def pad_to(x: Column, n: int) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def clip_to(x: Column, low: float, high: float) -> Column:
    return F.transform(x, lambda e: F.greatest(F.lit(low), F.least(F.lit(high), e)))


def mask_by(x: Column, keep: Column) -> Column:
    """Elements of x whose partner in the boolean array ``keep`` is true."""
    pairs = F.arrays_zip(x.alias("e"), keep.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["e"])
