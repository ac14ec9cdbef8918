"""Cutting traces into fixed-length windows, normalising and labelling them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, attach_trace_facts


def window_length(seconds: float, sr: float) -> int:
    return int(seconds * sr)


def window_step(n: int, overlap: float, percent: bool = False) -> int:
    """Step for an overlap given as a fraction, or as a percentage."""
    return int(n * (1 - (overlap / 100 if percent else overlap)))


def make_windows(traces: DataFrame, n: int, step: int, data: str = "data") -> DataFrame:
    """Array form: one row per trace in, one row per full window out (k, x)."""
    rest = [c for c in traces.columns if c != data]
    starts = F.sequence(F.lit(0), F.size(data) - n, F.lit(step))
    cut = F.transform(starts, lambda s: F.slice(F.col(data), s + 1, n))
    return traces.where(F.size(data) >= n).select(*rest, F.posexplode(cut).alias("k", "x"))


def assign_windows(samples: DataFrame, n: int, step: int, index: str = "i") -> DataFrame:
    """Long form: every sample once per window it belongs to (k, pos).

    Windows that run past the end of the trace are still incomplete here; they
    are the ones with fewer than n rows.
    """
    i = F.col(index)
    first = F.greatest(F.ceil((i - n + 1) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.floor(i / F.lit(step)).cast("bigint")
    inside = samples if step <= n else samples.where(first <= last)
    return inside.withColumn("k", F.explode(F.sequence(first, last))).withColumn("pos", (i - F.col("k") * step).cast("int"))


def collect_windows(samples: DataFrame, key: Sequence[str], n: int, step: int, value: str = "v", index: str = "i") -> DataFrame:
    """Windows as arrays from long samples.  Groups are windows, so they never
    exceed n rows however long the trace is."""
    rows = assign_windows(samples.select(*key, index, value), n, step, index)
    grouped = rows.groupBy(*key, "k").agg(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v"))).alias("_x"))
    full = grouped.where(F.size("_x") == n)
    return full.select(*key, "k", F.transform(F.array_sort("_x"), lambda e: e["v"]).alias("x"))


def central_window(traces: DataFrame, n: int, data: str = "data") -> DataFrame:
    """``x``: n values around the middle of the trace; null for a shorter trace."""
    size = F.size(data)
    start = F.floor(size / F.lit(2)).cast("int") - n // 2 + 1
    return traces.withColumn("x", F.when(size >= n, F.slice(F.col(data), F.greatest(start, F.lit(1)), n)))


def central_samples(samples: DataFrame, key: Sequence[str], n: int, index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """The central window from long samples: rows with ``pos`` 0 .. n-1, long enough traces only."""
    lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len")).where(F.col("_len") >= n)
    first = F.floor(F.col("_len") / F.lit(2)).cast("bigint") - n // 2
    joined = attach_trace_facts(samples, lengths, key, "_len", index, chunk)
    placed = joined.withColumn("pos", (F.col(index) - first).cast("int"))
    return placed.where(F.col("pos").between(0, n - 1)).drop("_chunk", "_len")


def pad_crop(traces: DataFrame, n: int, data: str = "data") -> DataFrame:
    """``x``: the first n values, zeros added at the end of a shorter trace."""
    return traces.withColumn("x", F.slice(F.concat(F.col(data), F.array_repeat(F.lit(0.0), n)), 1, n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The optimizer copies an expression into the lambda that uses it, where it would
    be computed again for every element; a lambda parameter is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a finished column in front of a Python function.

    A one-element explode is a step of its own, so the optimizer neither moves the
    expression into the function call nor computes it twice.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def evaluated(df: DataFrame, name: str, udf: Callable[[str], Column], value: Column) -> DataFrame:
    """``df`` with ``udf(value)``, called once for a row.

    The result is pinned too: a filter on it, and the one that Spark adds before an
    array is exploded, would otherwise call the function again, in workers of its own.
    """
    called = pinned(df, "_in", value).withColumn("_out", udf("_in"))
    return pinned(called, name, F.col("_out")).drop("_in", "_out")


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)


def array_mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def array_std(x: Column) -> Column:
    """Population standard deviation of an array, two passes."""
    return let(array_mean(x), lambda m: F.sqrt(array_sum(F.transform(x, lambda e: (e - m) * (e - m))) / F.size(x)))


def zscore(windows: DataFrame, eps: float = 1e-12, flat: str = "drop", x: str = "x") -> DataFrame:
    """(x - mean) / std inside each window; ``flat`` windows (std <= eps) are
    dropped, kept as they are, or set to zeros."""
    if flat not in ("drop", "keep", "zero"):
        raise ValueError("flat must be drop, keep or zero")

    def scaled(v: Column) -> Column:
        steady = {"drop": F.lit(None).cast("array<double>"), "keep": v, "zero": F.transform(v, lambda e: F.lit(0.0))}[flat]
        return let(
            F.struct(array_mean(v).alias("m"), array_std(v).alias("s")),
            lambda f: F.when(f["s"] <= eps, steady).otherwise(F.transform(v, lambda e: (e - f["m"]) / f["s"])),
        )

    out = windows.withColumn(x, let(F.col(x).cast("array<double>"), scaled))
    return out.where(F.col(x).isNotNull()) if flat == "drop" else out


def zscore_trace(samples: DataFrame, key: Sequence[str], eps: float = 1e-6, flat: str = "zero",
                 value: str = "v", index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """(v - mean) / std over the whole trace, as ``z``; ``flat`` as in ``zscore``."""
    facts = samples.groupBy(*key).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), (F.max(index) + 1).alias("_len")
    )
    if flat == "drop":
        facts = facts.where(F.col("_std") >= eps)
    joined = attach_trace_facts(samples, facts, key, "_len", index, chunk)
    scaled = (F.col(value) - F.col("_mean")) / F.col("_std")
    if flat != "drop":
        scaled = F.when(F.col("_std") < eps, F.lit(0.0) if flat == "zero" else F.col(value)).otherwise(scaled)
    return joined.withColumn("z", scaled).drop("_mean", "_std", "_len", "_chunk")


def split_noise_event(windows: DataFrame, t_ref: str | Column, sr: float, n: int, step: int,
                      margin: float = 3.0, lead: float = 2.0) -> DataFrame:
    """``tipo`` noise when the window ends at or before t_ref - margin, event when it
    starts at or after t_ref - lead; windows in between are dropped."""
    t = F.col(t_ref) if isinstance(t_ref, str) else t_ref
    start, end = F.col("k") * step, F.col("k") * step + n
    tipo = F.when(end <= ((t - margin) * sr).cast("bigint"), "noise").when(start >= ((t - lead) * sr).cast("bigint"), "event")
    return windows.withColumn("tipo", tipo).where(F.col("tipo").isNotNull())


def label_source(df: DataFrame, value: int) -> DataFrame:
    return df.withColumn("label", F.lit(value).cast("tinyint"))


def count_by_length(lengths: DataFrame, grid: Sequence[tuple[int, int]], length: str = "n") -> DataFrame:
    """Number of full windows per trace for each (window, step) of a fixed grid."""
    points = F.array(*[F.struct(F.lit(n).alias("win"), F.lit(s).alias("step")) for n, s in grid])
    wide = lengths.withColumn("_g", F.explode(points))
    full = F.floor((F.col(length) - F.col("_g.win")) / F.col("_g.step")) + 1
    return wide.select(
        *lengths.columns, F.col("_g.win").alias("win"), F.col("_g.step").alias("step"),
        F.when(F.col(length) >= F.col("_g.win"), full).otherwise(0).cast("bigint").alias("n_windows"),
    )


def noise_window_estimate(t: Column, margin: float, sr: float, n: int, step: int) -> Column:
    """Noise windows expected before an event; truncation toward zero as in the formula's int()."""
    quotient = (F.greatest(F.lit(0.0), t - margin) * sr - n) / F.lit(float(step))
    return F.greatest(F.lit(0), quotient.cast("bigint") + 1)
