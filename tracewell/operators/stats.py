"""Aggregates over traces, windows, errors and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import attach_facts, order_statistics, side_by_side
from tracewell.operators.select import top_k_per

MIN_FILES, MIN_WITH_METADATA, MIN_CLEAR = 20, 15, 10  # fixed readiness limits
FEW_WINDOWS, ENOUGH_WINDOWS = 50, 200  # fixed limits for the size message


def trace_stats(samples: DataFrame, key: Sequence[str], sr: float = 1.0, value: str = "v") -> DataFrame:
    return samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(float(sr))).alias("duration_s"),
        F.var_pop(value).alias("var"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def energy(samples: DataFrame, key: Sequence[str], value: str = "v") -> DataFrame:
    v = F.col(value)
    return samples.groupBy(*key).agg(
        F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("max_abs"), F.sum(v * v).alias("energy")
    )


def window_stats(windows: DataFrame, ids: Sequence[str], by: Sequence[str], x: str = "x", first: int = 100) -> DataFrame:
    """Per class: mean of window std, mean of window max |x|, and mean Pearson
    kurtosis (normal = 3) over the first ``first`` windows of the class."""
    rows = windows.select(*ids, *by, F.explode(F.col(x)).alias("_v")).withColumn("_v", F.col("_v").cast("double"))
    each = rows.groupBy(*ids, *by).agg(
        F.stddev_pop("_v").alias("_std"), F.max(F.abs("_v")).alias("_max"), (F.kurtosis("_v") + 3).alias("_kurt")
    )
    per_class = each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("_std").alias("mean_std"), F.avg("_max").alias("mean_max_abs")
    )
    # descending order of the negated id keeps the first ones
    head = top_k_per(each.withColumn("_neg", F.negative(F.col(ids[0]))), by, "_neg", first, ids)
    return per_class.join(head.groupBy(*by).agg(F.avg("_kurt").alias("mean_kurtosis")), list(by))


def mean_abs_waveform(windows: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    return windows.select(*by, F.posexplode(x).alias("pos", "_v")).groupBy(*by, "pos").agg(
        F.avg(F.abs(F.col("_v").cast("double"))).alias("mean_abs")
    )


def counts(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def counts_with_totals(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.cube(*by).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in cols])


def size_profile(df: DataFrame, size: str, by: Sequence[str] = ()) -> DataFrame:
    """min, upper median (element n // 2 of the sorted sizes), max and total."""
    key = list(by)
    median = order_statistics(df, key, size, {"median": 0.5}, rule="upper")
    facts = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("min"), F.max(size).alias("max"), F.sum(size).alias("total")
    )
    return side_by_side([facts, median], key)


def error_stats(errors: DataFrame, by: Sequence[str], value: str = "err") -> DataFrame:
    """count, mean, population std, median, P95 and P99 per class."""
    facts = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    return facts.join(order_statistics(errors, by, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}), list(by))


def class_ratio(errors: DataFrame, label: str = "label", value: str = "err") -> DataFrame:
    """Mean error of events divided by the mean error of noise."""
    event, noise = F.avg(F.when(F.col(label) == 1, F.col(value))), F.avg(F.when(F.col(label) == 0, F.col(value)))
    return errors.agg(event.alias("event_mean"), noise.alias("noise_mean")).withColumn(
        "ratio", F.col("event_mean") / F.nullif(F.col("noise_mean"), F.lit(0.0))
    )


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from the smallest to the largest value of each class, the
    last one closed; ``density`` = count / (n * width).  Empty bins have no row."""
    value = F.col(col).cast("double")
    values = df.select(*by, value.alias("_v")).where(F.col("_v").isNotNull())
    limits = values.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    # rows meet their limits where they are and are counted by bin before any exchange
    numbered = values.withColumn("_row", F.monotonically_increasing_id())
    counts = limits.select(*by, F.col("_n").alias("_rows"))
    joined = attach_facts(numbered, limits, list(by), counts=counts).withColumn("_w", width)
    at = F.when(F.col("_w") > 0, F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_w"), F.lit(0.0)))).otherwise(0)
    placed = joined.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    out = placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.min("_lo").alias("_lo"), F.min("_w").alias("_w"), F.min("_n").alias("_n")
    )
    return out.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), F.col("_w").alias("width"), "count",
        (F.col("count") / F.nullif(F.col("_n") * F.col("_w"), F.lit(0.0))).alias("density"),
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers: the last values within 1.5 IQR of the box."""
    quartiles = order_statistics(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    values = df.select(*by, F.col(col).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_row")).where("_v IS NOT NULL")
    joined = attach_facts(values, quartiles, list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v")))
    high = F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v")))
    outside = F.sum(F.when(F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach), 0).otherwise(1))
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        low.alias("whisker_low"), high.alias("whisker_high"), outside.alias("n_outside")
    )


def span(df: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """First start, last end and the seconds between them."""
    seconds = (F.unix_micros(F.max(F.col(end).cast("timestamp"))) - F.unix_micros(F.min(F.col(start).cast("timestamp")))) / 1e6
    return df.groupBy(*by).agg(F.min(start).alias("first"), F.max(end).alias("last"), seconds.alias("span_s"))


def readiness(inventory: DataFrame, available: str = "xml_disponivel", cls: str = "classificacao",
              clear: str = "evento_claro") -> DataFrame:
    """Are there enough files, files with metadata, and clear events?"""
    c = inventory.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.when(F.col(available), 1).otherwise(0)).alias("n_with_metadata"),
        F.sum(F.when(F.col(cls) == clear, 1).otherwise(0)).alias("n_clear"),
    )
    return c.select(
        "*", (F.col("n_files") >= MIN_FILES).alias("enough_files"),
        (F.col("n_with_metadata") >= MIN_WITH_METADATA).alias("enough_metadata"),
        (F.col("n_clear") >= MIN_CLEAR).alias("enough_events"),
    )


def window_supply(windows: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Is the number of windows of each class too small, small, or enough?"""
    c = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") < FEW_WINDOWS, "too_few").when(F.col("n") < ENOUGH_WINDOWS, "few").otherwise("enough")
    return c.withColumn("supply", level)


def overview(df: DataFrame, distinct: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row: row count, distinct counts, and min/mean/max of numbers."""
    parts = [F.count(F.lit(1)).alias("n_rows")]
    parts += [F.countDistinct(c).alias(f"n_{c}") for c in distinct]
    for c in numeric:
        parts += [F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*parts)


def throughput(runs: DataFrame, by: Sequence[str], ms: str = "ms", npts: str = "npts", sr: str = "sr",
               step_s: float = 5.0) -> DataFrame:
    """ms per second of signal, spread of the call times, and the real-time check."""
    return runs.groupBy(*by).agg(
        (F.sum(ms) / F.sum(F.col(npts) / F.col(sr))).alias("ms_per_s"), F.avg(ms).alias("mean_ms"),
        F.stddev_pop(ms).alias("std_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        (F.avg(ms) < step_s * 1000).alias("real_time"),
    )
