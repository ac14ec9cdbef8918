"""Moving variance and the event time estimated from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, chunk_of, join_facts, spread_facts
from tracewell.operators.windows import assign_windows

RATIO_FLOOR = 1e-10  # fixed value added to the smallest variance
HALF_SECOND = 0.5  # fixed step, in seconds, that the estimate assumes


def moving_variance(samples: DataFrame, key: Sequence[str], n: int, value: str = "v", index: str = "i",
                    chunk: int = CHUNK) -> DataFrame:
    """Population variance of windows of n rows every max(1, n // 2) rows: (key, k, i_mid, var).

    Starts run up to but not including length - n, so the last full window that
    ends exactly with the trace is left out.
    """
    step = max(1, n // 2)
    rows = assign_windows(samples.select(*key, index, value), n, step, index)
    stats = rows.groupBy(*key, "k").agg(F.var_pop(value).alias("var"), F.count(F.lit(1)).alias("_n"))
    full = stats.where(F.col("_n") == n).withColumn("_chunk", chunk_of(F.col("k") * step, chunk))
    lengths = spread_facts(samples.groupBy(*key).agg((F.max(index) + 1).alias("_len")), "_len", chunk)
    inside = join_facts(full, lengths, [*key, "_chunk"], "inner").where(F.col("k") * step < F.col("_len") - n)
    return inside.select(*key, "k", (F.col("k") * step + n // 2).alias("i_mid"), "var")


def event_estimate(variances: DataFrame, key: Sequence[str], n: int | None = None, sr: float | None = None) -> DataFrame:
    """Smallest and largest moving variance, their ratio, and the time of the first maximum.

    The step counts as 0.5 s unless ``n`` and ``sr`` are given; then it is max(1, n // 2) / sr.
    """
    step_s = HALF_SECOND if n is None else max(1, n // 2) / sr
    facts = variances.groupBy(*key).agg(
        F.min("var").alias("var_min"), F.max("var").alias("var_max"),
        F.min_by("k", F.struct(F.negative(F.col("var")), F.col("k"))).alias("_k"),
    )
    return facts.select(
        *key, "var_min", "var_max", (F.col("var_max") / (F.col("var_min") + RATIO_FLOOR)).alias("razao_var"),
        F.round(F.col("_k") * step_s, 1).alias("t_evento_est"),
    )
