"""Two-sample Kolmogorov-Smirnov drift between a reference and a current sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import ranged, running

SERIES_TERMS = 100
ALPHA = 0.05


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value: 2 * sum of (-1)^(j-1) exp(-2 j^2 x^2) with x = d sqrt(nm / (n + m))."""
    x = d * F.sqrt(n * m / (n + m).cast("double"))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    series = 2 * F.aggregate(terms, F.lit(0.0), lambda a, e: a + e)
    # the series converges slowly near 0, where p is 1 to double precision
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_two_sample(ref: DataFrame, cur: DataFrame, value: str = "err", alpha: float = ALPHA) -> DataFrame:
    """One row: largest distance ``d`` between the two distributions, ``p``, and ``drift``."""
    both = ref.select(F.col(value).alias("_v"), F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        cur.select(F.col(value).alias("_v"), F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    )
    summed = both.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    counted = running(
        ranged(summed, [], ["_v"]).drop("_mid"), [], "_part", ["_v"],
        {"_fr": ("sum", "_r"), "_fc": ("sum", "_c"), "_n": ("total", "_r"), "_m": ("total", "_c")},
    )
    d = counted.agg(
        F.max(F.abs(F.col("_fr") / F.col("_n") - F.col("_fc") / F.col("_m"))).alias("d"),
        F.max("_n").alias("n_ref"), F.max("_m").alias("n_cur"),
    )
    out = d.withColumn("p", kolmogorov_p(F.col("d"), F.col("n_ref"), F.col("n_cur")))
    return out.withColumn("drift", F.col("p") < alpha)
