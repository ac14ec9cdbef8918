"""Live features in event time.

All of them keep bounded state.  A window is emitted once, when the watermark passes
its end.  Late rows: the watermark is the latest event time minus the allowed delay;
a row of a closed window is dropped if the batch before its own had already moved the
watermark past that window.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the tables ``name*.parquet`` in a folder, each a file or a folder of part files, also of those that come later."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}*.parquet")


def stream_windows(sdf: DataFrame, key: Sequence[str], length: str, slide: str, watermark: str, value: str = "v",
                   ts: str = "ts") -> DataFrame:
    """Sliding statistics: n, mean, population variance, max |v| per key and window."""
    grouped = sdf.withWatermark(ts, watermark).groupBy(F.window(ts, length, slide).alias("w"), *key)
    stats = grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"),
        F.max(F.abs(F.col(value))).alias("max_abs"),
    )
    return stats.select(*key, F.col("w.start").alias("w0"), F.col("w.end").alias("w1"), "n", "mean", "var", "max_abs")


def stream_energy(sdf: DataFrame, key: Sequence[str], length: str, watermark: str, value: str = "v", ts: str = "ts") -> DataFrame:
    """Tumbling counts and RMS."""
    grouped = sdf.withWatermark(ts, watermark).groupBy(F.window(ts, length).alias("w"), *key)
    stats = grouped.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return stats.select(*key, F.col("w.start").alias("w0"), F.col("w.end").alias("w1"), "n", "rms")


def stream_sessions(sdf: DataFrame, key: Sequence[str], on: float, gap: str, watermark: str, value: str = "cf",
                    ts: str = "ts") -> DataFrame:
    """Events as sessions: rows above ``on`` less than ``gap`` apart belong together.

    Only rows above ``on`` move the watermark (a filter on the value always runs first).
    """
    loud = sdf.where(F.col(value) > on).withWatermark(ts, watermark)
    grouped = loud.groupBy(F.session_window(ts, gap).alias("w"), *key).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")
    )
    return grouped.select(*key, F.col("w.start").alias("t_on"), F.col("w.end").alias("t_off"), "n", "peak")


def stream_detect(sdf: DataFrame, model, thr: float, x: str = "x") -> DataFrame:
    """Score windows as they arrive; stateless, so it runs in any output mode."""
    return model.errors(sdf, x).withColumn("pred", F.when(F.col("err") > thr, 1).otherwise(0))


def run_to_table(sdf: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything that is available now into parquet and return the written rows."""
    spark = sdf.sparkSession
    base = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{base}/rows")
