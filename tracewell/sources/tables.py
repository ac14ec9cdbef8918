"""Samples, inventories, windows, scores and records as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tracewell import schemas


def read_samples(spark: SparkSession, path: str, schema: T.StructType = schemas.SAMPLES, fmt: str = "parquet",
                 suffix: str | None = None, channel: str = "cha") -> DataFrame:
    """Long samples from parquet or CSV; the channel filter reaches the scan."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df if suffix is None else df.where(F.col(channel).endswith(suffix))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INVENTORY).csv(path, header=True)


def read_trigger_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIGGER_RESULTS).csv(path, header=True)


def read_records(spark: SparkSession, path: str, schema: T.StructType = schemas.RESULT_RECORD) -> DataFrame:
    """Result records, one JSON document per file, possibly over many lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_windows(spark: SparkSession, path: str, split: str | None = None, fallback: str | None = None) -> DataFrame:
    """Windows written by ``write_windows``; one split reads only its own folder.

    ``fallback`` is read when the first path has no table.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        if fallback is None:
            raise
        df = spark.read.parquet(fallback)
    df = df.withColumn("x", F.col("x").cast("array<float>"))
    return df if split is None else df.where(F.col("split") == split)


def write_windows(windows: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> DataFrame:
    """Write by split, then read back the counts per split and window length."""
    windows.write.mode(mode).partitionBy(split).parquet(path)
    back = windows.sparkSession.read.parquet(path)
    return back.groupBy(split, F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines; nulls are written out so that every record has the same fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_scores(scores: DataFrame, metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scores as parquet, metrics as JSON next to them."""
    scores.write.mode(mode).parquet(f"{path}/scores")
    write_json(metrics, f"{path}/metrics", mode)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)
