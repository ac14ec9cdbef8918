"""Event catalogues in whitespace-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_TOKENS = 11
MAG_MIN = 2.5


def parse_catalog(lines: DataFrame, mag_min: float = MAG_MIN, line: str = "value") -> DataFrame:
    """One row per data line with its fields and ``status``: ok, few_tokens, bad_number,
    low_magnitude or bad_date, tested in that order.  Comments and blanks are left out."""
    text = F.trim(F.regexp_replace(F.col(line), r"\s+", " "))
    rows = lines.select(text.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    t = F.split("line", " ")
    token = lambda j: F.get(F.col("_t"), F.lit(j))
    number = lambda j: F.expr(f"try_cast(get(_t, {j}) AS double)")
    rows = rows.withColumn("_t", t).select(
        "line", F.size("_t").alias("_n"), number(4).alias("mag"), number(6).alias("lat"), number(7).alias("lon"),
        number(8).alias("depth"), token(10).alias("evid"),
        F.try_to_timestamp(F.concat_ws(" ", token(0), F.substring(token(1), 1, 8)), F.lit("yyyy/M/d H:m:s")).alias("datetime"),
    )
    missing = F.col("mag").isNull() | F.col("lat").isNull() | F.col("lon").isNull() | F.col("depth").isNull()
    status = (
        F.when(F.col("_n") < MIN_TOKENS, "few_tokens").when(missing, "bad_number")
        .when(F.col("mag") < mag_min, "low_magnitude").when(F.col("datetime").isNull(), "bad_date").otherwise("ok")
    )
    return rows.withColumn("status", status).withColumns({"ano": F.year("datetime"), "doy": F.dayofyear("datetime")}).drop("_n")


def read_catalog(spark: SparkSession, path: str, mag_min: float = MAG_MIN) -> tuple[DataFrame, DataFrame]:
    """Events and rejected lines (with their status)."""
    parsed = parse_catalog(spark.read.text(path), mag_min)
    events = parsed.where("status = 'ok'").select("evid", "ano", "doy", "datetime", "mag", "lat", "lon", "depth")
    return events, parsed.where("status <> 'ok'").select("line", "status")
