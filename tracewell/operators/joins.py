"""Joins of traces with metadata, file listings and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import attach_facts, spread_hot


def attach_station(traces: DataFrame, stations: DataFrame, on: Sequence[str] = ("net", "sta")) -> DataFrame:
    """Inner join by exact key.  Metadata is deduplicated, so no trace is doubled; a
    station with most of the rows is spread by salt."""
    return attach_facts(traces, stations.dropDuplicates(list(on)), on)


def without_station(traces: DataFrame, stations: DataFrame, on: Sequence[str] = ("net", "sta")) -> DataFrame:
    return traces.join(stations.select(*on).distinct(), list(on), "left_anti")


def attach_epoch(traces: DataFrame, epochs: DataFrame, on: Sequence[str], at: str = "t0", start: str = "start",
                 end: str = "end") -> DataFrame:
    """Metadata valid at the time of the trace: start <= t < end, open end allowed."""
    traces, epochs, on = spread_hot(traces, epochs, on)
    renamed = epochs.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in epochs.columns])
    condition = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_k_{c}"))
    return traces.join(renamed, condition, "inner").drop("_salt", *[f"_k_{c}" for c in on])


def attach_contains(
    names: DataFrame, stations: DataFrame, name: str, code: str, also: str | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """First station whose ``code`` (and ``also``) occurs in the file name.

    This over-matches by design; ``attach_station`` is the exact form.  Substrings
    of the names with the lengths that codes have become an equi-join key, so the
    plan holds no nested loop over names and stations.
    """
    stations = stations.where(F.length(code) > 0)
    lengths = stations.agg(F.array_sort(F.collect_set(F.length(code))).alias("_lens"))  # one row, one entry per length
    distinct = names.select(F.col(name).alias("_name")).distinct()
    cut = attach_facts(distinct, lengths, []).select("_name", F.explode("_lens").alias("_len"))
    cut = cut.where(F.length("_name") >= F.col("_len")).select(
        "_name", "_len", F.explode(F.sequence(F.lit(1), F.length("_name") - F.col("_len") + 1)).alias("_at")
    )
    cut = cut.select("_name", F.substr("_name", F.col("_at"), F.col("_len")).alias("_code")).distinct()
    columns = stations.columns
    # one row per code: its stations in order, so a code that all names have adds no pairs
    rank = F.struct(F.struct(*(order or [code])).alias("o"), F.struct(*columns).alias("s"))
    options = stations.groupBy(F.col(code).alias("_code")).agg(F.array_sort(F.collect_list(rank)).alias("_o"))
    hit = attach_facts(cut, options, ["_code"])
    if also:
        hit = hit.withColumn("_o", F.filter("_o", lambda e: F.contains(F.col("_name"), e["s"][also]))).where(F.size("_o") > 0)
    first = hit.groupBy("_name").agg(F.min(F.get("_o", F.lit(0))).alias("_s")).select("_name", F.col("_s.s").alias("_s"))
    matched = first.select(F.col("_name").alias(name), *[f"_s.{c}" for c in columns])
    return names.join(matched, name, "left")


def pattern_lookup(stations: DataFrame, files: DataFrame, patterns: Sequence[Column], name: str = "name") -> DataFrame:
    """File of each station by the first naming pattern that exists (``priority`` 0 first)."""
    options = F.array(*[F.struct(F.lit(p).alias("priority"), c.alias("want")) for p, c in enumerate(patterns)])
    wide = stations.withColumn("_o", F.explode(options)).select(*stations.columns, "_o.priority", "_o.want")
    hit = wide.join(files.select(F.col(name).alias("want")).distinct(), "want")
    best = hit.groupBy(*stations.columns).agg(F.min_by(F.struct("priority", "want"), "priority").alias("_b"))
    return best.select(*stations.columns, "_b.priority", F.col("_b.want").alias(name))


def attach_index(inventory: DataFrame, index: DataFrame, name: str, path: str, order: str) -> DataFrame:
    """Left join to a file index; when a name occurs twice the last path wins."""
    last = index.groupBy(name).agg(F.max_by(path, F.struct(order, path)).alias(path))
    return inventory.join(last, name, "left")


def coverage_gaps(stations: DataFrame, present: DataFrame, key: Sequence[str], day: str, first, last) -> DataFrame:
    """Days from ``first`` to ``last`` on which a station has no data."""
    wanted = stations.select(*key).distinct().withColumn(
        day, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    )
    return wanted.join(present.select(*key, day).distinct(), [*key, day], "left_anti")


def vector_magnitude(samples: DataFrame, on: Sequence[str], channel: str, codes: Sequence[str], value: str = "v") -> DataFrame:
    """Components aligned by time; rows with all of them get sqrt of the sum of squares.

    Of several samples of a component with one time the smallest value counts.
    """
    wide = samples.groupBy(*on).pivot(channel, list(codes)).agg(F.min(value))
    total = sum((F.col(f"`{c}`") * F.col(f"`{c}`") for c in codes[1:]), F.col(f"`{codes[0]}`") * F.col(f"`{codes[0]}`"))
    return wide.withColumn("magnitude", F.sqrt(total)).where(F.col("magnitude").isNotNull())
