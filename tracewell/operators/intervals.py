"""Existence joins between positions and intervals, without forming pairs.

"Is there an interval that starts before p and ends after it?" only needs the
furthest end among the intervals that start before p: a running maximum over
the union of both sides.  Work is one sort however many intervals overlap, and
long traces are spread over chunks of the position axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, chunk_of, lay_out_chunks, running


def furthest_end(
    queries: DataFrame,
    intervals: DataFrame,
    key: Sequence[str],
    at: str | Column,
    start: str | Column,
    end: str | Column,
    strict: bool,
    width: float = CHUNK,
    name: str = "reach",
) -> DataFrame:
    """For each query row the largest ``end`` among intervals with ``start < at``
    (``strict``) or ``start <= at``; null if there is none."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [c for c in queries.columns if c not in key]
    payload = F.struct(*columns) if columns else F.struct(F.lit(1).alias("_none"))
    # at equal positions a strict query must come before the intervals that start there
    asked = queries.select(
        *key, as_col(at).cast("double").alias("_p"), F.lit(0 if strict else 1).alias("_o"),
        F.lit(None).cast("double").alias("_e"), payload.alias("_row"),
    )
    given = (
        intervals.select(*key, as_col(start).cast("double").alias("_p"), as_col(end).cast("double").alias("_e"))
        .groupBy(*key, "_p").agg(F.max("_e").alias("_e"))  # equal starts: only the longest matters
        .select(*key, "_p", F.lit(1 if strict else 0).alias("_o"), "_e")
    )
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("_chunk", chunk_of("_p", width))
    reached = running(lay_out_chunks(both, key), key, "_chunk", ["_p", "_o"], {name: ("max", "_e")})
    kept = reached.where(F.col("_row").isNotNull())
    return kept.select(*key, *([f"_row.{c}" for c in columns]), name)


def label_overlap(
    windows: DataFrame, truth: DataFrame, key: Sequence[str], w0: str = "w0", w1: str = "w1",
    e0: str = "e0", e1: str = "e1", width: float = CHUNK,
) -> DataFrame:
    """``label`` 1 where the window [w0, w1) overlaps a truth interval: w0 < e1 and w1 > e0, both strict."""
    reached = furthest_end(windows, truth, key, w1, e0, e1, True, width, "_reach")
    label = F.when(F.col("_reach") > F.col(w0), 1).otherwise(0)
    return reached.withColumn("label", label).drop("_reach")


def _reach_of(detections_on: str, detections_off: str, tol: float) -> tuple[Column, Column]:
    """|t_on - t| <= tol or t_on <= t <= t_off, as one interval of t."""
    return F.col(detections_on) - tol, F.greatest(F.col(detections_on) + tol, F.col(detections_off))


def truths_found(
    detections: DataFrame, truth: DataFrame, key: Sequence[str], tol: float = 15.0,
    on: str = "t_on", off: str = "t_off", at: str = "t", width: float = CHUNK,
) -> DataFrame:
    """Truths with ``found``: some detection starts within ``tol`` of it or spans it."""
    low, high = _reach_of(on, off, tol)
    found = furthest_end(truth, detections, key, at, low, high, False, width, "_reach")
    return found.withColumn("found", F.coalesce(F.col("_reach") >= F.col(at), F.lit(False))).drop("_reach")


def detections_hit(
    detections: DataFrame, truth: DataFrame, key: Sequence[str], tol: float = 15.0,
    on: str = "t_on", off: str = "t_off", at: str = "t", width: float = CHUNK,
) -> DataFrame:
    """Detections with ``hit``: the latest truth at or before the high end of the
    detection is not before its low end."""
    low, high = _reach_of(on, off, tol)
    moments = truth.select(*key, F.col(at).alias("_s"), F.col(at).alias("_t"))
    hit = furthest_end(detections.withColumn("_high", high), moments, key, "_high", "_s", "_t", False, width, "_reach")
    return hit.withColumn("hit", F.coalesce(F.col("_reach") >= low, F.lit(False))).drop("_reach", "_high")


def match_detections(
    detections: DataFrame, truth: DataFrame, key: Sequence[str], tol: float = 15.0,
    on: str = "t_on", off: str = "t_off", at: str = "t", width: float = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Detections with ``hit`` and truths with ``found``."""
    args = (detections, truth, key, tol, on, off, at, width)
    return detections_hit(*args), truths_found(*args)
