"""Detections against a catalogue that comes in later: an interval join of two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_matches(
    detections: DataFrame, truth: DataFrame, key: Sequence[str], tol: float = 15.0, longest: float = 3600.0,
    delay: str = "10 minutes", truth_delay: str = "1 hour", on: str = "t_on", off: str = "t_off", at: str = "t",
) -> DataFrame:
    """Every detection with each event it meets (``at``), or once with a null event when none can come any more.

    A detection meets an event within ``tol`` seconds of its start or between start and
    end.  All times are timestamps.  A row is kept in state until the watermark of the
    other side has passed all it could meet, so state is bounded by rate, delays, ``tol``
    and ``longest``.  Events later than ``longest`` seconds after the start aren't met:
    it must be at least the length of any detection.  Rows behind their watermark may be
    dropped.  A null key or time meets nothing; a null end counts as the start.
    """
    left = detections.withWatermark(on, delay).alias("d")
    right = truth.select(*[F.col(k).alias(f"_{k}") for k in key], at).withWatermark(at, truth_delay).alias("e")
    start, moment = F.col(f"d.{on}"), F.col(f"e.{at}")
    before, after = F.expr(f"INTERVAL {tol} SECONDS"), F.expr(f"INTERVAL {max(tol, longest)} SECONDS")
    near = (moment >= start - before) & (moment <= start + after)
    meets = (moment <= start + before) | (moment <= F.col(f"d.{off}"))
    for k in key:
        near &= F.col(f"d.{k}") == F.col(f"e._{k}")
    return left.join(right, near & meets, "left_outer").drop(*[f"_{k}" for k in key])
