"""Short-term / long-term average ratios and the triggers built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordered import (
    CHUNK,
    attach_trace_facts,
    chunk_of,
    chunk_window,
    join_facts,
    lay_out_chunks,
    moving_sums,
    running,
    with_halo,
)
from tracewell.operators.recurrence import exponential_means, pack, scan, unpack

MODES = ("causal", "manual", "classic", "centred", "delayed", "recursive", "zdetect", "carl")
CENTRED_FLOOR = 1e-10  # fixed value added to the long average in centred mode


def _centred(n: int) -> tuple[int, int]:
    half = (n - 1) // 2
    return half - (n - 1), half


def sta_lta(
    samples: DataFrame,
    key: Sequence[str],
    n_sta: int,
    n_lta: int,
    mode: str = "causal",
    floor: float = 1e-20,
    value: str = "v",
    index: str = "i",
    ratio: float = 0.8,
    quiet: float = 0.8,
    chunk: int = CHUNK,
    keep_chunk: bool = False,
) -> DataFrame:
    """Characteristic function ``cf`` per sample (key, i, v, cf).

    ``causal``   trailing means divided by the full length during warm-up; 0 where lta <= floor
    ``manual``   means over the rows before the current one; 0 until n_lta rows are behind
    ``classic``  trailing means including the current row; 0 until the long one is full
    ``centred``  kernel centred on the row, long mean + 1e-10; first n_lta rows 0; a trace
                 shorter than n_lta gives no rows
    ``delayed``  the long window ends where the short one starts
    ``recursive`` exponential means, by an exact scan over chunks; null values count as 0
    ``zdetect``  short mean standardised over the trace
    ``carl``     star - ratio * ltar - |sta - lta| - quiet on the signal itself
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "zdetect":
        return _z_detector(samples, key, n_sta, value, index, chunk)
    if mode == "carl":
        return _carl(samples, key, n_sta, n_lta, value, index, ratio, quiet, chunk)
    if mode == "recursive":
        means = _recursive_means(samples, key, n_sta, n_lta, value, index, chunk)
        cf = F.when((F.col(index) >= n_lta) & (F.col("_lta") > 0), F.col("_sta") / F.col("_lta")).otherwise(0.0)
        return means.select(*key, *(["_chunk"] if keep_chunk else []), index, value, cf.alias("cf"))
    if mode == "centred":
        n_sta = max(1, n_sta)
        n_lta = max(n_sta + 1, n_lta)
    frames = {
        "causal": {"_sta": (1 - n_sta, 0), "_lta": (1 - n_lta, 0)},
        "manual": {"_sta": (-n_sta, -1), "_lta": (-n_lta, -1)},
        "classic": {"_sta": (1 - n_sta, 0), "_lta": (1 - n_lta, 0)},
        "centred": {"_sta": _centred(n_sta), "_lta": _centred(n_lta)},
        "delayed": {"_sta": (1 - n_sta, 0), "_lta": (1 - n_sta - n_lta, -n_sta)},
    }[mode]
    back = max(-lo for lo, _ in frames.values())
    ahead = max(0, *(hi for _, hi in frames.values()))

    chunked = with_halo(samples.select(*key, index, value), index, back, ahead, chunk)
    energy = lay_out_chunks(chunked, key).withColumn("_e", F.col(value).cast("double") * F.col(value))
    w = chunk_window(key, index)
    means = moving_sums(energy, w, "_e", frames)
    means = means.withColumns({"_sta": F.col("_sta") / n_sta, "_lta": F.col("_lta") / n_lta})

    sta, lta, i = F.col("_sta"), F.col("_lta"), F.col(index)
    guarded = F.when(lta > floor, sta / lta).otherwise(0.0)
    positive = F.when(lta > 0, sta / lta).otherwise(0.0)
    cf = {
        "causal": guarded,
        "manual": F.when(i >= n_lta, positive).otherwise(0.0),
        "classic": F.when(i >= n_lta - 1, positive).otherwise(0.0),
        "centred": F.when(i < n_lta, 0.0).otherwise(sta / (lta + CENTRED_FLOOR)),
        "delayed": F.when(i >= n_sta + n_lta - 1, positive).otherwise(0.0),
    }[mode]
    out = means.where("_own").select(*key, *(["_chunk"] if keep_chunk else []), index, value, cf.alias("cf"))
    if mode == "centred":
        long_enough = samples.where(i == n_lta - 1).select(*key).distinct()
        lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len")).join(long_enough, list(key), "left_semi")
        out = attach_trace_facts(out, lengths, key, "_len", index, chunk).drop("_len", *([] if keep_chunk else ["_chunk"]))
    return out


def _recursive_means(samples, key, n_sta, n_lta, value, index, chunk):
    """(key, _chunk, i, v, _sta, _lta): exponential means of the energy with weights (1/n)(1-1/n)^age."""
    packed = scan(pack(samples, key, value, index, chunk), key, exponential_means(n_sta, n_lta), feed=np.square)
    every = lambda k: f"transform(_v, (v, j) -> _y[2 * j + {k}])"
    return unpack(packed, key, {value: "_v", "_sta": every(0), "_lta": every(1)}, index, chunk)


def _z_detector(samples, key, n_sta, value, index, chunk):
    chunked = lay_out_chunks(with_halo(samples.select(*key, index, value), index, n_sta - 1, 0, chunk), key)
    energy = chunked.withColumn("_e", F.col(value).cast("double") * F.col(value))
    sta = moving_sums(energy, chunk_window(key, index), "_e", {"_sta": (1 - n_sta, 0)}).where("_own")
    sta = sta.withColumn("_sta", F.col("_sta") / n_sta)
    facts = sta.groupBy(*key).agg(
        F.avg("_sta").alias("_mean"), F.stddev_pop("_sta").alias("_std"), (F.max(index) + 1).alias("_len")
    )
    joined = attach_trace_facts(sta, facts, key, "_len", index, chunk)
    cf = F.when(F.col("_std") > 0, (F.col("_sta") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return joined.select(*key, index, value, cf.alias("cf"))


def _carl(samples, key, n_sta, n_lta, value, index, ratio, quiet, chunk):
    # the deviation |v - lta| is itself averaged over n_lta rows, so the halo is two windows deep
    chunked = lay_out_chunks(with_halo(samples.select(*key, index, value), index, 2 * n_lta, 0, chunk), key)
    w = chunk_window(key, index)
    means = moving_sums(chunked, w, value, {"_sta": (1 - n_sta, 0), "_lta": (1 - n_lta, 0)})
    means = means.withColumns({"_sta": F.col("_sta") / n_sta, "_lta": F.col("_lta") / n_lta})
    means = means.withColumn("_dev", F.abs(F.col(value) - F.col("_lta")))
    means = moving_sums(means, w, "_dev", {"_star": (1 - n_sta, 0), "_ltar": (1 - n_lta, 0)})
    eta = F.col("_star") / n_sta - ratio * F.col("_ltar") / n_lta - F.abs(F.col("_sta") - F.col("_lta")) - quiet
    cf = F.when(F.col(index) < n_lta, -1.0).otherwise(eta)
    return means.where("_own").select(*key, index, value, cf.alias("cf"))


def trigger(
    cf: DataFrame,
    key: Sequence[str],
    on: float | Column,
    off: float | Column,
    min_n: int = 0,
    inclusive: bool = False,
    close_open: bool = True,
    index: str = "i",
    chunk: int = CHUNK,
) -> DataFrame:
    """Hysteresis trigger: one row (key, on_i, off_i) per stretch that goes above
    ``on`` and then below ``off``.  A stretch still on at the end of the trace is
    closed at its length, or dropped with ``close_open=False``.

    Inside a chunk only the rows where the mark (on/off) changes go on, with the
    last row of the chunk; chunks then exchange one summary row each, so no task
    sees a whole trace.  A ``_chunk`` column from ``sta_lta(keep_chunk=True)``
    saves the shuffle into chunks.
    """
    value = F.col("cf")
    above, below = (value >= on, value <= off) if inclusive else (value > on, value < off)
    if not isinstance(on, Column) and not isinstance(off, Column) and (on < off or (inclusive and on == off)):
        raise ValueError("on must not be below off (and not equal to it when inclusive)")
    where = F.col("_chunk") if "_chunk" in cf.columns else chunk_of(index, chunk)
    marks = cf.select(*key, where.alias("_chunk"), F.col(index).alias("_i"), F.when(above, 1).when(below, 0).alias("_mark"))
    inside = Window.partitionBy(*key, "_chunk").orderBy("_i")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = marks.withColumns({
        "_prev": F.last("_mark", ignorenulls=True).over(so_far), "_tail": F.lead("_i").over(inside).isNull()
    })
    changed = F.col("_mark").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != F.col("_mark")))
    # few rows are left; this shuffle of them is shared by the summary and the pairing, so
    # the ratio is computed once (a repartition in the samples' own layout would be dropped)
    edges = marked.withColumn("_edge", changed).where("_edge OR _tail").repartition("_chunk", *key)
    return events_from_edges(edges, key, min_n, close_open)


def events_from_edges(edges: DataFrame, key: Sequence[str], min_n: int = 0, close_open: bool = True) -> DataFrame:
    """(key, on_i, off_i) from the rows of each chunk where the mark changes, and its last row.

    ``edges``: key, _chunk, _i, _mark (1 on, 0 off), _prev (the mark before it in
    the chunk), _edge (false for a last row without a change).
    """
    inside = Window.partitionBy(*key, "_chunk").orderBy("_i")
    summary = edges.groupBy(*key, "_chunk").agg(
        F.max_by("_mark", F.when(F.col("_edge"), F.col("_i"))).alias("_last"),
        F.min(F.when(F.col("_edge") & (F.col("_mark") == 0), F.col("_i"))).alias("_first_off"),
        (F.max("_i") + 1).alias("_end"),
    )
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    off_later = F.last("_first_off", ignorenulls=True).over(later)
    carry = summary.select(
        *key,
        "_chunk",
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        (F.coalesce(off_later, F.max("_end").over(Window.partitionBy(*key))) if close_open else off_later).alias("_off_later"),
    )
    paired = edges.where("_edge").withColumn("_next", F.lead("_i").over(inside)).where("_mark = 1")
    started = join_facts(paired, carry, [*key, "_chunk"], "left").where(
        F.col("_prev").isNotNull() | F.col("_before").isNull() | (F.col("_before") == 0)
    )
    found = started.select(*key, F.col("_i").alias("on_i"), F.coalesce("_next", "_off_later").alias("off_i"))
    return found.where(F.col("off_i").isNotNull() & (F.col("off_i") - F.col("on_i") >= min_n))


def to_seconds(detections: DataFrame, sr: float) -> DataFrame:
    """Detections with ``t_on`` and ``t_off`` in seconds from the start of the trace."""
    return detections.withColumns({"t_on": F.col("on_i") / sr, "t_off": F.col("off_i") / sr})


def extend_merge(
    detections: DataFrame, key: Sequence[str], pre: int, post: int, chunk: int = CHUNK
) -> DataFrame:
    """Lengthen each detection by ``pre`` before and ``post`` after, then merge
    those that overlap or touch."""
    wide = detections.select(
        *key, F.greatest(F.col("on_i") - pre, F.lit(0)).alias("on_i"), (F.col("off_i") + post).alias("off_i")
    )
    # equal starts: only the longest matters
    wide = wide.groupBy(*key, "on_i").agg(F.max("off_i").alias("off_i")).withColumn("_chunk", chunk_of("on_i", chunk))
    wide = lay_out_chunks(wide, key)
    marked = running(wide, key, "_chunk", ["on_i"], {"_prev": ("max", "off_i")}, exclusive=True)
    starts = marked.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_prev") < F.col("on_i")), F.col("on_i")))
    starts = lay_out_chunks(starts.select(*key, "_chunk", "on_i", "off_i", "_start"), key)
    islands = running(starts, key, "_chunk", ["on_i"], {"_island": ("last", "_start")})
    return islands.groupBy(*key, F.col("_island").alias("on_i")).agg(F.max("off_i").alias("off_i"))


def coincidence(
    detections: DataFrame, key: Sequence[str], channel: str, at_least: int, chunk: int = CHUNK
) -> DataFrame:
    """Stretches where at least ``at_least`` channels of a station are on together."""
    steps = detections.select(
        *key, channel, F.explode(F.array(F.struct(F.col("on_i").alias("p"), F.lit(1).alias("d")),
                                         F.struct(F.col("off_i").alias("p"), F.lit(-1).alias("d")))).alias("_s")
    ).select(*key, channel, F.col("_s.p").alias("i"), F.col("_s.d").alias("_d"))
    # net change per position first, so that the running count sees each position once
    net = steps.groupBy(*key, "i").agg(F.sum("_d").alias("_d")).where("_d <> 0").withColumn("_chunk", chunk_of("i", chunk))
    counts = running(lay_out_chunks(net, key), key, "_chunk", ["i"], {"_on": ("sum", "_d")})
    cf = counts.select(*key, "i", F.col("_on").cast("double").alias("cf"))
    return trigger(cf, key, at_least - 0.5, at_least - 0.5, chunk=chunk)


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are set; null for a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def autocorrelation(samples: DataFrame, key: Sequence[str], lags: Sequence[int], value: str = "v", index: str = "i",
                    chunk: int = CHUNK) -> DataFrame:
    """Pearson correlation of the trace with itself ``lag`` rows earlier."""
    chunked = lay_out_chunks(with_halo(samples.select(*key, index, value), index, max(lags), 0, chunk), key)
    w = chunk_window(key, index)
    wide = chunked.withColumns({f"_l{k}": F.lag(value, k).over(w) for k in lags}).where("_own")
    rows = wide.groupBy(*key).agg(*[_correlation(value, f"_l{k}").alias(f"_c{k}") for k in lags])
    return rows.select(
        *key, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("r")) for k in lags])).alias("_r")
    ).select(*key, "_r.lag", "_r.r")
