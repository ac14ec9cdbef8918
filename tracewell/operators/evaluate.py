"""Scores, thresholds and detection quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import (
    CHUNK,
    DIRECT_FRAME,
    chunk_of,
    chunk_window,
    join_facts,
    lay_out_chunks,
    moving_sums,
    order_statistics,
    ranged,
    running,
    side_by_side,
    spread_facts,
    with_halo,
)
from tracewell.operators.select import argmax_row
from tracewell.operators.trigger import events_from_edges, to_seconds
from tracewell.operators.windows import let
from tracewell.session import cut_lineage

NORM_FLOOR = 1e-10  # fixed value added to the normalising percentile
TOLERANCE_S = 15.0
GUARD_ROWS = 20  # rows by which the event zone is widened for the noise score
# fixed one-at-a-time sweep around STA 1 s, LTA 10 s, threshold 3
SWEEP_STA = (0.5, 1.0, 2.0, 3.0, 5.0)
SWEEP_LTA = (5.0, 10.0, 15.0, 20.0, 30.0)
SWEEP_ON = (1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def curve(scores: DataFrame, key: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Counts at each distinct threshold (score >= thr): tp, fp, with totals pos and neg.

    Rows are first summed per distinct score, then counted from the highest score
    down over range partitions; no task sees the whole list.
    """
    summed = scores.where(F.col(score).isNotNull()).groupBy(*key, F.col(score).alias("thr")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    laid_out = ranged(summed, key, ["thr"]).drop("_mid")
    counted = running(
        laid_out, key, "_part", ["thr"],
        {"tp": ("sum", "_p"), "_m": ("sum", "_n"), "pos": ("total", "_p"), "_all": ("total", "_n")}, descending=True,
    )
    return counted.select(
        *key, "thr", "tp", (F.col("_m") - F.col("tp")).alias("fp"), "pos", (F.col("_all") - F.col("pos")).alias("neg"),
        F.col("_p").alias("d_tp"), (F.col("_n") - F.col("_p")).alias("d_fp"),
    )


def roc(c: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """fpr and tpr per threshold, and the (0, 0) point at an infinite threshold."""
    points = c.select(*key, "thr", safe_ratio(F.col("fp"), F.col("neg")).alias("fpr"), safe_ratio(F.col("tp"), F.col("pos")).alias("tpr"))
    start = c.groupBy(*key).agg(F.lit(float("inf")).alias("thr"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr(c: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return c.select(
        *key, "thr", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("pos")).alias("recall"),
    )


def auc(c: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (trapezoids); 0 when only one class is present."""
    tp, fp_step = F.col("tp").cast("double"), F.col("d_fp").cast("double")
    area = F.sum(fp_step * (tp - F.col("d_tp") / 2))
    return c.groupBy(*key).agg(
        safe_ratio(area, F.max("pos").cast("double") * F.max("neg")).alias("auc")
    )


def average_precision(c: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision."""
    step = F.col("d_tp") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.groupBy(*key).agg(safe_ratio(F.sum(step), F.max("pos")).alias("ap"))


def best_f1(c: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1; the highest one on ties."""
    scored = c.withColumn("f1", safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")))
    scored = scored.withColumn("_down", F.negative(F.col("thr")))
    return argmax_row(scored, "f1", ["_down"], list(key)).select(*key, "thr", "f1")


def threshold(errors: DataFrame, rule: str, err: str = "err", label: str = "label", split: str | None = "split",
              fit_split: str = "val") -> DataFrame:
    """One row ``thr``: mean + 3 std, a percentile (``p95``, ``p99.5``, ...) or best F1,
    fitted on ``fit_split`` only, so that test rows never choose their own threshold."""
    rows = errors if split is None else errors.where(F.col(split) == fit_split)
    if rule == "3sigma":
        return rows.agg((F.avg(err) + 3 * F.stddev_pop(err)).alias("thr"))
    if rule == "best_f1":
        return best_f1(curve(rows, [], err, label)).select("thr")
    if rule.startswith("p"):
        return order_statistics(rows, [], err, {"thr": float(rule[1:]) / 100})
    raise ValueError("rule must be 3sigma, best_f1 or p<percentile>")


def flag(errors: DataFrame, thr: float | Column, err: str = "err", inclusive: bool = False, name: str = "pred") -> DataFrame:
    over = F.col(err) >= thr if inclusive else F.col(err) > thr
    return errors.withColumn(name, F.when(over, 1).otherwise(0))


def confusion(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    def cell(p, l):
        return F.coalesce(F.sum(F.when((F.col(pred) == p) & (F.col(label) == l), 1).otherwise(0)), F.lit(0))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(1, 1).alias("tp")
    )


def prf(cells: DataFrame) -> DataFrame:
    """precision, recall and F1 from tn/fp/fn/tp; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns({
        "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    })


def trigger_quality(hit: DataFrame, found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision from false alarms, recall over truths, their F1, and the F1 of a
    scorer that takes precision as 1 (``f1_no_false_alarms``)."""
    d = hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_alarms"), F.sum(F.col("hit").cast("int")).alias("n_hits"))
    t = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_truth"), F.sum(F.col("found").cast("int")).alias("n_found"))
    return _quality([d, t], by)


def _quality(counts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 from frames that hold n_alarms, n_hits, n_truth and n_found."""
    both = side_by_side(counts, by).na.fill(0, ["n_alarms", "n_hits", "n_truth", "n_found"])
    both = both.withColumns({
        "precision": safe_ratio(F.col("n_hits"), F.col("n_alarms")), "recall": safe_ratio(F.col("n_found"), F.col("n_truth")),
    })
    return both.withColumns({
        "f1": safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "f1_no_false_alarms": safe_ratio(2 * F.col("recall"), 1 + F.col("recall")),
    })


def _quantile(v: Column, q: float) -> Column:
    """Linear quantile of a sorted array without nulls; null if it is empty."""
    at = F.lit(float(q)) * (F.size(v) - 1)
    rest = at - F.floor(at)
    low = F.get(v, F.floor(at).cast("int"))
    return F.when(rest > 0, low * (1 - rest) + F.get(v, F.floor(at).cast("int") + 1) * rest).otherwise(low)


def score_trigger(cf: DataFrame, truth: DataFrame, key: Sequence[str], sr: float, tol: float = TOLERANCE_S,
                  guard: int = GUARD_ROWS, normalise: bool = True, at: str = "t", index: str = "i",
                  chunk: int = CHUNK) -> DataFrame:
    """Two scored rows per trace: the largest cf near the truth (label 1) and the
    largest one outside that zone widened by ``guard`` rows (label 0); 0 if empty.

    A chunk is one array, so a trace that is one chunk needs no sort or join of its
    rows; only the quantile of longer ones is counted.  A ``_chunk`` column from
    ``sta_lta(keep_chunk=True)``, with the same ``chunk``, saves a shuffle.
    """
    lengths = cf.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    zone = lengths.join(truth.select(*key, at), list(key), "inner").withColumns({
        "_i0": F.greatest(F.lit(0), ((F.col(at) - tol) * sr).cast("bigint")),
        "_i1": F.least(F.col("_len"), ((F.col(at) + tol) * sr).cast("bigint")),
    })
    zone = cut_lineage(zone.select(*key, "_len", "_i0", "_i1"))  # one row per truth
    row = F.struct(F.col(index).alias("i"), F.col("cf").cast("double").alias("cf"))
    where = F.col("_chunk") if "_chunk" in cf.columns else chunk_of(index, chunk)
    packed = cf.where(F.col("cf").isNotNull()).select(*key, where.alias("_chunk"), row.alias("_row")).groupBy(*key, "_chunk").agg(F.collect_list("_row").alias("_rows"))
    joined = join_facts(packed, spread_facts(zone, "_len", chunk), [*key, "_chunk"], "inner")
    near = lambda i: (i >= F.col("_i0")) & (i < F.col("_i1"))
    # the widened zone keeps the slice rule of its bounds even when the zone itself is empty
    wide = lambda i: (i >= F.greatest(F.lit(0), F.col("_i0") - guard)) & (i < F.least(F.col("_len"), F.col("_i1") + guard))
    rows_near, rows_far = F.filter("_rows", lambda r: near(r["i"])), F.filter("_rows", lambda r: ~wide(r["i"]))
    whole = F.when(F.col("_len") <= chunk, let(F.array_sort(F.col("_rows")["cf"]), lambda v: _quantile(v, 0.95)))
    parts = joined.select(*key, whole.alias("_p95"), rows_near["cf"].alias("_near"), rows_far["cf"].alias("_far"))
    best = parts.groupBy(*key).agg(F.max("_p95").alias("_p95"), *[f(g(c)).alias(f"{c}_{n}") for c in ("_near", "_far") for n, f, g in (("max", F.max, F.array_max), ("min", F.min, F.array_min))])
    if normalise:
        long = zone.where(F.col("_len") > chunk).select(*key).distinct()
        if long.head(1):
            counted = order_statistics(cf.join(long, list(key), "left_semi"), key, "cf", {"_counted": 0.95})
            best = join_facts(best, counted, key, "left").withColumn("_p95", F.coalesce("_p95", "_counted"))
        best = best.where(F.col("_p95").isNotNull())
    else:
        best = best.withColumn("_p95", F.lit(1.0) - NORM_FLOOR)
    norm = F.col("_p95") + NORM_FLOOR
    # a negative norm turns the order round
    largest = lambda c: F.coalesce(F.when(norm < 0, F.col(f"{c}_min")).otherwise(F.col(f"{c}_max")) / norm, F.lit(0.0))
    best = best.select(*key, largest("_near").alias("_event"), largest("_far").alias("_noise"))
    pair = F.array(
        F.struct(F.lit(1).alias("label"), F.col("_event").alias("score")),
        F.struct(F.lit(0).alias("label"), F.col("_noise").alias("score")),
    )
    return best.select(*key, F.explode(pair).alias("_s")).select(*key, "_s.label", "_s.score")


def sweep_settings(sr: float, stas=SWEEP_STA, ltas=SWEEP_LTA, ons=SWEEP_ON, base=(1.0, 10.0, 3.0)) -> list[dict]:
    """The one-at-a-time settings in rows: axis, varied value, n_sta, n_lta, on (off = on / 2)."""
    s0, l0, t0 = base
    points = [("sta", s, s, l0, t0) for s in stas] + [("lta", l, s0, l, t0) for l in ltas] + [("on", t, s0, l0, t) for t in ons]
    return [
        {"setting": j, "axis": a, "varied": float(x), "n_sta": max(1, int(s * sr)), "n_lta": max(1, int(l * sr)), "on": float(t)}
        for j, (a, x, s, l, t) in enumerate(points)
    ]


def cf_grid(samples: DataFrame, key: Sequence[str], settings: Sequence[dict], floor: float = 1e-20, value: str = "v",
            index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``cf`` for every setting.  All window lengths are summed in one pass over the
    samples; each setting then only picks its two columns."""
    lengths = sorted({s["n_sta"] for s in settings} | {s["n_lta"] for s in settings})
    chunked = lay_out_chunks(with_halo(samples.select(*key, index, value), index, max(lengths), 0, chunk), key)
    energy = chunked.withColumn("_e", F.col(value).cast("double") * F.col(value))
    sums = moving_sums(energy, chunk_window(key, index), "_e", {f"_m{n}": (1 - n, 0) for n in lengths}).where("_own")

    def cell(s):
        sta, lta = F.col(f"_m{s['n_sta']}") / s["n_sta"], F.col(f"_m{s['n_lta']}") / s["n_lta"]
        return F.struct(
            F.lit(s["setting"]).alias("setting"), F.lit(s["on"]).alias("on"),
            F.when(lta > floor, sta / lta).otherwise(0.0).alias("cf"),
        )

    return sums.select(*key, "_chunk", index, F.explode(F.array(*[cell(s) for s in settings])).alias("_s")).select(
        *key, "_chunk", index, "_s.setting", "_s.on", "_s.cf"
    )


def trailing_sums(e: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """Sums of the last n values for several n, as ``moving_sums`` adds them up: from sums of 1, 2, 4, ... values."""
    back = lambda x, by: np.concatenate([np.zeros(min(by, len(x))), x[: max(0, len(x) - by)]])
    powers, out = {1: e}, {}
    for n in sorted(lengths):
        if n <= DIRECT_FRAME:
            out[n] = sum(back(e, k) for k in reversed(range(n)))
            continue
        while 2 * max(powers) <= n:
            k = max(powers)
            powers[2 * k] = powers[k] + back(powers[k], k)
        offset, total = 0, 0.0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                total = total + back(powers[1 << bit], offset)
                offset += 1 << bit
        out[n] = total
    return out


def _sweep_chunks(samples: DataFrame, zones: DataFrame, key: Sequence[str], settings: Sequence[dict], guard: int, floor: float,
                  value: str, index: str, chunk: int, sr: float, min_n: int, tol: float) -> DataFrame:
    """One row per chunk and setting, from one pass over the samples.

    _alarms and _hits count the events that begin and end in the chunk, and those of
    them that meet the truth.  Of a trace with several chunks (_whole is false) _i and
    _mark hold the few positions that the others need: the first and the last
    change of the on/off mark, and where an event ends that starts with the first.
    _tail is the chunk's last position, _near and _far the largest ratio inside and
    outside the zone of the truth (null without rows there), _p95 the quantile of a
    trace that is one chunk.
    """
    lengths = sorted({s["n_sta"] for s in settings} | {s["n_lta"] for s in settings})
    row = F.struct(F.col(index).alias("i"), F.col("_own").alias("own"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    chunked = with_halo(samples.select(*key, index, value), index, max(lengths), 0, chunk).groupBy(*key, "_chunk").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    rows = join_facts(chunked, spread_facts(zones, "_len", chunk), [*key, "_chunk"], "inner")
    ids, ons = [s["setting"] for s in settings], np.array([s["on"] for s in settings])
    same = [f for f in rows.schema.fields if f.name in (*key, "_chunk")]
    long, real = pa.int64(), pa.float64()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.column("_rows")[r].values
                i, own, v = (part.field(c).to_numpy(zero_copy_only=False) for c in ("i", "own", "v"))
                sums = trailing_sums(v * v, lengths)
                i, n = i[own], int(own.sum())
                cf = np.zeros((n, len(settings)))
                for k, s in enumerate(settings):
                    sta, lta = sums[s["n_sta"]][own] / s["n_sta"], sums[s["n_lta"]][own] / s["n_lta"]
                    np.divide(sta, lta, out=cf[:, k], where=lta > floor)
                mark = np.where(cf > ons, 1, np.where(cf < ons / 2, 0, -1))
                # the place of the last mark so far; a mark is an edge if it differs from the one before
                last = np.maximum.accumulate(np.where(mark >= 0, np.arange(n)[:, None], -1), axis=0)
                before = np.vstack([np.full((1, len(settings)), -1), last[:-1]])
                earlier = np.where(before >= 0, np.take_along_axis(mark, np.maximum(before, 0), 0), -1)
                edge = (mark >= 0) & (mark != earlier)
                low, high, length, t = (batch.column(c)[r].as_py() for c in ("_i0", "_i1", "_len", "_t"))
                near = far = np.zeros(n, bool)
                if low is not None:
                    near = (i >= low) & (i < high)
                    far = ~((i >= max(0, low - guard)) & (i < min(length, high + guard)))
                none = [None] * len(ids)
                largest = lambda rows: cf[rows].max(axis=0) if rows.any() else none  # noqa: E731, B023
                whole = n == length
                quantiles = np.quantile(cf, 0.95, axis=0) if low is not None and whole else none
                k, at = np.nonzero(edge.T)  # the edges of one setting after the other
                on, place = mark[at, k] == 1, i[at]
                first, last = np.ones(len(k), bool), np.ones(len(k), bool)
                first[1:] = last[:-1] = k[1:] != k[:-1]
                end = np.where(last, length, np.append(place[1:], 0)[: len(k)])
                # without what other chunks hold, the first edge may go on with an event and the last one may not end it
                alarm = on & (end - place >= min_n) & (whole | ~(first | last))
                hit = alarm & (place / sr - tol <= t) & (t <= np.maximum(place / sr + tol, end / sr)) if t is not None else np.zeros(len(k), bool)
                kept = first | last
                kept[1:] |= (first & on)[:-1]
                kept &= not whole
                events, k, at = k, k[kept], at[kept]
                offsets = pa.array(np.searchsorted(k, np.arange(len(ids) + 1)), pa.int32())
                columns = {
                    "setting": pa.array(ids, long), "_whole": pa.array([whole] * len(ids)),
                    "_alarms": pa.array(np.bincount(events[alarm], minlength=len(ids)), long), "_hits": pa.array(np.bincount(events[hit], minlength=len(ids)), long),
                    "_i": pa.ListArray.from_arrays(offsets, pa.array(i[at])),
                    "_mark": pa.ListArray.from_arrays(offsets, pa.array(mark[at, k].astype(np.int64))), "_tail": pa.array([int(i[-1])] * len(ids), long),
                    "_near": pa.array(largest(near), real), "_far": pa.array(largest(far), real), "_p95": pa.array(quantiles, real),
                }
                fixed = [batch.column(f.name).take(pa.array([r] * len(ids))) for f in same]
                yield pa.RecordBatch.from_arrays([*fixed, *columns.values()], [*[f.name for f in same], *columns])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in same)
    return rows.mapInArrow(kernel, f"{fields}, setting long, _whole boolean, _alarms long, _hits long, _i array<long>, _mark array<long>, _tail long, _near double, _far double, _p95 double")


def sweep(samples: DataFrame, truth: DataFrame, key: Sequence[str], sr: float, settings: Sequence[dict] | None = None,
          min_dur: float = 1.0, tol: float = TOLERANCE_S, with_auc: bool = True, value: str = "v", index: str = "i",
          chunk: int = CHUNK, guard: int = GUARD_ROWS, at: str = "t", floor: float = 1e-20) -> DataFrame:
    """Quality per setting: alarms, precision, recall, F1, and ROC-AUC of the scores.

    ``truth`` has at most one row per trace.  All settings share one pass over the
    samples: a task has the ratios of its chunk for all of them side by side, counts
    the events inside the chunk and sends on, per setting, these counts, at most three
    changes of the on/off mark and a few maxima.  Only events of traces with several
    chunks are put together afterwards.  The normalising quantile of a trace
    longer than a chunk is counted over its chunks.  Null values count as 0.
    """
    settings = settings or sweep_settings(sr)
    keys = [*key, "setting"]
    lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    bound = lambda t: (t * sr).cast("bigint")
    zones = join_facts(lengths, truth.select(*key, F.col(at).alias("_t")), key, "left").select(
        *key, "_len", F.greatest(F.lit(0), bound(F.col("_t") - tol)).alias("_low"), F.least(F.col("_len"), bound(F.col("_t") + tol)).alias("_high"), "_t"
    )
    # greatest and least skip nulls: no truth, no zone
    zones = zones.select(*key, "_len", *[F.when(F.col("_t").isNotNull(), F.col(c)).alias(n) for c, n in (("_low", "_i0"), ("_high", "_i1"))], F.col("_t").cast("double").alias("_t"))
    min_n = int(min_dur * sr)
    parts = cut_lineage(_sweep_chunks(samples, zones, key, settings, guard, floor, value, index, chunk, sr, min_n, tol))
    several = parts.where("NOT _whole")
    changes = several.select(*keys, "_chunk", F.posexplode(F.arrays_zip("_i", "_mark")).alias("_pos", "_e"))
    changes = changes.select(*keys, "_chunk", "_e._i", F.col("_e._mark").alias("_mark"), F.when(F.col("_pos") > 0, 1 - F.col("_e._mark")).alias("_prev"), F.lit(True).alias("_edge"))
    tails = several.select(*keys, "_chunk", F.col("_tail").alias("_i"), F.lit(None).cast("long").alias("_mark"), F.lit(None).cast("long").alias("_prev"), F.lit(False).alias("_edge"))
    across = to_seconds(events_from_edges(changes.unionByName(tails), keys, min_n), sr)
    across = join_facts(across, truth.select(*key, F.col(at).cast("double").alias("_t")), key, "left")
    met = (F.col("t_on") - tol <= F.col("_t")) & (F.col("_t") <= F.greatest(F.col("t_on") + tol, F.col("t_off")))
    counts = [*keys, "_alarms", "_hits"]
    across = across.select(*keys, F.lit(1).cast("long").alias("_alarms"), F.coalesce(met, F.lit(False)).cast("long").alias("_hits"))
    traces = several.select(*counts).unionByName(across).groupBy(*keys).agg(F.sum("_alarms").alias("_alarms"), F.sum("_hits").alias("_hits"))
    traces = parts.where("_whole").select(*counts).unionByName(traces)  # one row per trace and setting
    found = traces.groupBy("setting").agg(F.sum("_alarms").alias("n_alarms"), F.sum("_hits").alias("n_hits"), F.sum((F.col("_hits") > 0).cast("long")).alias("n_found"))
    ids = F.array(*[F.lit(s["setting"]).cast("long") for s in settings])
    truths = truth.agg(F.count(F.lit(1)).alias("n_truth")).where("n_truth > 0").select(F.explode(ids).alias("setting"), "n_truth")
    out = _quality([found.where("n_alarms > 0"), truths], ["setting"])
    if with_auc:
        best = parts.groupBy(*keys).agg(F.max("_near").alias("_near"), F.max("_far").alias("_far"), F.max("_p95").alias("_p95"))
        best = join_facts(best, zones.where("_i0 IS NOT NULL").select(*key, "_len"), key, "inner")
        long = zones.where((F.col("_len") > chunk) & F.col("_i0").isNotNull()).select(*key)
        if long.head(1):
            grid = cf_grid(samples.join(long, list(key), "left_semi"), key, settings, floor, value, index, chunk)
            counted = order_statistics(grid, keys, "cf", {"_counted": 0.95})
            best = join_facts(best, counted, keys, "left").withColumn("_p95", F.coalesce("_p95", "_counted"))
        scaled = lambda c: F.coalesce(F.col(c) / (F.col("_p95") + NORM_FLOOR), F.lit(0.0))
        pair = F.array(F.struct(F.lit(1).alias("label"), scaled("_near").alias("score")), F.struct(F.lit(0).alias("label"), scaled("_far").alias("score")))
        scores = best.select(*keys, F.explode(pair).alias("_s")).select(*keys, "_s.label", "_s.score")
        out = out.join(auc(curve(scores, ["setting"]), ["setting"]), "setting", "left").na.fill(0.0, ["auc"])
    axis = F.create_map(*[v for s in settings for v in (F.lit(s["setting"]).cast("long"), F.lit(s["axis"]))])
    varied = F.create_map(*[v for s in settings for v in (F.lit(s["setting"]).cast("long"), F.lit(s["varied"]))])
    return out.withColumns({"axis": axis[F.col("setting")], "varied": varied[F.col("setting")]})


def best_per_axis(swept: DataFrame, by: str = "f1_no_false_alarms") -> DataFrame:
    """The first best value of each axis."""
    return argmax_row(swept, by, ["setting"], ["axis"]).select("axis", "varied", by)


def compare(results: Sequence[DataFrame]) -> DataFrame:
    """Results of several methods in one table; what a method lacks stays null."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def learning_curve(epochs: DataFrame, epoch: str = "epoch", train: str = "loss", val: str = "val_loss") -> DataFrame:
    """Last losses, best epoch and a verdict: gap > half the training loss is
    overfitting, a training loss > 0.5 is underfitting."""
    facts = epochs.agg(
        F.max_by(train, epoch).alias("train_loss"), F.max_by(val, epoch).alias("val_loss"),
        F.min_by(epoch, F.struct(val, epoch)).alias("best_epoch"), F.min(val).alias("best_val_loss"),
    )
    gap = F.col("val_loss") - F.col("train_loss")
    verdict = F.when(gap > 0.5 * F.col("train_loss"), "overfit").when(F.col("train_loss") > 0.5, "underfit").otherwise("ok")
    return facts.withColumns({"gap": gap, "verdict": verdict})
