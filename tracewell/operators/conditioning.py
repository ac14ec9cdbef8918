"""Conditioning of traces: detrend, taper, filters, resampling, instrument response.

Trace-wide facts (trend, length) are one small aggregate joined back per chunk.
Filters with a short response work on chunks with a halo, filters with feedback
are scanned over chunks (``recurrence``), and what needs the spectrum of a whole
trace uses transforms over many tasks (``fourier``).  The numeric kernel inside a
chunk is NumPy, as FFTs and long convolutions have no built-in counterpart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, attach_facts, attach_trace_facts, join_facts, spread_facts, with_halo
from tracewell.operators.fourier import CELLS, fourier_filter, fourier_resample, size_for
from tracewell.operators.recurrence import butterworth_sections, cascade, filtered
from tracewell.session import cut_lineage

PRE_FILTER = (0.5, 1.0, 18.0, 20.0)  # fixed corner frequencies in Hz
WATER_LEVEL_DB = 60.0
BAND = (0.5, 15.0)


def trend_facts(samples: DataFrame, key: Sequence[str], value: str = "v", index: str = "i") -> DataFrame:
    """Least-squares line and length per trace: (key, slope, intercept, len)."""
    facts = samples.groupBy(*key).agg(
        F.covar_pop(value, index).alias("_cov"), F.var_pop(index).alias("_var"),
        F.avg(value).alias("_my"), F.avg(index).alias("_mx"), (F.max(index) + 1).alias("_len"),
    )
    slope = F.when(F.col("_var") > 0, F.col("_cov") / F.nullif(F.col("_var"), F.lit(0.0))).otherwise(0.0)
    facts = facts.withColumn("_slope", slope)
    return facts.select(*key, "_slope", (F.col("_my") - F.col("_slope") * F.col("_mx")).alias("_intercept"), "_len")


def detrend(samples: DataFrame, key: Sequence[str], value: str = "v", index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Remove the least-squares line (and with it the mean)."""
    joined = attach_trace_facts(samples, trend_facts(samples, key, value, index), key, "_len", index, chunk)
    flat = F.col(value) - (F.col("_intercept") + F.col("_slope") * F.col(index))
    return joined.withColumn(value, flat).drop("_slope", "_intercept", "_len", "_chunk")


def taper_weight(index: str, length: str, p: float):
    """Raised cosine over int(p * length) rows at each end."""
    m = (F.col(length) * F.lit(float(p))).cast("bigint")
    edge = F.least(F.col(index), F.col(length) - 1 - F.col(index))
    return F.when((m > 0) & (edge < m), 0.5 * (1 - F.cos(F.lit(math.pi) * edge / m))).otherwise(1.0)


def taper(samples: DataFrame, key: Sequence[str], p: float = 0.05, value: str = "v", index: str = "i",
          chunk: int = CHUNK) -> DataFrame:
    lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    joined = attach_trace_facts(samples, lengths, key, "_len", index, chunk)
    return joined.withColumn(value, F.col(value) * taper_weight(index, "_len", p)).drop("_len", "_chunk")


def detrend_taper(samples: DataFrame, key: Sequence[str], p: float = 0.05, value: str = "v", index: str = "i",
                  chunk: int = CHUNK) -> DataFrame:
    """Both steps on one set of trace facts: a single aggregate and a single join."""
    joined = attach_trace_facts(samples, trend_facts(samples, key, value, index), key, "_len", index, chunk)
    flat = F.col(value) - (F.col("_intercept") + F.col("_slope") * F.col(index))
    return joined.withColumn(value, flat * taper_weight(index, "_len", p)).drop("_slope", "_intercept", "_len", "_chunk")


def map_chunks(samples: DataFrame, key: Sequence[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray],
               halo: int, value: str = "v", index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Apply ``kernel(i, v) -> v`` to chunks that see ``halo`` extra rows on both sides."""
    columns = [*key, index, value]
    schema = samples.select(*key, F.col(index).cast("bigint").alias(index), F.col(value).cast("double").alias(value)).schema
    chunked = with_halo(samples.select(*columns), index, halo, halo, chunk)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        out = kernel(pdf[index].to_numpy(), pdf[value].to_numpy(dtype=float))
        return pdf.assign(**{value: out}).loc[pdf["_own"], columns]

    return chunked.groupBy(*key, "_chunk").applyInPandas(run, schema)


def sinc_taps(lo: float, hi: float, sr: float, half: int) -> np.ndarray:
    """Symmetric band-pass taps of length 2 * half + 1 (ideal response, Hamming window)."""
    m = np.arange(-half, half + 1)
    ideal = 2 * hi / sr * np.sinc(2 * hi / sr * m) - 2 * lo / sr * np.sinc(2 * lo / sr * m)
    return ideal * (0.54 + 0.46 * np.cos(np.pi * m / half))


def bandpass_fir(samples: DataFrame, key: Sequence[str], taps: np.ndarray, value: str = "v", index: str = "i",
                 chunk: int = CHUNK) -> DataFrame:
    """Zero-phase FIR filter; values outside the trace count as 0."""
    taps = np.asarray(taps, dtype=float)
    half = len(taps) // 2
    return map_chunks(
        samples, key, lambda i, v: np.convolve(v, taps)[half:half + len(v)], half, value, index, chunk
    )


def butter_gain(freq: np.ndarray, lo: float, hi: float, sr: float, order: int) -> np.ndarray:
    """Amplitude of a digital Butterworth band-pass (bilinear transform)."""
    w = np.tan(np.pi * np.clip(freq, 0, sr / 2 * (1 - 1e-12)) / sr)
    wl, wh = np.tan(np.pi * lo / sr), np.tan(np.pi * min(hi, sr / 2 * 0.999) / sr)
    with np.errstate(divide="ignore"):
        shape = np.where(w > 0, (w * w - wl * wh) / np.where(w > 0, w, 1) / (wh - wl), np.inf)
    return 1.0 / np.sqrt(1.0 + np.abs(shape) ** (2 * order))


def bandpass(samples: DataFrame, key: Sequence[str], sr: float, lo: float = BAND[0], hi: float = BAND[1],
             order: int = 4, zero_phase: bool = True, value: str = "v", index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Butterworth band-pass by second-order sections, from rest.

    The sections are a linear recurrence, scanned exactly over chunks (see
    ``recurrence``); ``zero_phase`` runs them again from the end of the trace.
    """
    system = cascade(butterworth_sections(lo, hi, sr, order))
    return filtered(samples, key, system, zero_phase, value, index, chunk)


def resample_mean(samples: DataFrame, key: Sequence[str], factor: int, value: str = "v", index: str = "i") -> DataFrame:
    """Integer decimation by the mean of each block of ``factor`` rows (after a low-pass)."""
    block = F.floor(F.col(index) / factor).cast("bigint")
    return samples.groupBy(*key, block.alias(index)).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == factor
    ).drop("_n")


PHASES = 64  # filters kept for a ratio of small whole numbers


def sinc_kernel(away: np.ndarray, cutoff: float, half: int) -> np.ndarray:
    """The interpolation kernel at distances ``away`` (in input samples): a sinc under a raised cosine."""
    d = away * cutoff
    return cutoff * np.sinc(d) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0.0)


def interpolated(v: np.ndarray, first: int, j: np.ndarray, ratio: float, cutoff: float, half: int, halo: int) -> np.ndarray:
    """Outputs ``j`` (consecutive) of a signal whose sample ``first`` is v[0]; samples outside v count as 0.

    With a ratio up/down of small whole numbers, every ``up``-th output has the
    same filter, moved by ``down`` samples: one filter per phase and one strided
    sum for each of its taps, with no array larger than the outputs.  Other ratios
    take the outputs in blocks.
    """
    out = np.zeros(len(j))
    if not len(j):
        return out
    offsets = np.arange(-halo + 1, halo + 1)
    fraction = Fraction(ratio).limit_denominator(10_000)
    up, down = fraction.numerator, fraction.denominator
    rational = up <= PHASES and abs(up / down - ratio) <= 1e-12 * ratio
    lowest, highest = (int(j[k]) * down // up if rational else int(j[k] / ratio) for k in (0, -1))
    before = max(0, first - (lowest - halo))
    after = max(0, highest + halo + 2 - (first + len(v)))
    v, first = np.pad(v, (before, after)), first - before
    if rational:
        for p in range(min(up, len(j))):
            mine = out[p::up]
            base, part = divmod(int(j[p]) * down, up)
            start = base - first
            for m, w in zip(offsets.tolist(), sinc_kernel(part / up - offsets, cutoff, half).tolist(), strict=True):
                if w:
                    mine += w * v[start + m :: down][: len(mine)]
        return out
    for at in range(0, len(j), 256):
        place = j[at : at + 256] / ratio
        base = np.floor(place).astype(np.int64)
        kernel = sinc_kernel((place - base)[:, None] - offsets, cutoff, half)
        out[at : at + 256] = (v[base[:, None] - first + offsets] * kernel).sum(axis=1)
    return out


def resample(samples: DataFrame, key: Sequence[str], sr: float, target: float = 40.0, half: int = 32, value: str = "v",
             index: str = "i", chunk: int = CHUNK, tolerance: float = 0.0) -> DataFrame:
    """Band-limited interpolation to ``target`` Hz by a local kernel; unchanged when the rates agree.

    ``fourier_resample`` uses the spectrum of the whole trace instead.
    """
    if abs(sr - target) <= tolerance:
        return samples.select(*key, index, value)
    ratio = target / sr
    cutoff = min(1.0, ratio)
    halo = int(math.ceil(half / cutoff)) + 1
    columns = [*key, index, value]
    schema = samples.select(*key, F.col(index).cast("bigint").alias(index), F.col(value).cast("double").alias(value)).schema
    lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    chunked = with_halo(samples.select(*columns), index, halo, halo, chunk)
    chunked = join_facts(chunked, spread_facts(lengths, "_len", chunk), [*key, "_chunk"], "inner")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        i, v = pdf[index].to_numpy(), pdf[value].to_numpy(dtype=float)
        own = i[pdf["_own"].to_numpy()]
        total = int(math.floor(int(pdf["_len"].iloc[0]) * ratio))
        # outputs whose position falls inside this chunk
        j = np.arange(math.ceil(own[0] * ratio - 1e-9), math.ceil((own[-1] + 1) * ratio - 1e-9))
        j = j[j < total]
        out = {c: pdf[c].iloc[0] for c in key}
        return pd.DataFrame({**out, index: j, value: interpolated(v, int(i[0]), j, ratio, cutoff, half, halo)}, columns=columns)

    return chunked.groupBy(*key, "_chunk").applyInPandas(run, schema)


def scale_sensitivity(samples: DataFrame, channels: DataFrame, on: Sequence[str], value: str = "v",
                      sensitivity: str = "sensitivity") -> DataFrame:
    """Counts to units by the channel's overall sensitivity; traces without one are dropped."""
    known = channels.where(F.col(sensitivity) != 0).select(*on, F.col(sensitivity).alias("_sens"))
    return attach_facts(samples, known, on).withColumn(value, F.col(value) / F.col("_sens")).drop("_sens")


def response_curve(freq: np.ndarray, zeros: np.ndarray, poles: np.ndarray, factor: float, sensitivity: float,
                   output: str = "VEL") -> np.ndarray:
    """Velocity response of a poles-and-zeros stage, for displacement or acceleration if asked."""
    s = 2j * np.pi * freq
    h = np.full(np.shape(freq), factor * sensitivity, dtype=complex)
    for z in zeros:
        h *= s - z
    for p in poles:
        h /= s - p
    return h * s if output == "DISP" else np.divide(h, s, out=np.zeros_like(h), where=s != 0) if output == "ACC" else h


def pre_filter_gain(freq: np.ndarray, corners: Sequence[float]) -> np.ndarray:
    f1, f2, f3, f4 = corners
    rise = 0.5 * (1 - np.cos(np.pi * np.clip((freq - f1) / (f2 - f1), 0, 1)))
    fall = 0.5 * (1 + np.cos(np.pi * np.clip((freq - f3) / (f4 - f3), 0, 1)))
    return rise * fall


def inverse_response(freq: np.ndarray, h: np.ndarray, floor: float, corners: Sequence[float]) -> np.ndarray:
    """Inverse of the response ``h`` with amplitudes below ``floor`` raised to it."""
    size = np.abs(h)
    raised = np.where(size < floor, np.where(size > 0, h / np.where(size > 0, size, 1), 1.0) * floor, h)
    return pre_filter_gain(freq, corners) / raised


def _stage(freq: np.ndarray, own: dict, output: str) -> np.ndarray:
    """The response that a trace's facts describe."""
    zeros, poles = (np.asarray(own[f"{n}_re"], float) + 1j * np.asarray(own[f"{n}_im"], float) for n in ("zeros", "poles"))
    return response_curve(freq, zeros, poles, float(own["norm_factor"]), float(own["sensitivity"]), output)


def _largest_response(facts: DataFrame, key: Sequence[str], sr: float, output: str, cells: int) -> DataFrame:
    """(key, _top): the largest amplitude over all frequencies of the padded trace, in blocks of them."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(size_for(2 * F.col("_len")) / (2 * cells)).cast("long"))).alias("_block")
    rows = facts.select("*", size_for(2 * F.col("_len")).alias("_points"), blocks).repartition(*key, "_block")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema.fields if f.name in key)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.to_pylist():
                k = np.arange(own["_block"] * cells, min((own["_block"] + 1) * cells, own["_points"] // 2 + 1))
                found.append(float(np.abs(_stage(k / own["_points"] * sr, own, output)).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], pa.array(found, pa.float64())], [*key, "_top"])

    return rows.mapInArrow(top, f"{kind}, _top double").groupBy(*key).agg(F.max("_top").alias("_top"))


def remove_response(samples: DataFrame, channels: DataFrame, key: Sequence[str], on: Sequence[str], sr: float,
                    output: str = "VEL", pre_filt: Sequence[float] = PRE_FILTER, water_level: float = WATER_LEVEL_DB,
                    value: str = "v", index: str = "i", chunk: int = CHUNK, lengths: DataFrame | None = None,
                    cells: int = CELLS) -> DataFrame:
    """Spectral division by the poles-and-zeros response of the channel, over the spectrum of the whole trace.

    ``channels``: one row per ``on`` with zeros_re/zeros_im/poles_re/poles_im
    arrays, norm_factor and sensitivity.  Traces without a row are dropped, see
    ``response_status``.  The water level lies below the response's largest
    amplitude over the whole spectrum; the response travels once per block of a
    trace, not once per sample.  ``lengths`` (key, _len) saves counting the
    samples again.
    """
    if lengths is None:
        lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    stage = ["zeros_re", "zeros_im", "poles_re", "poles_im", "norm_factor", "sensitivity"]
    facts = join_facts(lengths.select(*key, "_len"), channels.select(*on, *stage), on, "inner").select(*key, "_len", *stage)
    # no value in an array or a number: no response
    facts = cut_lineage(facts.where(" AND ".join(f"{c} IS NOT NULL" for c in stage)))
    top = _largest_response(facts, key, sr, output, cells)
    facts = cut_lineage(join_facts(facts, top, key, "inner").where("_top > 0"))

    def gain(part: np.ndarray, own: dict) -> np.ndarray:
        freq = part * sr
        return inverse_response(freq, _stage(freq, own, output), own["_top"] * 10 ** (-water_level / 20), pre_filt)

    return fourier_filter(samples, key, gain, facts, value, index, chunk, cells)


def response_status(samples: DataFrame, channels: DataFrame, key: Sequence[str], on: Sequence[str], index: str = "i",
                    least: int = 2, value: str = "v") -> DataFrame:
    """(key, _len, status): what conditioning makes of each trace, as a row for the ledger.

    ``too_short`` (fewer than ``least`` samples), ``flat`` (no two values differ),
    ``no_response`` (no row of ``channels``), ``bad_response`` (a missing part, or
    a factor or sensitivity of zero), else ``ok``.
    """
    stage = ["zeros_re", "zeros_im", "poles_re", "poles_im", "norm_factor", "sensitivity"]
    facts = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    known = channels.select(*on, F.lit(True).alias("_known"), F.expr(" AND ".join(f"{c} IS NOT NULL" for c in stage) + " AND norm_factor * sensitivity <> 0").alias("_good"))
    rows = join_facts(facts, known, on, "left")
    status = (
        F.when(F.col("_len") < least, "too_short").when(F.coalesce(F.col("_low") == F.col("_high"), F.lit(True)), "flat")
        .when(F.col("_known").isNull(), "no_response").when(~F.coalesce("_good", F.lit(False)), "bad_response").otherwise("ok")
    )
    return rows.select(*key, "_len", status.alias("status"))


def condition(samples: DataFrame, key: Sequence[str], sr: float, target: float = 40.0, channels: DataFrame | None = None,
              on: Sequence[str] | None = None, p: float = 0.05, band: tuple[float, float] | None = BAND,
              resample_first: bool = True, value: str = "v", index: str = "i", chunk: int = CHUNK,
              method: str = "sinc") -> DataFrame:
    """Resample, detrend, demean, taper, remove response, band-pass, in that order.

    Resampled samples are read twice (trend, then values), so they are written
    once.  ``method`` is ``sinc`` (a local kernel) or ``fourier`` (the spectrum of
    the whole trace).  ``response_status`` says why a trace is missing here.
    """
    def to_target(rows: DataFrame) -> DataFrame:
        if method == "fourier":
            return fourier_resample(rows, key, sr, target, value, index, chunk)
        return resample(rows, key, sr, target, value=value, index=index, chunk=chunk)

    out = samples.select(*key, index, value)
    if resample_first and sr != target:
        out = cut_lineage(to_target(out))
    rate = target if resample_first else sr
    lengths = out.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    out = detrend_taper(out, key, p, value, index, chunk)
    if channels is not None:
        out = remove_response(out, channels, key, on or key, rate, value=value, index=index, chunk=chunk, lengths=lengths)
    if band is not None:
        out = bandpass(out, key, rate, *band, value=value, index=index, chunk=chunk)
    return out if resample_first else to_target(out)
