"""Spectra of windows.  Shape: rectangular window, no scaling; power = re^2 + im^2."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.windows import collect_windows, evaluated

DB_FLOOR = 1e-12  # fixed value added before the logarithm


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _power(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        if len(x) == 0:
            yield x
            continue
        sizes = x.map(len)
        out = pd.Series(index=x.index, dtype=object)
        for _, same in x.groupby(sizes):
            spectrum = np.fft.rfft(np.stack(same.to_numpy()), axis=1)
            out.loc[same.index] = pd.Series(list(spectrum.real**2 + spectrum.imag**2), index=same.index)
        yield out


def power_spectrum(windows: DataFrame, x: str = "x", name: str = "power") -> DataFrame:
    """Adds ``power``: squared amplitude at frequencies 0 .. n // 2 of each window.

    One vectorised FFT per Arrow batch; nothing is multiplied out into rows.
    """
    return evaluated(windows, name, _power, F.col(x).cast("array<double>"))


def decibel(power: Column, floor: float = DB_FLOOR) -> Column:
    return 10 * F.log10(power + floor)


def spectrogram(samples: DataFrame, key: Sequence[str], n: int, step: int, sr: float, value: str = "v", index: str = "i") -> DataFrame:
    """One row per trace, frame and frequency: (key, k, j, t_mid, freq, power)."""
    frames = power_spectrum(collect_windows(samples, key, n, step, value, index))
    rows = frames.select(*key, "k", F.posexplode("power").alias("j", "power"))
    return rows.select(
        *key, "k", "j", ((F.col("k") * step + n / 2) / sr).alias("t_mid"), (F.col("j") * sr / n).alias("freq"), "power"
    )


def welch(samples: DataFrame, key: Sequence[str], n: int, step: int, sr: float, value: str = "v", index: str = "i") -> DataFrame:
    """Mean power per frequency over all segments of a trace."""
    return spectrogram(samples, key, n, step, sr, value, index).groupBy(*key, "j", "freq").agg(F.avg("power").alias("power"))


def dominant_freq(spec: DataFrame, key: Sequence[str], t: str | Column) -> DataFrame:
    """Frequency with the most power in the frame nearest to time ``t`` (first of equals)."""
    t = F.col(t) if isinstance(t, str) else t
    rank = F.struct(F.abs(F.col("t_mid") - t), F.col("k"), F.negative(F.col("power")), F.col("j"))
    return spec.groupBy(*key).agg(F.min_by(F.struct("k", "freq", "power"), rank).alias("_b")).select(*key, "_b.k", "_b.freq", "_b.power")
