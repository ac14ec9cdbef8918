"""Recurrences over chunks against plain loops over whole traces."""

import numpy as np
import pandas as pd
import pytest
from tracewell.operators import conditioning as C
from tracewell.operators import recurrence as R
from tracewell.operators.trigger import sta_lta

LENGTHS = {"a": 1, "b": 63, "c": 64, "d": 65, "e": 900, "f": 4000}


@pytest.fixture(scope="module")
def traces():
    r = np.random.default_rng(1)
    return {t: r.normal(2, 3, n) for t, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def samples(spark, traces):
    pdf = pd.concat([pd.DataFrame({"t": t, "i": np.arange(len(v)), "v": v}) for t, v in traces.items()])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(4).cache()


def values(df, column="v"):
    return {t: g.sort_values("i")[column].to_numpy() for t, g in df.toPandas().groupby("t")}


def through(sections, x):
    for b0, b1, b2, a1, a2 in sections.astype(np.longdouble):
        p = q = np.longdouble(0)
        out = np.empty(len(x), np.longdouble)
        for j, v in enumerate(x):
            y = b0 * v + p
            p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
            out[j] = y
        x = out
    return x


@pytest.mark.parametrize(("chunk", "fan"), [(64, 256), (64, 2), (1000, 3), (65_536, 256)])
def test_bandpass_is_exact(samples, traces, chunk, fan):
    sections = R.butterworth_sections(0.5, 15.0, 40.0, 4)
    system = R.cascade(sections)
    once = values(R.filtered(samples, ["t"], system, chunk=chunk, fan=fan))
    twice = values(R.filtered(samples, ["t"], system, both_ways=True, chunk=chunk, fan=fan))
    for t, x in traces.items():
        y = through(sections, x)
        assert np.allclose(once[t], y.astype(float), rtol=0, atol=1e-10)
        assert np.allclose(twice[t], through(sections, y[::-1])[::-1].astype(float), rtol=0, atol=1e-10)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7])
def test_sections_have_the_gain(order):
    x = np.zeros(1 << 14)
    x[0] = 1
    y, _ = R.cascade(R.butterworth_sections(1.0, 8.0, 40.0, order)).run(x, np.zeros(2 * order))
    assert np.allclose(np.abs(np.fft.rfft(y[:, 0])), C.butter_gain(np.fft.rfftfreq(len(x), 1 / 40), 1.0, 8.0, 40.0, order), atol=1e-8)


def test_low_corner_needs_no_halo(spark):
    """A corner far below the chunk length: the state of early chunks reaches the last one."""
    x = np.random.default_rng(2).normal(0, 1, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"t": "x", "i": np.arange(len(x)), "v": x}))
    sections = R.butterworth_sections(0.0005, 0.002, 40.0, 2)
    got = values(C.bandpass(df, ["t"], 40.0, 0.0005, 0.002, 2, zero_phase=False, chunk=256))["x"]
    want = through(sections, x).astype(float)
    assert np.abs(got - want).max() < 1e-7 * np.abs(want).max()


@pytest.mark.parametrize("chunk", [64, 65_536])
@pytest.mark.parametrize("n_lta", [10, 100_000])
def test_recursive_ratio_is_exact(samples, traces, chunk, n_lta):
    got = values(sta_lta(samples, ["t"], 5, n_lta, "recursive", chunk=chunk), "cf")
    for t, x in traces.items():
        sta = lta = 0.0
        for i, v in enumerate(x):
            sta, lta = sta * (1 - 1 / 5) + v * v / 5, lta * (1 - 1 / n_lta) + v * v / n_lta
            assert got[t][i] == pytest.approx(sta / lta if i >= n_lta else 0.0, rel=1e-9)


def test_nulls_count_as_zero(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 1, None), ("x", 2, float("nan")), ("x", 3, 4.0), (None, 0, 2.0), (None, 1, 3.0)], "t string, i long, v double")
    got = R.filtered(df, ["t"], R.exponential_means(2), chunk=2).collect()
    assert sorted((str(r.t), r.i, r.v) for r in got) == [("None", 0, 1.0), ("None", 1, 2.0), ("x", 0, 0.5), ("x", 1, 0.25), ("x", 2, 0.125), ("x", 3, 2.0625)]
    assert R.filtered(df.limit(0), ["t"], R.exponential_means(2)).count() == 0
