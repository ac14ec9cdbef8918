"""Windows and conditioning against NumPy, with chunk borders inside the traces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plans import initial_plan
from tracewell.operators import conditioning as C
from tracewell.operators import spectra as S
from tracewell.operators import windows as W
from tracewell.operators.model import DenseModel
from tracewell.operators.variance import event_estimate, moving_variance
from tracewell.plans import jobs

RNG = np.random.default_rng(2)
TRACES = {"a": RNG.normal(size=9000).cumsum() / 10, "b": np.sin(np.arange(5001) / 3) + RNG.normal(size=5001), "s": RNG.normal(size=7)}


@pytest.fixture(scope="module")
def samples(spark):
    pdf = pd.concat([pd.DataFrame({"t": k, "i": np.arange(len(x)), "v": x}) for k, x in TRACES.items()])
    return spark.createDataFrame(pdf).repartition(5)


def values(df, t, col="v"):
    pdf = df.where(F.col("t") == t).orderBy("i").toPandas()
    assert pdf.i.tolist() == list(range(len(pdf)))
    return pdf[col].to_numpy()


def test_windows_from_samples_equal_array_form(spark, samples):
    n, step = 100, 37
    long = {(r.t, r.k): r.x for r in W.collect_windows(samples, ["t"], n, step).collect()}
    arrays = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in TRACES.items()], "t string, data array<double>")
    assert {(r.t, r.k): r.x for r in W.make_windows(arrays, n, step).collect()} == long
    for k, x in TRACES.items():
        assert sum(1 for key in long if key[0] == k) == len(range(0, len(x) - n + 1, step))


def test_window_longer_than_trace_and_gaps(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "t string, data array<double>")
    assert W.make_windows(df, 4, 2).count() == 0
    long = df.select("t", F.posexplode("data").alias("i", "v"))
    assert W.collect_windows(long, ["t"], 4, 2).count() == 0
    # a step longer than the window leaves samples out
    assert [tuple(r.x) for r in W.collect_windows(long, ["t"], 1, 2).orderBy("k").collect()] == [(1.0,), (3.0,)]
    assert W.window_step(400, 0.5) == W.window_step(400, 50, percent=True) == 200


@pytest.mark.parametrize("flat,expected", [("drop", None), ("keep", [5.0, 5.0]), ("zero", [0.0, 0.0])])
def test_zscore_of_flat_window(spark, flat, expected):
    df = spark.createDataFrame([(1, [5.0, 5.0]), (2, [1.0, 3.0])], "id int, x array<double>")
    got = {r.id: r.x for r in W.zscore(df, flat=flat).collect()}
    assert got[2] == [-1.0, 1.0]
    assert got.get(1) == expected


def test_pad_crop_and_central(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [float(v) for v in range(9)])], "id int, data array<double>")
    assert {r.id: r.x for r in W.pad_crop(df, 5).collect()} == {1: [1, 2, 3, 0, 0], 2: [0, 1, 2, 3, 4]}
    assert {r.id: r.x for r in W.central_window(df, 4).collect()} == {1: None, 2: [2, 3, 4, 5]}
    long = df.select("id", F.posexplode("data").alias("i", "v"))
    assert [r.v for r in W.central_samples(long, ["id"], 4, chunk=2).orderBy("pos").collect()] == [2, 3, 4, 5]


@pytest.mark.parametrize("chunk", [1000, 1 << 17])
def test_moving_variance_leaves_out_the_last_start(samples, chunk):
    mv = moving_variance(samples, ["t"], 40, chunk=chunk).toPandas()
    for k, x in TRACES.items():
        want = [np.var(x[j:j + 40]) for j in range(0, len(x) - 40, 20)]
        np.testing.assert_allclose(mv[mv.t == k].sort_values("k")["var"], want, rtol=1e-9)
    est = event_estimate(moving_variance(samples, ["t"], 40, chunk=chunk), ["t"], 40, 40.0).toPandas().set_index("t")
    want = np.array([np.var(TRACES["a"][j:j + 40]) for j in range(0, 9000 - 40, 20)])
    assert est.loc["a", "t_evento_est"] == round(want.argmax() * 0.5, 1)
    assert est.loc["a", "razao_var"] == pytest.approx(want.max() / (want.min() + 1e-10))


@pytest.mark.parametrize("chunk", [1000, 1 << 17])
def test_detrend_and_taper(samples, chunk):
    out = C.detrend_taper(samples, ["t"], chunk=chunk)
    both = C.taper(C.detrend(samples, ["t"], chunk=chunk), ["t"], chunk=chunk)
    for k, x in TRACES.items():
        i = np.arange(len(x))
        line = np.polyval(np.polyfit(i, x, 1), i)
        m = int(0.05 * len(x))
        edge = np.minimum(i, len(x) - 1 - i)
        w = np.where(edge < m, 0.5 * (1 - np.cos(np.pi * edge / max(m, 1))), 1.0)
        np.testing.assert_allclose(values(out, k), (x - line) * w, atol=1e-8)
        np.testing.assert_allclose(values(both, k), (x - line) * w, atol=1e-8)


def test_ramp_becomes_zero(spark):
    df = spark.createDataFrame([("r", i, 3.0 + 2.0 * i) for i in range(50)], "t string, i long, v double")
    assert C.detrend(df, ["t"]).agg(F.max(F.abs("v"))).first()[0] < 1e-9


def test_fir_equals_convolution(samples):
    taps = C.sinc_taps(0.5, 15, 40, 25)
    out = C.bandpass_fir(samples, ["t"], taps, chunk=512)
    for k, x in TRACES.items():
        np.testing.assert_allclose(values(out, k), np.convolve(x, taps)[25:25 + len(x)], atol=1e-12)


@pytest.mark.parametrize("zero_phase", [True, False])
def test_butterworth_does_not_show_chunk_borders(samples, zero_phase):
    whole = C.bandpass(samples, ["t"], 40.0, zero_phase=zero_phase)
    cut = C.bandpass(samples, ["t"], 40.0, zero_phase=zero_phase, chunk=700)
    for k in TRACES:
        np.testing.assert_allclose(values(cut, k), values(whole, k), atol=1e-7)


def test_butterworth_passes_and_stops(spark):
    i = np.arange(8000)
    for hz, share in ((5.0, 1.0), (0.05, 0.0), (19.5, 0.0)):
        df = spark.createDataFrame(pd.DataFrame({"t": "x", "i": i, "v": np.sin(2 * np.pi * hz * i / 40)}))
        out = values(C.bandpass(df, ["t"], 40.0, chunk=3000), "x")[2000:6000]
        assert np.abs(out).max() == pytest.approx(share, abs=0.02)


@pytest.mark.parametrize("chunk", [999, 1 << 17])
def test_resample_keeps_a_sine(spark, chunk):
    i = np.arange(10000)
    df = spark.createDataFrame(pd.DataFrame({"t": "x", "i": i, "v": np.sin(2 * np.pi * 3 * i / 100)}))
    out = values(C.resample(df, ["t"], 100.0, 40.0, chunk=chunk), "x")
    assert len(out) == 4000
    np.testing.assert_allclose(out[200:-200], np.sin(2 * np.pi * 3 * np.arange(4000) / 40)[200:-200], atol=2e-3)


def test_response_removal_restores_the_ground_motion(spark):
    sr, n = 40.0, 8000
    i = np.arange(n)
    motion = np.sin(2 * np.pi * 4 * i / sr) * np.hanning(n)
    w0, h = 2 * np.pi, 0.7
    poles = np.array([complex(-w0 * h, w0 * np.sqrt(1 - h * h)), complex(-w0 * h, -w0 * np.sqrt(1 - h * h))])
    response = lambda f: C.response_curve(f, np.zeros(2), poles, 1.0, 2.0e3)
    size = 1 << 14
    counts = np.fft.irfft(np.fft.rfft(motion, size) * response(np.fft.rfftfreq(size, 1 / sr)), size)[:n]
    df = spark.createDataFrame(pd.DataFrame({"t": "x", "i": i, "v": counts}))
    ch = spark.createDataFrame([("x", 1.0, 2.0e3, [0.0, 0.0], [0.0, 0.0], poles.real.tolist(), poles.imag.tolist())],
                               "t string, norm_factor double, sensitivity double, zeros_re array<double>, zeros_im array<double>, poles_re array<double>, poles_im array<double>")
    for chunk in (1500, 1 << 17):
        out = values(C.remove_response(df, ch, ["t"], ["t"], sr, chunk=chunk), "x")
        np.testing.assert_allclose(out[500:-500], motion[500:-500], atol=5e-3)
        disp = values(C.remove_response(df, ch, ["t"], ["t"], sr, output="DISP", chunk=chunk), "x")
        assert np.abs(disp[3500:4500]).max() == pytest.approx(1 / (2 * np.pi * 4), rel=0.03)
    none = spark.createDataFrame([("y", i) for i in range(5)], "t string, i long").withColumn("v", F.lit(1.0))
    assert C.remove_response(none, ch, ["t"], ["t"], sr).count() == 0
    both = values(C.condition(df, ["t"], sr, sr, ch, chunk=1500), "x")
    steps = C.bandpass(C.remove_response(C.detrend_taper(df, ["t"]), ch, ["t"], ["t"], sr), ["t"], sr)
    np.testing.assert_allclose(both, values(steps, "x"), atol=1e-9)


def test_response_removal_uses_the_whole_spectrum(spark):
    """Equal to one transform of the whole trace, water level included, however the trace is cut."""
    sr, n = 40.0, 3000
    x = np.random.default_rng(4).normal(size=n)
    poles, zeros = np.array([-3 + 4j, -3 - 4j, -50 + 0j]), np.array([0j, 0j])
    size = 8192
    freq = np.fft.rfftfreq(size, 1 / sr)
    h = C.response_curve(freq, zeros, poles, 2.0, 5.0)
    floor = np.abs(h).max() * 10 ** (-10 / 20)
    raised = np.where(np.abs(h) < floor, np.where(h == 0, 1, h / np.where(h == 0, 1, np.abs(h))) * floor, h)
    want = np.fft.irfft(np.fft.rfft(x, size) * C.pre_filter_gain(freq, C.PRE_FILTER) / raised, size)[:n]
    df = spark.createDataFrame(pd.DataFrame({"t": "x", "i": np.arange(n), "v": x}))
    ch = spark.createDataFrame([("x", 2.0, 5.0, zeros.real.tolist(), zeros.imag.tolist(), poles.real.tolist(), poles.imag.tolist())],
                               "t string, norm_factor double, sensitivity double, zeros_re array<double>, zeros_im array<double>, poles_re array<double>, poles_im array<double>")
    for cells in (1 << 20, 512):
        out = values(C.remove_response(df, ch, ["t"], ["t"], sr, water_level=10.0, chunk=1000, cells=cells), "x")
        np.testing.assert_allclose(out, want, atol=1e-9)
    more = spark.createDataFrame([("short", 0, 1.0), ("flat", 0, 1.0), ("flat", 1, 1.0), ("lost", 0, 1.0), ("lost", 1, 2.0), ("bad", 0, 1.0), ("bad", 1, 2.0)], "t string, i long, v double")
    ch = ch.unionByName(ch.withColumns({"t": F.lit("bad"), "sensitivity": F.lit(0.0)}))
    got = {r.t: r.status for r in C.response_status(df.unionByName(more), ch, ["t"], ["t"]).collect()}
    assert got == {"x": "ok", "short": "too_short", "flat": "flat", "lost": "no_response", "bad": "bad_response"}
    assert values(C.remove_response(more, ch, ["t"], ["t"], sr), "bad").size == 0


@pytest.mark.parametrize(("ratio", "n"), [(0.4, 977), (2.5, 400), (3.0, 50), (0.3997, 977), (1 / 3, 100), (0.4, 3)])
def test_phases_equal_the_full_kernel(ratio, n):
    """The polyphase form against a matrix of all outputs and taps."""
    v = np.random.default_rng(1).normal(size=n)
    cutoff, half = min(1.0, ratio), 8
    halo = int(np.ceil(half / cutoff)) + 1
    first, whole = 37, 37 + n
    j = np.arange(int(np.ceil(first * ratio)), int(whole * ratio))
    away = j[:, None] / ratio - np.arange(first, whole)[None, :]
    np.testing.assert_allclose(C.interpolated(v, first, j, ratio, cutoff, half, halo), C.sinc_kernel(away, cutoff, half) @ v, atol=1e-9)

def test_spectrum_and_dominant_frequency(samples):
    spec = S.spectrogram(samples, ["t"], 64, 32, 40.0)
    pdf = spec.where("t = 'b' AND k = 3").orderBy("j").toPandas()
    want = np.abs(np.fft.rfft(TRACES["b"][96:160])) ** 2
    np.testing.assert_allclose(pdf.power, want, rtol=1e-9, atol=1e-9)
    top = S.dominant_freq(spec, ["t"], F.lit((3 * 32 + 32) / 40)).where("t = 'b'").first()
    assert top.k == 3 and top.freq == pytest.approx(want.argmax() * 40 / 64)
    welch = S.welch(samples, ["t"], 64, 32, 40.0).where("t = 'b'").orderBy("j").toPandas()
    frames = [np.abs(np.fft.rfft(TRACES["b"][s:s + 64])) ** 2 for s in range(0, 5001 - 64 + 1, 32)]
    np.testing.assert_allclose(welch.power, np.mean(frames, axis=0), rtol=1e-9)


def test_file_inventory(spark, samples):
    df = samples.withColumns({"net": F.lit("AA"), "sta": F.upper("t"), "cha": F.lit("BHZ"), "ts": F.timestamp_seconds(F.col("i") / 40)})
    st = spark.createDataFrame([("AA", "A")], "net string, sta string")
    inv = {r.t: r for r in jobs.file_inventory(df, "t", 40.0, st, chunk=777).collect()}
    assert inv["a"].n_amostras == 9000 and inv["a"].xml_disponivel and not inv["b"].xml_disponivel
    assert inv["s"].status == "short" and inv["s"].var_max is None


def test_spectra_call_their_function_once(spark):
    """The filter that Spark adds before an explode doesn't call it again, nor does one on the result."""
    s = spark.createDataFrame([("a", i, float(i % 7)) for i in range(100)], "t string, i long, v double")
    out = S.welch(s, ["t"], 32, 16, 40.0)
    assert initial_plan(out).count("ArrowEvalPython") == 1 and out.count() == 17
    model = DenseModel([np.eye(4)], [np.zeros(4)])
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id int, x array<double>")
    assert initial_plan(model.reconstruct(rows).select(F.posexplode("recon"))).count("ArrowEvalPython") == 1
    flagged = model.errors(rows).where("err < 1")
    assert initial_plan(flagged).count("ArrowEvalPython") == 1 and flagged.first().err == 0.0
