"""Four-step and chirp transforms against NumPy's transform of the whole trace."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tracewell.operators import fourier as W

LENGTHS = {"a": 1, "b": 2, "c": 7, "d": 101, "e": 128, "f": 1000, "g": 4099}


@pytest.fixture(scope="module")
def traces():
    r = np.random.default_rng(1)
    return {t: r.normal(2, 3, n) for t, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def samples(spark, traces):
    pdf = pd.concat([pd.DataFrame({"t": t, "i": np.arange(len(v)), "v": v}) for t, v in traces.items()])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(4).cache()


def values(df):
    return {t: g.sort_values("i").v.to_numpy() for t, g in df.toPandas().groupby("t")}


@pytest.mark.parametrize(("cells", "chunk"), [(1 << 20, 1 << 16), (64, 256), (1 << 10, 16), (256, 1 << 12)])
def test_filter_equals_the_whole_transform(samples, traces, cells, chunk):
    def gain(f, facts):
        return np.exp(-3j * f) / (0.1 + f) * facts["scale"]

    facts = samples.groupBy("t").agg((F.max("i") + 1).alias("_len"), (F.ascii("t") / 100.0).alias("scale")).where("t <> 'c'")
    got = values(W.fourier_filter(samples, ["t"], gain, facts, chunk=chunk, cells=cells))
    assert set(got) == set(traces) - {"c"}
    for t, y in got.items():
        size = 1 << (2 * len(traces[t]) - 1).bit_length()
        h = gain(np.fft.rfftfreq(size), {"scale": ord(t) / 100})
        assert np.allclose(y, np.fft.irfft(np.fft.rfft(traces[t], size) * h, size)[: len(y)], rtol=0, atol=1e-9)


def plain_resample(x, num):
    """The usual rule on a whole spectrum: copy the lower half, double or halve the middle, transform back."""
    n = len(x)
    spectrum, out = np.fft.rfft(x), np.zeros(num // 2 + 1, complex)
    m = min(n, num)
    out[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0:
        out[m // 2] *= 2.0 if num < n else 0.5 if num > n else 1.0
    return np.fft.irfft(out, num) * num / n


@pytest.mark.parametrize("target", [40.0, 39.0, 100.5, 250.0])
@pytest.mark.parametrize(("cells", "chunk"), [(1 << 20, 1 << 16), (64, 256), (512, 16)])
def test_resample_equals_the_whole_transform(samples, traces, target, cells, chunk):
    got = values(W.fourier_resample(samples, ["t"], 100.0, target, chunk=chunk, cells=cells))
    for t, x in traces.items():
        num = int(np.floor(len(x) * target / 100.0))
        assert (t in got) == (num > 0)
        if num:
            assert np.allclose(got[t], plain_resample(x, num), rtol=0, atol=1e-9)


def test_odd_keys(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 3.0)], "t string, i long, v double")
    got = W.fourier_resample(df, ["t"], 1.0, 2.0, cells=2, chunk=2).orderBy("i").collect()
    assert [r.t for r in got] == [None] * 6 and np.allclose([r.v for r in got], plain_resample(np.array([1.0, 0.0, 3.0]), 6))
    assert W.fourier_resample(df.limit(0), ["t"], 1.0, 2.0).count() == 0


def test_small_blocks_share_a_group(spark):
    """A group for every block of 16 numbers would take far longer than its transform; large blocks stay apart."""
    pieces = spark.range(4000).selectExpr("id div 8 AS t", "id % 8 AS _b", "CAST(128 AS BIGINT) AS _size")
    assert W._bundled(pieces, ["t"], 16, 500 * 128).count().count() == 1
    assert W._bundled(pieces, ["t"], 16, 3 * W.BUNDLE).count().count() == 3
    assert W._bundled(pieces, ["t"], W.CELLS, 500 * 128).count().count() == 4000
