"""Ordered operators against plain loops, with chunks far shorter than the traces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators.ordered import add_index, order_statistics, ranged
from tracewell.operators.trigger import autocorrelation, coincidence, extend_merge, sta_lta, trigger

RNG = np.random.default_rng(5)
TRACES = {"a": RNG.normal(size=257), "b": np.r_[RNG.normal(size=90), 9 * RNG.normal(size=40), RNG.normal(size=71)],
          "short": RNG.normal(size=3), "flat": np.zeros(50)}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(t, i, float(v)) for t, x in TRACES.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trace string, i long, v double").repartition(7)


def mean_before(e, t, lo, hi, n):
    return e[max(0, t + lo):max(0, t + hi + 1)].sum() / n


def loop_cf(x, mode, ns, nl):
    e = x * x
    out = np.zeros(len(x))
    sta_r = lta_r = 0.0
    for t in range(len(x)):
        if mode == "causal":
            s, l = mean_before(e, t, 1 - ns, 0, ns), mean_before(e, t, 1 - nl, 0, nl)
            out[t] = s / l if l > 1e-20 else 0
        elif mode == "manual":
            s, l = mean_before(e, t, -ns, -1, ns), mean_before(e, t, -nl, -1, nl)
            out[t] = s / l if t >= nl and l > 0 else 0
        elif mode == "classic":
            s, l = mean_before(e, t, 1 - ns, 0, ns), mean_before(e, t, 1 - nl, 0, nl)
            out[t] = s / l if t >= nl - 1 and l > 0 else 0
        elif mode == "delayed":
            s, l = mean_before(e, t, 1 - ns, 0, ns), mean_before(e, t, 1 - ns - nl, -ns, nl)
            out[t] = s / l if t >= ns + nl - 1 and l > 0 else 0
        elif mode == "recursive":
            sta_r += (e[t] - sta_r) / ns
            lta_r += (e[t] - lta_r) / nl
            out[t] = sta_r / lta_r if t >= nl and lta_r > 0 else 0
    if mode == "centred":
        if len(x) < nl:
            return None
        s = np.convolve(e, np.ones(ns), "same") / ns
        l = np.convolve(e, np.ones(nl), "same") / nl
        out = s / (l + 1e-10)
        out[:nl] = 0
    if mode == "zdetect":
        s = np.array([mean_before(e, t, 1 - ns, 0, ns) for t in range(len(x))])
        out = (s - s.mean()) / s.std() if s.std() > 0 else np.zeros(len(x))
    if mode == "carl":
        m = lambda a, n: np.array([a[max(0, t - n + 1):t + 1].sum() / n for t in range(len(a))])
        lta = m(x, nl)
        dev = np.abs(x - lta)
        out = m(dev, ns) - 0.8 * m(dev, nl) - np.abs(m(x, ns) - lta) - 0.8
        out[:nl] = -1
    return out


@pytest.mark.parametrize("mode", ["causal", "manual", "classic", "centred", "delayed", "recursive", "zdetect", "carl"])
@pytest.mark.parametrize("ns,nl,chunk", [(3, 10, 16), (5, 41, 32)])
def test_cf_equals_loop(samples, mode, ns, nl, chunk):
    got = sta_lta(samples, ["trace"], ns, nl, mode, chunk=chunk).toPandas()
    for name, x in TRACES.items():
        want = loop_cf(x, mode, ns, nl)
        mine = got[got.trace == name].sort_values("i")
        if want is None:
            assert mine.empty
            continue
        assert mine.i.tolist() == list(range(len(x)))
        np.testing.assert_allclose(mine.cf.to_numpy(), want, rtol=1e-9, atol=1e-9)


def loop_trigger(cf, on, off, min_n, inclusive, close_open):
    out, t0 = [], None
    for t, c in enumerate(cf):
        if t0 is None and (c >= on if inclusive else c > on):
            t0 = t
        elif t0 is not None and (c <= off if inclusive else c < off):
            if t - t0 >= min_n:
                out.append((t0, t))
            t0 = None
    if t0 is not None and close_open and len(cf) - t0 >= min_n:
        out.append((t0, len(cf)))
    return out


@pytest.mark.parametrize("on,off,min_n,inclusive,close_open", [
    (1.8, 0.8, 2, False, True), (1.8, 0.8, 0, False, False), (1.5, 1.5, 0, False, True), (2, 1, 0, True, True)])
@pytest.mark.parametrize("chunk", [4, 13, 1000])
def test_trigger_equals_loop(spark, on, off, min_n, inclusive, close_open, chunk):
    rng = np.random.default_rng(11)
    traces = {f"t{j}": np.round(rng.exponential(1.2, size=n), 1) for j, n in enumerate([1, 40, 120, 121])}
    traces["open"] = np.r_[np.zeros(10), np.full(30, 5.0)]
    traces["flicker"] = np.r_[5.0, np.full(40, 1.0), 0.0, np.full(20, 1.0)]
    rows = [(t, i, float(c)) for t, x in traces.items() for i, c in enumerate(x)]
    cf = spark.createDataFrame(rows, "trace string, i long, cf double").repartition(5)
    got = trigger(cf, ["trace"], on, off, min_n, inclusive, close_open, chunk=chunk).collect()
    for name, x in traces.items():
        mine = sorted((r.on_i, r.off_i) for r in got if r.trace == name)
        assert mine == loop_trigger(x, on, off, min_n, inclusive, close_open), name


def test_index_and_quantiles(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n))
    pdf = pd.DataFrame({"k": key, "o": rng.permutation(n), "v": np.round(rng.normal(size=n), 1)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = add_index(df, ["k"], ["o"]).toPandas()
    want = pdf.assign(i=pdf.groupby("k").o.rank().astype(int) - 1)
    pd.testing.assert_frame_equal(got.sort_values("o")[["k", "o", "i"]].reset_index(drop=True),
                                  want.sort_values("o")[["k", "o", "i"]].reset_index(drop=True), check_dtype=False)
    total = add_index(df, [], ["o"]).agg(F.sum(F.abs(F.col("o") - F.col("i")))).first()[0]
    assert total == 0
    stats = order_statistics(df, ["k"], "v", {"p5": 0.05, "med": 0.5, "p99": 0.99}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(stats.loc[k, ["p5", "med", "p99"]].astype(float), np.percentile(g.v, [5, 50, 99]), atol=1e-12)


@pytest.mark.parametrize("chunk", [8, 1000])
def test_extend_merge_and_coincidence(spark, chunk):
    rng = np.random.default_rng(8)
    rows = []
    for t in "ab":
        for c in "xyz":
            on = 0
            while on < 200:
                on += int(rng.integers(1, 15))
                off = on + int(rng.integers(1, 12))
                rows.append((t, c, on, off))
                on = off
    det = spark.createDataFrame(rows, "trace string, cha string, on_i long, off_i long")
    merged = extend_merge(det, ["trace"], 1, 2, chunk).collect()
    votes = coincidence(det, ["trace"], "cha", 2, chunk).collect()
    for t in "ab":
        mine, islands = [r for r in rows if r[0] == t], []
        for on, off in sorted((max(0, r[2] - 1), r[3] + 2) for r in mine):
            if islands and on <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], off)
            else:
                islands.append([on, off])
        assert sorted([r.on_i, r.off_i] for r in merged if r.trace == t) == islands
        level = np.zeros(400, int)
        for r in mine:
            level[r[2]:r[3]] += 1
        edges = np.flatnonzero(np.diff(np.r_[0, (level >= 2).astype(int), 0]))
        assert sorted((r.on_i, r.off_i) for r in votes if r.trace == t) == list(zip(edges[::2], edges[1::2]))


def test_autocorrelation(samples):
    got = autocorrelation(samples, ["trace"], [1, 3], chunk=16).toPandas()
    x = TRACES["a"]
    for k in (1, 3):
        r = got[(got.trace == "a") & (got.lag == k)].r.iloc[0]
        assert abs(r - np.corrcoef(x[k:], x[:-k])[0, 1]) < 1e-9


def test_hot_trace_is_spread_over_partitions(spark):
    """A trace with most of the rows, many of them at the same instant, is not one task."""
    df = spark.range(120_000).select(
        F.when(F.col("id") % 10 < 7, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("ts"), "id",
    )
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        sizes = [r["count"] for r in ranged(df, ["k"], ["ts", "id"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set(name, old)
    assert len(sizes) == 4 and max(sizes) < 1.5 * 120_000 / 4
    hot = add_index(df, ["k"], ["ts", "id"]).where("k = -1").agg(F.count("i"), F.countDistinct("i"), F.max("i")).first()
    assert tuple(hot) == (84_000, 84_000, 83_999)
