import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell import session
from tracewell.operators import evaluate as E
from tracewell.operators import splits as S
from tracewell.operators.drift import ks_two_sample
from tracewell.operators.intervals import label_overlap, match_detections
from tracewell.operators.ordered import order_statistics
from tracewell.operators.stats import box_stats, histogram
from tracewell.operators.trigger import sta_lta, to_seconds, trigger


def frame(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(l)) for s, l in zip(scores, labels)], "score double, label int").repartition(5)


def rank_auc(s, l):
    r = pd.Series(s).rank()
    p, n = l.sum(), (1 - l).sum()
    return (r[l == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_curves_with_ties(spark):
    rng = np.random.default_rng(0)
    s, l = np.round(rng.normal(size=700), 1), rng.integers(0, 2, 700)
    c = E.curve(frame(spark, s, l))
    assert E.auc(c).first()["auc"] == pytest.approx(rank_auc(s, l))
    thr = np.unique(s)[::-1]
    tp = np.array([(l[s >= t]).sum() for t in thr])
    n = np.array([(s >= t).sum() for t in thr])
    ap = np.sum(np.diff(np.r_[0, tp]) / l.sum() * tp / n)
    assert E.average_precision(c).first()["ap"] == pytest.approx(ap)
    f1 = 2 * tp / (n + l.sum())
    best = E.best_f1(c).first()
    assert best["thr"] == thr[f1.argmax()] and best["f1"] == pytest.approx(f1.max())
    roc = E.roc(c).orderBy(F.desc("thr")).collect()
    assert (roc[0].thr, roc[0].fpr, roc[0].tpr) == (float("inf"), 0.0, 0.0) and (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)


def test_one_class_scores_zero(spark):
    c = E.curve(frame(spark, [1, 2, 3], [0, 0, 0]))
    assert E.auc(c).first()["auc"] == 0.0 and E.average_precision(c).first()["ap"] == 0.0
    cells = E.prf(E.confusion(E.flag(frame(spark, [1, 2], [0, 0]), 5, "score"))).first()
    assert (cells["precision"], cells["recall"], cells["f1"], cells["tn"]) == (0.0, 0.0, 0.0, 2)


def test_flag_everything_gives_the_event_share(spark):
    # 74 noise and 1272 event windows, all flagged: precision is the share of events
    cells = spark.createDataFrame([(0, 74, 0, 1272)], "tn int, fp int, fn int, tp int")
    out = E.prf(cells).first()
    assert out["precision"] == pytest.approx(0.94502, abs=1e-5) and out["recall"] == 1.0 and out["f1"] == pytest.approx(0.9717, abs=1e-4)


def test_thresholds_only_see_the_fitting_split(spark):
    rng = np.random.default_rng(1)
    err = rng.exponential(size=400)
    df = spark.createDataFrame([(float(e), "val" if j % 2 else "test", int(e > 2)) for j, e in enumerate(err)], "err double, split string, label int")
    val = err[1::2]
    assert E.threshold(df, "3sigma").first()["thr"] == pytest.approx(val.mean() + 3 * val.std())
    assert E.threshold(df, "p95").first()["thr"] == pytest.approx(np.percentile(val, 95))
    assert E.threshold(df, "best_f1").first()["thr"] == pytest.approx(val[val > 2].min())


@pytest.mark.parametrize("width", [7.0, 1000.0])
def test_interval_joins_equal_nested_loops(spark, width):
    rng = np.random.default_rng(4)
    det = [(t, float(a), float(a + rng.integers(0, 12))) for t in "ab" for a in rng.integers(0, 200, 40)] + [("c", 5.0, 6.0)]
    truth = [(t, float(x)) for t in "ab" for x in rng.integers(0, 220, 15)] + [("d", 1.0)]
    d = spark.createDataFrame(det, "t string, t_on double, t_off double")
    g = spark.createDataFrame(truth, "t string, x double")
    hit, found = match_detections(d, g, ["t"], 2.0, at="x", width=width)
    ok = lambda a, b, x: abs(a - x) <= 2 or a <= x <= b
    assert sorted((r.t, r.t_on, r.t_off, r.hit) for r in hit.collect()) == sorted((t, a, b, any(u == t and ok(a, b, x) for u, x in truth)) for t, a, b in det)
    assert sorted((r.t, r.x, r.found) for r in found.collect()) == sorted((t, x, any(u == t and ok(a, b, x) for u, a, b in det)) for t, x in truth)
    iv = [(t, float(a), float(a + 3)) for t in "ab" for a in rng.integers(0, 200, 12)]
    w = spark.createDataFrame([(t, float(s), float(s + 8)) for t in "abc" for s in range(0, 200, 4)], "t string, w0 double, w1 double")
    out = label_overlap(w, spark.createDataFrame(iv, "t string, e0 double, e1 double"), ["t"], width=width)
    for r in out.collect():
        assert r.label == int(any(t == r.t and r.w0 < b and r.w1 > a for t, a, b in iv))


def test_window_that_only_touches_truth_is_normal(spark):
    w = spark.createDataFrame([("a", 10.0, 18.0), ("a", 0.0, 8.0)], "t string, w0 double, w1 double")
    t = spark.createDataFrame([("a", 8.0, 10.0)], "t string, e0 double, e1 double")
    assert [r.label for r in label_overlap(w, t, ["t"]).collect()] == [0, 0]


def loop_scores(cf, t, sr, tol, guard):
    norm = cf / (np.percentile(cf, 95) + 1e-10)
    a, b = max(0, int((t - tol) * sr)), min(len(cf), int((t + tol) * sr))
    event = norm[a:b].max() if b > a else 0.0
    mask = np.ones(len(cf), bool)
    mask[max(0, a - guard):min(len(cf), b + guard)] = False
    return event, norm[mask].max() if mask.any() else 0.0


@pytest.mark.parametrize("chunk", [50, 1 << 17])
def test_trigger_scores(spark, chunk):
    rng = np.random.default_rng(6)
    traces = {"mid": (rng.normal(size=400), 20.0), "start": (rng.normal(size=300), 0.0), "past": (rng.normal(size=200), 500.0), "tiny": (rng.normal(size=12), 1.0)}
    s = spark.createDataFrame([(k, i, float(v)) for k, (x, _) in traces.items() for i, v in enumerate(x)], "t string, i long, v double")
    truth = spark.createDataFrame([(k, t) for k, (_, t) in traces.items()], "t string, at double")
    cf = sta_lta(s, ["t"], 3, 10, chunk=chunk)
    got = {(r.t, r.label): r.score for r in E.score_trigger(cf, truth, ["t"], 10.0, tol=2.0, guard=5, at="at", chunk=chunk).collect()}
    for k, (_, t) in traces.items():
        x = np.array([r.cf for r in cf.where(F.col("t") == k).orderBy("i").collect()])
        event, noise = loop_scores(x, t, 10.0, 2.0, 5)
        assert got[(k, 1)] == pytest.approx(event) and got[(k, 0)] == pytest.approx(noise)


def test_trigger_scores_of_short_traces_rank_no_rows(spark, monkeypatch):
    """Traces of one chunk need no table of ranked values, also where the norm is negative."""
    rng = np.random.default_rng(16)
    traces = {k: rng.normal(size=n) - off for k, n, off in (("up", 300, 0), ("down", 200, 9), ("one", 1, 0))}
    cf = spark.createDataFrame([(k, i, float(v)) for k, x in traces.items() for i, v in enumerate(x)], "t string, i long, cf double")
    truth = spark.createDataFrame([(k, 10.0) for k in traces], "t string, at double")
    monkeypatch.setattr(E, "order_statistics", lambda *a, **k: pytest.fail("ranked"))
    got = {(r.t, r.label): r.score for r in E.score_trigger(cf, truth, ["t"], 10.0, tol=2.0, guard=5, at="at").collect()}
    assert len(got) == 6
    for k, x in traces.items():
        assert (got[k, 1], got[k, 0]) == pytest.approx(loop_scores(x, 10.0, 10.0, 2.0, 5))


def test_quantiles_with_and_without_the_sketch(spark):
    """A group above the sketch's size, a small one, ties and nulls: both ways agree with NumPy."""
    rng = np.random.default_rng(8)
    values = {"large": np.round(rng.normal(size=25_000), 3), "small": rng.normal(size=7), "same": np.zeros(12_000)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in values.items()])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("small", None)], "k string, v double"))
    for sketched in (True, False):
        got = {r.k: r for r in order_statistics(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}, sketched=sketched).collect()}
        for k, v in values.items():
            np.testing.assert_allclose([got[k].a, got[k].b, got[k].c], np.quantile(v, [0.25, 0.5, 0.999]), atol=1e-12)


def test_sweep_grid_and_best_axis(spark):
    rng = np.random.default_rng(7)
    rows, truth = [], []
    for k in range(4):
        x = rng.normal(size=900)
        x[400:460] *= 12
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
        truth.append((k, 41.0))
    s, t = spark.createDataFrame(rows, "k int, i long, v double"), spark.createDataFrame(truth, "k int, t double")
    out = E.sweep(s, t, ["k"], 10.0, tol=5.0, chunk=128)
    pdf = out.toPandas().sort_values("setting")
    assert len(pdf) == 17 and pdf.groupby("axis").size().to_dict() == {"sta": 5, "lta": 5, "on": 7}
    # the same with every trace in one chunk, where the quantiles come from the kernel
    whole = E.sweep(s, t, ["k"], 10.0, tol=5.0).toPandas().sort_values("setting")
    pd.testing.assert_frame_equal(pdf.reset_index(drop=True), whole[pdf.columns].reset_index(drop=True))
    # and each setting alone through the trigger and its scores
    for setting in E.sweep_settings(10.0)[:3]:
        cf = sta_lta(s, ["k"], setting["n_sta"], setting["n_lta"])
        alone = trigger(cf, ["k"], setting["on"], setting["on"] / 2, 10).count()
        scored = E.score_trigger(cf, t, ["k"], 10.0, tol=5.0)
        row = pdf[pdf.setting == setting["setting"]].iloc[0]
        assert alone == row.n_alarms and E.auc(E.curve(scored)).first()["auc"] == pytest.approx(row.auc)
    assert E.best_per_axis(out).count() == 3


@pytest.mark.parametrize("chunk", [16, 64, 1 << 16])
def test_sweep_sends_on_few_changes(spark, chunk):
    """Counts are those of trigger and interval join; a chunk sends on three changes of the mark at most, a whole trace none."""
    rng = np.random.default_rng(13)
    traces = {k: rng.normal(size=n) * np.where(np.arange(n) // 23 % 3 == 0, 3, 1) for k, n in (("a", 500), ("b", 64), ("c", 7), ("d", 130))}
    s = spark.createDataFrame([(k, i, float(v)) for k, x in traces.items() for i, v in enumerate(x)], "k string, i long, v double")
    truth = spark.createDataFrame([("a", 24.0), ("b", 2.0), ("c", 1.0), ("none", 1.0)], "k string, t double")
    settings = [{"setting": j, "axis": "all", "varied": float(j), "n_sta": a, "n_lta": b, "on": on} for j, (a, b, on) in enumerate([(2, 10, 1.2), (3, 30, 1.5), (1, 5, 2.0), (3, 10, 99.0)])]
    seen = []
    session.WATCHERS.append(lambda df: "_mark" in df.columns and seen.append(df))
    try:
        got = {r.setting: r for r in E.sweep(s, truth, ["k"], 10.0, settings, min_dur=0.2, tol=1.0, with_auc=False, chunk=chunk).collect()}
    finally:
        session.WATCHERS.pop()
    largest = seen[0].agg(F.max(F.size("_i"))).first()[0]
    assert largest <= (3 if chunk < 500 else 0)
    for one in settings:
        det = trigger(sta_lta(s, ["k"], one["n_sta"], one["n_lta"]), ["k"], one["on"], one["on"] / 2, 2)
        hit, found = match_detections(to_seconds(det, 10.0), truth, ["k"], 1.0)
        want, r = E.trigger_quality(hit, found).first(), got[one["setting"]]
        assert [r[c] for c in ("n_alarms", "n_hits", "n_truth", "n_found")] == [want[c] for c in ("n_alarms", "n_hits", "n_truth", "n_found")]


def test_split_arithmetic(spark):
    for n, fractions, names, want in ((489, S.FRACTIONS, S.NAMES, [342, 73, 74]), (1590, (0.2, 0.8), ("val", "test"), [318, 1272]),
                                      (2, S.FRACTIONS, S.NAMES, [1, 0, 1]), (30, (0.2, 0.8), ("val", "test"), [6, 24])):
        got = {r["split"]: r["count"] for r in S.split_ordered(spark.range(n), ["id"], fractions, names).groupBy("split").count().collect()}
        assert [got.get(k, 0) for k in names] == want


def test_group_split_keeps_groups_together(spark):
    df = spark.range(3000).withColumn("sta", F.when(F.col("id") < 1500, F.lit(0)).otherwise(F.col("id") % 40))
    out = S.split_group(df, "sta")
    assert out.count() == 3000 and out.select("sta", "split").distinct().count() == 40
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("sta").alias("n")).collect()}
    assert sizes == {"train": 28, "val": 6, "test": 6}
    again = S.split_group(df.repartition(7), "sta").groupBy("sta").agg(F.first("split").alias("s"))
    assert again.join(out.select("sta", "split").distinct(), "sta").where("s <> split").count() == 0


def test_ks_against_direct_computation(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=300), rng.normal(0.25, 1, 200)
    mk = lambda v: spark.createDataFrame([(float(x),) for x in np.round(v, 2)], "err double")
    r = ks_two_sample(mk(a), mk(b)).first()
    a, b = np.round(a, 2), np.round(b, 2)
    pts = np.unique(np.r_[a, b])
    d = np.abs(np.searchsorted(np.sort(a), pts, "right") / 300 - np.searchsorted(np.sort(b), pts, "right") / 200).max()
    x = d * np.sqrt(300 * 200 / 500)
    p = 2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * x * x) for j in range(1, 101))
    assert r["d"] == pytest.approx(d) and r["p"] == pytest.approx(p) and r["drift"] == (p < 0.05)
    same = ks_two_sample(mk(a), mk(a)).first()
    assert same["d"] == 0 and same["p"] == 1.0 and not same["drift"]


def test_histogram_and_box(spark):
    rng = np.random.default_rng(10)
    x = np.r_[rng.normal(size=500), 40.0]
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("flat", 3.0)] * 4, "k string, v double")
    h = histogram(df, "v", 12, ["k"]).where("k = 'a'").orderBy("bin").toPandas()
    count, edges = np.histogram(x, 12)
    density, _ = np.histogram(x, 12, density=True)
    np.testing.assert_array_equal(h["count"], count[count > 0])
    np.testing.assert_allclose(h.density, density[count > 0])
    b = box_stats(df, "v", ["k"]).where("k = 'a'").first()
    q1, q3 = np.percentile(x, [25, 75])
    assert b["q1"] == pytest.approx(q1) and b["whisker_high"] == x[x <= q3 + 1.5 * (q3 - q1)].max()
    assert b["n_outside"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()


def test_order_statistics_with_one_very_common_value(spark):
    """80 % of the rows are one value: exact, and only a small part of the rows is ranked."""
    rng = np.random.default_rng(8)
    v = np.where(rng.random(60_000) < 0.8, 0.0, rng.exponential(size=60_000))
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(60_000) % 2, "v": v})).repartition(8)
    names = {"a": 0.0, "b": 0.25, "c": 0.8, "d": 0.95, "e": 0.9999, "f": 1.0}
    for k, r in {r.k: r for r in order_statistics(df, ["k"], "v", names).collect()}.items():
        np.testing.assert_allclose([r[n] for n in names], [np.percentile(v[k::2], 100 * q) for q in names.values()], rtol=1e-12)
    r = order_statistics(df, [], "v", {"m": 0.5, "q": 0.97}, rule="upper").first()
    assert (r.m, r.q) == (0.0, np.sort(v)[int(60_000 * 0.97)])
    few = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 2.0), (3, None)], "k int, v double")
    got = {r.k: r.m for r in order_statistics(few, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {1: 5.0, 2: 1.5}
