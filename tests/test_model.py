import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import evaluate as E
from tracewell.operators import model as M
from tracewell.plans import jobs
from tracewell.sources import tables

RNG = np.random.default_rng(12)
BASIS = RNG.normal(size=(3, 16))


def normal(n):
    return RNG.normal(size=(n, 3)) @ BASIS + 0.05 * RNG.normal(size=(n, 16)) + 1.0


@pytest.fixture(scope="module")
def windows(spark):
    x = np.vstack([normal(300), 3 * RNG.normal(size=(40, 16))])
    rows = [(j, [float(v) for v in r], int(j >= 300), "train" if j < 200 else "val") for j, r in enumerate(x)]
    return spark.createDataFrame(rows, "window_id int, x array<double>, label int, split string").repartition(4)


def test_pca_equals_numpy(spark, windows, tmp_path):
    fit_on = windows.where("label = 0")
    model = M.fit_pca(fit_on, 3)
    x = np.array([r.x for r in fit_on.collect()])
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    got = model.errors(windows).toPandas()
    everything = np.array(got.x.tolist())
    want = (((everything - mean) - (everything - mean) @ vt[:3].T @ vt[:3]) ** 2).mean(axis=1)
    np.testing.assert_allclose(got.err, want, rtol=1e-6)
    again = M.reconstruction_error(model.reconstruct(windows)).toPandas()
    np.testing.assert_allclose(again.err, got.err, rtol=1e-9)
    model.save(spark, str(tmp_path / "m"))
    back = M.LinearModel.load(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(back.errors(windows).toPandas().err, got.err, rtol=1e-12)
    assert len(model.encode(windows).first()["code"]) == 3
    auc = E.auc(E.curve(model.errors(windows), [], "err")).first()["auc"]
    assert auc > 0.99


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    shapes = [(5, 3), (3, 5)]
    flat = rng.normal(size=5 * 3 + 3 + 3 * 5 + 5)
    x = rng.normal(size=(7, 5))
    for out in ("linear", "tanh"):
        loss = lambda f: float(((M._forward(*M._unflatten(f, shapes), x, out)[-1] - x) ** 2).mean(axis=1).sum())
        g, value = M._gradient(*M._unflatten(flat, shapes), x, out, None)
        assert value == pytest.approx(loss(flat))
        for j in range(0, len(flat), 3):
            step = np.zeros_like(flat)
            step[j] = 1e-6
            assert g[j] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-4)


def test_dense_training_lowers_the_loss(spark, windows, tmp_path):
    train, val = windows.where("label = 0 AND split = 'train'"), windows.where("label = 0 AND split = 'val'")
    model = M.fit_dense_ae(train, val, (16, 8, 3), epochs=12, lr=0.02, batch=64)
    losses = [h["val_loss"] for h in model.history]
    assert min(losses) < 0.6 * losses[0]
    assert model.n_params() == 16 * 8 + 8 + 8 * 3 + 3 + 3 * 8 + 8 + 8 * 16 + 16
    # the kept weights are those of the best epoch
    best = model.errors(val).agg(F.avg("err")).first()[0]
    assert best == pytest.approx(min(losses), rel=1e-9)
    assert len(model.encode(val).first()["code"]) == 3
    again = M.reconstruction_error(model.reconstruct(val)).agg(F.avg("err")).first()[0]
    assert again == pytest.approx(best, rel=1e-9)
    model.save(spark, str(tmp_path / "d"))
    assert M.DenseModel.load(spark, str(tmp_path / "d")).errors(val).agg(F.avg("err")).first()[0] == pytest.approx(best, rel=1e-12)
    assert E.learning_curve(spark.createDataFrame(model.history)).first()["best_epoch"] == int(np.argmin(losses)) + 1


def test_steps_do_not_depend_on_partitions(spark, windows, monkeypatch):
    calls, real = [], M._summed_gradients
    monkeypatch.setattr(M, "_summed_gradients", lambda *a: calls.append(1) or real(*a))
    train = windows.where("label = 0 AND split = 'train'")
    fits = []
    for parts in (2, 8):
        calls.clear()
        fits.append((M.fit_dense_ae(train.repartition(parts), train, (16, 8, 3), epochs=2, lr=0.02, batch=50), len(calls)))
    assert fits[0][1] == fits[1][1] == 2 * 4
    for a, b in zip(fits[0][0].weights, fits[1][0].weights):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("dropout", [0.0, 0.2])
def test_many_small_steps_share_jobs(spark, windows, monkeypatch, dropout):
    """The weights are those of one job a step, whether a step is small, empty or larger than a task takes."""
    train = windows.where("label = 0").select("window_id", "x")
    copies = windows.where("window_id = 7").select("window_id", "x").withColumn("x", F.explode(F.array_repeat("x", 60)))
    train = train.unionByName(copies)  # one step with 60 equal rows

    def fit(group):
        spark.sparkContext.setJobGroup(group, group)
        model = M.fit_dense_ae(train, windows, (16, 8, 3), epochs=2, lr=0.02, steps=40, dropout=dropout)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    monkeypatch.setattr(M, "FILE_ROWS", 50)
    shared, few = fit(f"shared {dropout}")
    monkeypatch.setattr(M, "EPOCH_JOBS", 40)
    alone, many = fit(f"alone {dropout}")
    assert few < 40 < 80 <= many
    if not dropout:  # the masks of a step lie on its rows in any order
        for a, b in zip([*shared.weights, *shared.biases], [*alone.weights, *alone.biases]):
            np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)
    assert [h["val_loss"] for h in shared.history] == pytest.approx([h["val_loss"] for h in alone.history], rel=0.2 if dropout else 1e-9)


def test_search_with_pruning(spark, windows, monkeypatch):
    """Fifty trials take the jobs of one fit, the survivor is what it would be alone, failures are null."""
    calls, real = [], M._summed_gradients
    monkeypatch.setattr(M, "_summed_gradients", lambda *a: calls.append(len(a[1])) or real(*a))
    train, val = windows.where("label = 0 AND split = 'train'"), windows.where("label = 0 AND split = 'val'")
    rates = np.random.default_rng(3).permutation(np.geomspace(1e-5, 0.05, 47))
    options = [{"layers": (16, 8, 3), "lr": float(r), "dropout": 0.1 * (k % 2)} for k, r in enumerate(rates)]
    options += [{"layers": (15, 3), "lr": 0.01}, {"layers": (16, 4), "lr": 1e200}, {"layers": (16, 6, 2), "lr": 0.02, "out": "tanh"}]
    table, best = M.search_dense(train, val, options, epochs=6, rungs=(1, 2, 4), keep=0.25, batch=100)
    pdf = table.toPandas().sort_values("trial")
    assert len(pdf) == 50 and pdf.status.iloc[47] == pdf.status.iloc[48] == "failed" and pdf.val_loss[pdf.status == "failed"].isna().all()
    done = pdf[pdf.status == "done"]
    assert len(done) == 1 and done.epochs.iloc[0] == 6 and set(pdf.epochs[pdf.status == "pruned"]) == {1, 2, 4}
    assert calls[0] == 49 and calls[-1] == 1 and len(calls) <= 6 * 3
    option = options[int(done.trial.iloc[0])]
    alone = M.fit_dense_ae(train, val, epochs=6, batch=100, **option)
    assert alone.history[-1]["val_loss"] == pytest.approx(best.history[-1]["val_loss"], rel=1e-6)
    for a, b in zip(alone.weights, best.weights):
        np.testing.assert_allclose(a, b, rtol=1e-5, atol=1e-8)
    # weights that don't fit one broadcast travel in several, with the same result
    monkeypatch.setattr(M, "TOGETHER", 600)
    again, _ = M.search_dense(train, val, options[:4], epochs=2, rungs=(), batch=100)
    assert [h for h in again.toPandas().val_loss] == pytest.approx([min(M.fit_dense_ae(train, val, epochs=2, batch=100, **o).history, key=lambda h: h["val_loss"])["val_loss"] for o in options[:4]], rel=1e-6)


def test_search_excludes_failed_fits(spark, windows):
    out = M.search(windows.where("split = 'train'"), windows.where("split = 'val'"), [3, 99], [95.0, 99.0]).toPandas()
    assert len(out) == 4 and out[out.k == 99].f1.isna().all() and out[out.k == 3].f1.min() > 0.8
    model = M.fit_pca(windows.where("label = 0 AND split = 'train'"), 3)
    err = model.errors(windows.where("label = 0 AND split = 'train'")).toPandas().err
    assert out[(out.k == 3) & (out.percentile == 95)].thr.iloc[0] == pytest.approx(np.percentile(err, 95))


def test_refit_switches_only_on_drift(spark, windows):
    ref = windows.where("label = 0 AND split = 'train'")
    now = M.fit_pca(ref, 3)
    same, record = jobs.refit_if_drift(now, ref, ref, windows, 3)
    assert same is now and not record["drift"]
    moved = ref.withColumn("x", F.transform("x", lambda e: e * 2 + 5))
    _, record = jobs.refit_if_drift(now, ref, moved, windows, 3)
    assert record["drift"] and "ap_after" in record


def test_detect_flags_the_loud_windows(spark):
    x = RNG.normal(size=1000)
    s = spark.createDataFrame(pd.DataFrame({"t": "a", "i": np.arange(1000), "v": x}))
    model = M.LinearModel(np.zeros(50), np.zeros((50, 1)))
    out = jobs.detect(s, model, ["t"], 50, 25, 0.5, 10.0).orderBy("k").collect()
    assert len(out) == 39 and all(r.pred == 1 and r.err == pytest.approx(1.0) for r in out)  # z-scores against nothing
    assert (out[3].t_start, out[3].t_end) == (7.5, 12.5)


def test_result_record_keeps_empty_fields(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, None)], "f1 double, tamanho_kb double")
    tables.write_json(jobs.result_record("STA/LTA", {"sta_seg": 0.5}, metrics), str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).first()[0]
    assert '"tamanho_kb":null' in text
    back = tables.read_records(spark, str(tmp_path / "r")).first()
    assert back.metodo == "STA/LTA" and back.parametros == {"sta_seg": 0.5} and back.auc is None
