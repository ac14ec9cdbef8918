"""Reconstruction models trained on normal windows, and their errors.

The linear model is a PCA (the optimum of a linear autoencoder); the dense
autoencoder is trained by summing gradients over partitions.  A model is a few
weight arrays whose size depends on the window length, never on the data.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.evaluate import average_precision, curve, flag, prf, confusion
from tracewell.operators.ordered import attach_facts, order_statistics
from tracewell.operators.windows import evaluated
from tracewell.session import cut_lineage

FILE_ROWS = 1 << 14  # rows of a step, or of a run of steps, that one task reads
RUN_STEPS = 1 << 8  # steps of a run at most
EPOCH_JOBS = 1 << 4  # an epoch of so few steps takes a job for each of them
SLOT = 4096  # gradient entries per row when partitions hand in their sums


def reconstruction_error(windows: DataFrame, x: str = "x", recon: str = "recon", name: str = "err") -> DataFrame:
    """Mean squared difference between a window and its reconstruction."""
    squares = F.zip_with(F.col(x), F.col(recon), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return windows.withColumn(name, F.aggregate(squares, F.lit(0.0), lambda a, e: a + e) / F.size(x))


def mean_waveform(windows: DataFrame, x: str = "x") -> DataFrame:
    """The simplest model table: the average value per position of normal windows."""
    return windows.select(F.posexplode(x).alias("pos", "_v")).groupBy("pos").agg(F.avg(F.col("_v").cast("double")).alias("recon"))


def error_against_table(windows: DataFrame, model: DataFrame, ids: Sequence[str], x: str = "x", name: str = "err") -> DataFrame:
    """Error of every window against a model table (pos, recon): one row per position, so it is
    small by construction (window length) and collected into one array for the join."""
    packed = model.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "recon"))), lambda e: e["recon"]).alias("_recon"))
    joined = attach_facts(windows, packed, [])
    return reconstruction_error(joined, x, "_recon", name).drop("_recon")


@dataclass
class LinearModel:
    """x is approximated by mean + C C' (x - mean)."""

    mean: np.ndarray
    components: np.ndarray  # (window length, k)
    stage: PCAModel | None = field(default=None, repr=False)

    def encode(self, windows: DataFrame, x: str = "x", name: str = "code") -> DataFrame:
        mean, c = self.mean, self.components
        return _applied(windows, name, _rows(lambda m: (m - mean) @ c), x)

    def reconstruct(self, windows: DataFrame, x: str = "x", name: str = "recon") -> DataFrame:
        mean, c = self.mean, self.components
        return _applied(windows, name, _rows(lambda m: mean + ((m - mean) @ c) @ c.T), x)

    def errors(self, windows: DataFrame, x: str = "x", name: str = "err") -> DataFrame:
        mean, c = self.mean, self.components
        return _applied(windows, name, _scores(lambda m: mean + ((m - mean) @ c) @ c.T), x)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(self.mean[i]), [float(v) for v in self.components[i]]) for i in range(len(self.mean))]
        spark.createDataFrame(rows, "pos int, mean double, components array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        rows = spark.read.parquet(path).orderBy("pos").collect()  # one row per window position
        return LinearModel(np.array([r["mean"] for r in rows]), np.array([r["components"] for r in rows]))


def _applied(windows, name, udf, x):
    return evaluated(windows, name, udf, F.col(x).cast("array<double>"))


def _rows(fn):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(fn(np.stack(x.to_numpy()).astype(float))), index=x.index) if len(x) else x

    return run


def _scores(fn):
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            if len(x) == 0:
                yield pd.Series([], dtype=float)
                continue
            m = np.stack(x.to_numpy()).astype(float)
            yield pd.Series(((m - fn(m)) ** 2).mean(axis=1), index=x.index)

    return run


def fit_pca(normal: DataFrame, k: int, x: str = "x") -> LinearModel:
    """Fit on normal windows only."""
    vectors = normal.select(array_to_vector(F.col(x).cast("array<double>")).alias("features"))
    stage = PCA(k=k, inputCol="features", outputCol="code").fit(vectors)
    mean = vectors.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    return LinearModel(mean, stage.pc.toArray(), stage)


@dataclass
class DenseModel:
    """Fully connected mirror network; ReLU inside, linear or tanh at the end."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    out: str = "linear"
    history: list[dict] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.weights, self.biases, x, self.out)[-1]

    def encode(self, windows: DataFrame, x: str = "x", name: str = "code") -> DataFrame:
        """The values of the narrowest layer."""
        w, b, half = self.weights, self.biases, len(self.weights) // 2
        return _applied(windows, name, _rows(lambda m: _forward(w, b, m, "linear")[half]), x)

    def reconstruct(self, windows: DataFrame, x: str = "x", name: str = "recon") -> DataFrame:
        w, b, out = self.weights, self.biases, self.out
        return _applied(windows, name, _rows(lambda m: _forward(w, b, m, out)[-1]), x)

    def errors(self, windows: DataFrame, x: str = "x", name: str = "err") -> DataFrame:
        w, b, out = self.weights, self.biases, self.out
        return _applied(windows, name, _scores(lambda m: _forward(w, b, m, out)[-1]), x)

    def n_params(self) -> int:
        return int(sum(w.size for w in self.weights) + sum(b.size for b in self.biases))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, list(w.shape), w.ravel().tolist(), b.tolist(), self.out) for i, (w, b) in enumerate(zip(self.weights, self.biases))]
        spark.createDataFrame(rows, "layer int, shape array<int>, w array<double>, b array<double>, out string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DenseModel":
        rows = spark.read.parquet(path).orderBy("layer").collect()  # one row per layer
        return DenseModel([np.array(r["w"]).reshape(r["shape"]) for r in rows], [np.array(r["b"]) for r in rows], rows[0]["out"])


def _forward(weights, biases, x, out, masks=None):
    acts = [x]
    for i, (w, b) in enumerate(zip(weights, biases)):
        z = acts[-1] @ w + b
        last = i == len(weights) - 1
        a = np.tanh(z) if last and out == "tanh" else z if last else np.maximum(z, 0)
        if masks is not None and not last:
            a = a * masks[i]
        acts.append(a)
    return acts


def _gradient(weights, biases, x, out, masks):
    """Sum over rows of the gradient of the mean squared error, flattened, and the summed loss."""
    acts = _forward(weights, biases, x, out, masks)
    diff = acts[-1] - x
    delta = 2 * diff / x.shape[1]
    if out == "tanh":
        delta = delta * (1 - acts[-1] ** 2)
    grads = []
    for i in reversed(range(len(weights))):
        grads.append(delta.sum(axis=0))
        grads.append((acts[i].T @ delta).ravel())
        if i:
            delta = (delta @ weights[i].T) * (acts[i] > 0)
            if masks is not None:
                delta = delta * masks[i - 1]
    return np.concatenate(grads[::-1]), float((diff**2).mean(axis=1).sum())


def _unflatten(flat, shapes):
    weights, biases, at = [], [], 0
    for a, b in shapes:
        weights.append(flat[at:at + a * b].reshape(a, b))
        at += a * b
        biases.append(flat[at:at + b])
        at += b
    return weights, biases


def fit_dense_ae(train: DataFrame, val: DataFrame, layers: Sequence[int] = (400, 256, 128, 64, 32), epochs: int = 50,
                 lr: float = 1e-3, batch: int = 512, steps: int | None = None, patience: int = 10, plateau: int = 7,
                 dropout: float = 0.0, out: str = "linear", seed: int = 42, x: str = "x") -> DenseModel:
    """Data-parallel training with Adam.

    An epoch has ``steps`` optimizer steps, or as many as give ``batch`` rows a step;
    neither depends on the size of the cluster.  The rows are hashed once into
    steps and written by step, so that a step reads only its own rows and an epoch
    reads each row once.  A step of more than ``FILE_ROWS`` rows, or of a short epoch,
    is a job: the weights go out, partitions return gradient sums in slots of ``SLOT``
    numbers, and Spark adds the slots up.  Where an epoch has many small steps, they
    follow one another in a task that reads up to ``FILE_ROWS`` rows, and the weights
    come back after the last.  A step needs the weights of the one before, so many
    small steps gain nothing from more machines;
    with many rows give ``steps``.  What reaches the driver is one gradient or one
    set of weights, whatever the number of rows.

    Training stops early after ``patience`` epochs without a better validation loss,
    the rate is halved every ``plateau`` such epochs, and the best weights are kept.
    """
    trial = Trial(layers, lr, dropout, out, seed, plateau, patience)
    train_trials([trial], train, val, epochs, batch, steps, seed, x)
    return trial.model()


class Trial:
    """One dense autoencoder in training: its weights, Adam's state and its course so far."""

    def __init__(self, layers: Sequence[int], lr: float = 1e-3, dropout: float = 0.0, out: str = "linear", seed: int = 42,
                 plateau: int = 7, patience: int = 10):
        sizes = [*layers, *reversed(layers[:-1])]
        rng = np.random.default_rng(seed)
        self.shapes = list(zip(sizes[:-1], sizes[1:]))
        weights = [rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) for s in self.shapes]
        self.flat = np.concatenate([v for w in weights for v in (w.ravel(), np.zeros(w.shape[1]))])
        self.layers, self.lr, self.dropout, self.out, self.seed, self.plateau, self.patience = list(layers), lr, dropout, out, seed, plateau, patience
        self.m1, self.m2, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.best, self.best_loss, self.since, self.loss, self.history = self.flat.copy(), np.inf, 0, 0.0, []
        self.status = "live"  # live, done (early or by the last epoch), pruned, failed

    def step(self, g: np.ndarray, loss: float, count: int) -> None:
        self.loss += loss
        self.t += 1
        g = g / count
        with np.errstate(all="ignore"):  # a trial that fails is found out by its loss
            self.m1 = 0.9 * self.m1 + 0.1 * g
            self.m2 = 0.999 * self.m2 + 0.001 * g * g
            self.flat = self.flat - self.lr * (self.m1 / (1 - 0.9**self.t)) / (np.sqrt(self.m2 / (1 - 0.999**self.t)) + 1e-8)

    def end_epoch(self, epoch: int, n: int, val_loss: float) -> None:
        self.history.append({"epoch": epoch, "loss": self.loss / max(n, 1), "val_loss": float(val_loss), "lr": self.lr})
        self.loss = 0.0
        if not np.isfinite(val_loss):
            self.status = "failed"
        elif val_loss < self.best_loss:
            self.best, self.best_loss, self.since = self.flat.copy(), val_loss, 0
        else:
            self.since += 1
            if self.since % self.plateau == 0:
                self.lr /= 2
            if self.since >= self.patience:
                self.status = "done"

    def state(self) -> Trial:
        """A copy with what a step needs."""
        t = copy.copy(self)
        t.best, t.history = None, []
        return t

    def model(self) -> DenseModel:
        return DenseModel(*_unflatten(self.best, self.shapes), self.out, self.history)


TOGETHER = 1 << 24  # weights that travel in one broadcast


def _parties(trials: Sequence[Trial], numbers: int = 1) -> list[list[Trial]]:
    """Live trials in groups whose weights, with ``numbers`` sent for each, fit one broadcast."""
    out, size = [[]], 0
    for t in trials:
        if out[-1] and size + numbers * t.flat.size > TOGETHER:
            out.append([])
            size = 0
        out[-1].append(t)
        size += numbers * t.flat.size
    return out


def _runs(steps: Iterable[int], sizes: dict[int, int]) -> Iterator[list[int]]:
    """The steps in order, those that follow one another together while one task can read them."""
    run, rows = [], 0
    for step in steps:
        if run and (rows + sizes.get(step, 0) > FILE_ROWS or len(run) == RUN_STEPS):
            yield run
            run, rows = [], 0
        run.append(step)
        rows += sizes.get(step, 0)
    if run:
        yield run


def train_trials(trials: Sequence[Trial], train: DataFrame, val: DataFrame, epochs: int, batch: int = 512, steps: int | None = None,
                 seed: int = 42, x: str = "x", rungs: Sequence[int] = (), keep: float = 0.5) -> None:
    """Train several networks side by side: each step, or run of small steps, is one job for all that are live.

    Their weights travel in one broadcast, a task computes the gradients of all of
    them from the rows it has read once, and Spark adds the slots up by trial; the
    task of a run takes the steps itself.  After
    the epochs in ``rungs`` only the best ``keep`` of the live trials, by their best
    validation loss, go on; the others are pruned.  A trial whose loss is no longer
    finite has failed.  A trial takes the same course as it would alone.
    """
    order = np.random.default_rng([seed, 1])
    # the hash covers all columns: with an id, copies of one window are spread too
    rows = train.select(F.col(x).cast("array<double>").alias("x"), F.xxhash64(*train.columns).alias("_h"))
    held = cut_lineage(val.select(F.col(x).cast("array<double>").alias("x")))
    n = rows.count()
    steps = steps or max(1, round(n / batch))
    hashed = rows.withColumn("_step", F.pmod("_h", F.lit(steps)).cast("int"))
    # files of a bounded number of rows, as many per step as it has rows for
    files = max(1, -(-n // (steps * FILE_ROWS)))
    spread = hashed.withColumn("_file", F.pmod(F.shiftright("_h", 20), F.lit(files)))
    table = cut_lineage(spread.repartition("_step", "_file").drop("_h", "_file"), partition_by=["_step"])
    # one small row per step
    sizes = {r["_step"]: r["count"] for r in table.groupBy("_step").count().collect()}
    for epoch in range(1, epochs + 1):
        turns = order.permutation(steps).tolist()
        for run in _runs(turns, sizes) if steps > EPOCH_JOBS else ([step] for step in turns):
            rows_now = table.where(F.col("_step").isin(run))
            if steps > EPOCH_JOBS and sum(sizes.get(step, 0) for step in run) <= FILE_ROWS:
                for party in _parties([t for t in trials if t.status == "live"], 3):
                    _take_steps(rows_now, party, epoch, run)
                continue
            for party in _parties([t for t in trials if t.status == "live"]):
                for t, (g, loss, count) in zip(party, _summed_gradients(rows_now, party, _turn(epoch, run[0])), strict=True):
                    if count:
                        t.step(g, loss, count)
        for party in _parties([t for t in trials if t.status == "live"]):
            for t, loss in zip(party, _mean_errors(held, party), strict=True):
                t.end_epoch(epoch, n, loss)
        live = sorted((t for t in trials if t.status == "live"), key=lambda t: t.best_loss)
        if epoch in rungs:
            for t in live[max(1, math.ceil(len(live) * keep)) :]:
                t.status = "pruned"
        if not any(t.status == "live" for t in trials):
            break
    for t in trials:
        if t.status == "live":
            t.status = "done"


def _turn(epoch: int, step: int) -> int:
    return epoch * 1000 + step


def _network(t: Trial) -> tuple:
    return t.flat, t.shapes, t.out, t.dropout, t.seed


def _sent(rows: DataFrame, party: Sequence[Trial]):
    return rows.sparkSession.sparkContext.broadcast([_network(t) for t in party])


class _Gradients:
    """What one task adds up of a step: for every network the gradient and the loss of its rows."""

    def __init__(self, networks: Sequence[tuple], turn: int):
        self.networks = [(*_unflatten(flat, shapes), shapes, out, dropout) for flat, shapes, out, dropout, _ in networks]
        # other masks in every partition
        self.draws = [np.random.default_rng([seed + turn, TaskContext.get().partitionId()]) for *_, seed in networks]
        self.sums, self.count = [None] * len(networks), 0

    def add(self, m: np.ndarray) -> None:
        self.count += len(m)
        for k, (weights, biases, shapes, out, dropout) in enumerate(self.networks):
            masks = [(self.draws[k].random((len(m), b)) >= dropout) / (1 - dropout) for _, b in shapes[:-1]] if dropout else None
            with np.errstate(all="ignore"):
                g, loss = _gradient(weights, biases, m, out, masks)
            self.sums[k] = (g, loss) if self.sums[k] is None else (self.sums[k][0] + g, self.sums[k][1] + loss)


def _slots(trial: int, head: Sequence[float], flat: np.ndarray) -> pd.DataFrame:
    cut = [flat[i:i + SLOT] for i in range(0, len(flat), SLOT)]
    return pd.DataFrame({"trial": trial, "slot": range(-1, len(cut)), "g": [np.array(head), *cut]})


SLOTS = "trial int, slot int, g array<double>"


def _take_steps(rows: DataFrame, party: Sequence[Trial], epoch: int, steps: Sequence[int]) -> None:
    """Let the trials take small steps one after the other, in one task that reads the rows of all of them.

    The task sorts the rows by the place of their step and holds the gradient sums of
    one step.  The trials' weights and Adam's state go out and come back once.
    """
    sent = rows.sparkSession.sparkContext.broadcast([t.state() for t in party])

    def run(batches):
        trials, place, sums = [t.state() for t in sent.value], None, None

        def take():
            for t, (g, loss) in zip(trials, sums.sums, strict=True):
                t.step(g, loss, sums.count)

        for pdf in batches:
            if len(pdf) == 0:
                continue
            at, m = pdf["_at"].to_numpy(), np.stack(pdf["x"].to_numpy()).astype(float)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                if at[part[0]] != place:
                    if sums:
                        take()
                    place = at[part[0]]
                    sums = _Gradients([_network(t) for t in trials], _turn(epoch, steps[place - 1]))
                sums.add(m[part])
        if sums:
            take()
            for k, t in enumerate(trials):
                yield _slots(k, [t.loss, float(t.t)], np.concatenate([t.flat, t.m1, t.m2]))

    place = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("_step")).cast("int")
    ordered = rows.select("x", place.alias("_at")).coalesce(1).sortWithinPartitions("_at")
    found = ordered.mapInPandas(run, SLOTS).toArrow().sort_by([("trial", "ascending"), ("slot", "ascending")])
    sent.unpersist()
    for k, t in enumerate(party):
        g = found.filter(pc.field("trial") == k).column("g").combine_chunks()
        if len(g):
            values = g.flatten().to_numpy(zero_copy_only=False)  # null is NaN again
            t.loss, t.t = float(values[0]), int(values[1])
            t.flat, t.m1, t.m2 = (v.copy() for v in np.split(values[2:], 3))


def _mean_errors(held: DataFrame, party: Sequence[Trial]) -> list[float]:
    """The mean reconstruction error of every trial, from one pass over the rows."""
    sent = _sent(held, party)

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["x"].to_numpy()).astype(float)
                with np.errstate(all="ignore"):
                    errors = [((_forward(*_unflatten(flat, shapes), m, out)[-1] - m) ** 2).mean(axis=1).sum() for flat, shapes, out, _, _ in sent.value]
                yield pd.DataFrame({"trial": range(len(errors)), "err": errors, "n": len(m)})

    sums = held.mapInPandas(partial, "trial int, err double, n long").groupBy("trial").agg((F.sum("err") / F.sum("n")).alias("loss")).collect()
    sent.unpersist()
    found = {r["trial"]: r["loss"] for r in sums if r["loss"] is not None}  # NaN comes back as null
    return [found.get(k, float("nan")) for k in range(len(party))]


def _summed_gradients(rows: DataFrame, party: Sequence[Trial], turn: int) -> list[tuple[np.ndarray | None, float, int]]:
    """(gradient sum, loss sum, rows) of every trial over the rows."""
    sent = _sent(rows, party)

    def partial(batches):
        sums = _Gradients(sent.value, turn)
        for pdf in batches:
            if len(pdf):
                sums.add(np.stack(pdf["x"].to_numpy()).astype(float))
        for k, both in enumerate(sums.sums):
            if both is not None:
                yield _slots(k, [both[1], float(sums.count)], both[0])

    def add(pdf):
        return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "slot": [pdf["slot"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]})

    # one row per partition and slot meets here: partitions * SLOT numbers at most
    summed = rows.select("x").mapInPandas(partial, SLOTS).groupBy("trial", "slot").applyInPandas(add, SLOTS).orderBy("trial", "slot").collect()
    sent.unpersist()
    found = {k: [r["g"] for r in summed if r["trial"] == k] for k in range(len(party))}
    return [(np.concatenate([np.asarray(g, float) for g in f[1:]]), float("nan") if f[0][0] is None else f[0][0], int(f[0][1])) if f else (None, 0.0, 0) for f in found.values()]


def search_dense(train: DataFrame, val: DataFrame, options: Sequence[dict], epochs: int = 50, rungs: Sequence[int] = (2, 5, 12, 25),
                 keep: float = 0.5, batch: int = 512, steps: int | None = None, seed: int = 42, x: str = "x") -> tuple[DataFrame, DenseModel | None]:
    """Search over dense autoencoders with pruning: all trials start, after each rung the better ones go on.

    ``options``: arguments of ``Trial`` (layers, lr, dropout, out, seed, ...), one
    dict per trial.  Returns (trial, status, epochs, val_loss) and the best model.
    Every step is one job for all live trials, so the number of jobs is that of one
    fit.  A trial that fails, also one whose first layer isn't as wide as the
    windows, has a null loss and is never chosen; the others go on.
    """
    width = train.select(F.size(x).alias("n")).first()
    trials = [Trial(**{"seed": seed, **o}) for o in options]
    for t in trials:
        if width is None or t.layers[0] != width["n"]:
            t.status = "failed"
    if any(t.status == "live" for t in trials):
        train_trials(trials, train, val, epochs, batch, steps, seed, x, rungs, keep)
    rows = [(k, t.status, len(t.history), float(t.best_loss) if t.status != "failed" else None) for k, t in enumerate(trials)]
    done = [t for t in trials if t.status == "done" and np.isfinite(t.best_loss)]
    best = min(done, key=lambda t: t.best_loss).model() if done else None
    return train.sparkSession.createDataFrame(rows, "trial int, status string, epochs int, val_loss double"), best


def search(train: DataFrame, val: DataFrame, ks: Sequence[int], percentiles: Sequence[float], metric: str = "f1",
           label: str = "label", ids: Sequence[str] = ("window_id",), x: str = "x") -> DataFrame:
    """Grid over the number of components and the threshold percentile.

    One fit per k; all percentiles of a k are read from one ranking of the training
    errors.  A fit that fails gives null metrics and is never chosen.
    """
    spark = train.sparkSession
    out = None
    normal = train.where(F.col(label) == 0)
    for k in ks:
        grid = [(int(k), float(p)) for p in percentiles]
        try:
            model = fit_pca(normal, k, x)
        except IllegalArgumentException:  # k doesn't fit the windows; all else is a failure of the job
            part = spark.createDataFrame([(*g, None, None, None, None, None) for g in grid],
                                         "k int, percentile double, precision double, recall double, f1 double, ap double, thr double")
        else:
            part = _scored_grid(model, normal, val, k, percentiles, label, ids, x)
        out = part if out is None else out.unionByName(part)
    return out


def _scored_grid(model, normal, val, k, percentiles, label, ids, x):
    names = {f"p{j}": p / 100 for j, p in enumerate(percentiles)}
    train_err = model.errors(normal.select(x), x).select("err")
    limits = order_statistics(train_err, [], "err", names)
    options = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(f"p{j}").alias("thr")) for j, p in enumerate(percentiles)])
    val_err = model.errors(val.select(*ids, x, label), x).select(*ids, "err", label)
    rows = attach_facts(val_err, limits.select(options.alias("_o")), []).withColumn("_o", F.explode("_o"))
    rows = rows.select("err", label, "_o.percentile", "_o.thr")
    cells = prf(confusion(flag(rows, F.col("thr")), ["percentile", "thr"], label=label))
    ap = average_precision(curve(val_err, [], "err", label))
    with_ap = attach_facts(cells, ap, [], salts=1)
    return with_ap.select(F.lit(int(k)).alias("k"), "percentile", "precision", "recall", "f1", "ap", "thr")
