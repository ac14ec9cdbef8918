"""Whole jobs composed from operators; each is one lazy plan unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import conditioning, evaluate, joins, model, select, splits, trigger, variance, windows
from tracewell.operators.drift import ks_two_sample
from tracewell.operators.intervals import detections_hit
from tracewell.operators.ordered import CHUNK, attach_facts, join_facts
from tracewell.session import cut_lineage


def trigger_report(samples: DataFrame, truth: DataFrame, key: Sequence[str], n_sta: int, n_lta: int, on: float, off: float,
                   min_n: int, tol: float, sr: float = 1.0, detrend: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Where did the trigger fire on each trace, and does each alarm meet a labelled event?"""
    rows = conditioning.detrend(samples, key, chunk=chunk) if detrend else samples
    cf = trigger.sta_lta(rows, key, n_sta, n_lta, chunk=chunk, keep_chunk=True)
    found = trigger.to_seconds(trigger.trigger(cf, key, on, off, min_n, chunk=chunk), sr)
    return detections_hit(found, truth, key, tol, width=chunk / sr).select(*key, "on_i", "off_i", "hit")


def file_inventory(samples: DataFrame, file: str, sr: float, stations: DataFrame, net: str = "net", sta: str = "sta",
                   cha: str = "cha", prefer: Column | None = None, order: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """One row per file: size, variance measures, estimated event time, metadata flag, class.

    Of a file with several traces one counts: the first that satisfies ``prefer``, else
    the first, in the order of ``order`` (network, station, channel if not given).
    """
    n = int(1 * sr)
    trace = [net, sta, cha]
    known = samples.groupBy(file, *trace).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in order if c not in trace])
    chosen = select.first_match(known, [file], list(order) or trace, prefer).select(file, F.struct(*trace).alias("_trace"))
    counts = known.groupBy(file).agg(F.sum("_n").alias("_rows"))
    samples = attach_facts(samples, chosen, [file], counts=counts).where(F.struct(*trace).eqNullSafe(F.col("_trace"))).drop("_trace")
    base = samples.groupBy(file).agg(
        F.min(net).alias("rede"), F.min(sta).alias("estacao"), F.min(cha).alias("canal"), F.lit(float(sr)).alias("taxa_hz"),
        F.count(F.lit(1)).alias("n_amostras"), (F.count(F.lit(1)) / F.lit(float(sr))).alias("duracao_s"),
        F.min("ts").alias("starttime"), F.round(F.var_pop("v"), 2).alias("var_global"),
    )
    estimate = variance.event_estimate(variance.moving_variance(samples, [file], n, chunk=chunk), [file])
    estimate = estimate.withColumns({c: F.round(c, d) for c, d in (("var_min", 2), ("var_max", 2), ("razao_var", 1))})
    flagged = select.exists_flag(base, stations.select(F.col(net).alias("rede"), F.col(sta).alias("estacao")), ["rede", "estacao"], "xml_disponivel")
    joined = flagged.join(estimate, file, "left")
    status = F.when(F.col("var_max").isNull(), "short").otherwise("ok")
    return select.classify(joined.withColumn("status", status), "razao_var")


def build_dataset(samples: DataFrame, stations: DataFrame, key: Sequence[str], station: str, sr: float, n: int, step: int,
                  anomalous: Column, ts: str, target: float | None = None, sample: int | None = None, seed: int = 42,
                  band: tuple[float, float] | None = None, group_order: Column | None = None,
                  one_of: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Windows with label and both splits, ``split_estacao`` and ``split_temporal``.

    Traces without metadata are left out, and so are further traces with the same
    ``one_of`` (say file and station); ``anomalous`` traces give their central
    window, the others all windows (``sample`` of them if given).  The windows are
    written once before they are sampled and split, so every sample is conditioned
    once.  ``dataset_ledger`` says what became of each trace.
    """
    if one_of:
        samples = _first_traces(samples, key, one_of, ts)
    known = joins.attach_station(samples, stations.select(station), [station])
    clean = conditioning.condition(known, key, sr, target or sr, band=band, chunk=chunk)
    marks = cut_lineage(known.groupBy(*key).agg(
        F.max(anomalous.cast("int")).alias("label"), F.first(station).alias("net_sta"), F.min(ts).alias("t0"), F.count(F.lit(1)).alias("_rows")
    ))
    counts, marks = marks.select(*key, "_rows"), marks.drop("_rows")
    labelled = attach_facts(clean, marks.select(*key, "label"), key, counts=counts)
    loud, quiet = (labelled.where(F.col("label") == mark).drop("label") for mark in (1, 0))
    middle = windows.central_samples(loud, key, n, chunk=chunk).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("x")
    ).withColumn("k", F.lit(0).cast("bigint"))
    everything = windows.collect_windows(quiet, key, n, step)
    both = windows.zscore(everything.unionByName(middle.select(*everything.columns)))
    both = cut_lineage(attach_facts(both, marks, key, counts=counts))
    if sample is not None:
        normal = select.sample_n(both.where("label = 0"), sample, [*key, "k"], seed)
        both = normal.unionByName(both.where("label = 1"))
    by_station = splits.split_group(both, "net_sta", seed, group_order).withColumnRenamed("split", "split_estacao")
    return splits.split_temporal(by_station, ["t0", *key, "k"]).withColumnRenamed("split", "split_temporal")


def _first_traces(samples: DataFrame, key: Sequence[str], one_of: Sequence[str], ts: str) -> DataFrame:
    """Samples of the first trace, by start and key, of each ``one_of``."""
    traces = samples.groupBy(*key, *[c for c in one_of if c not in key]).agg(F.min(ts).alias("_t0"))
    first = select.dedupe(traces, list(one_of), ["_t0", *[k for k in key if k not in one_of]]).select(*key)
    return attach_facts(samples, first, key)


def dataset_ledger(samples: DataFrame, stations: DataFrame, key: Sequence[str], station: str, n: int, ts: str,
                   one_of: Sequence[str] = ()) -> DataFrame:
    """How many traces were used, and why the others were not (reason, n)."""
    names = list(dict.fromkeys([*key, station, *one_of]))
    traces = samples.groupBy(*names).agg(F.count(F.lit(1)).alias("_len"), F.min(ts).alias("_t0"))
    rest = [c for c in ["_t0", *key] if c not in one_of]
    if one_of:
        first = select.dedupe(traces.select(*one_of, *rest), list(one_of), rest).select(*key).withColumn("_first", F.lit(True))
        traces = join_facts(traces, first, key)
    else:
        traces = traces.withColumn("_first", F.lit(True))
    flagged = select.exists_flag(traces, stations.select(station), [station], "_known")
    status = F.when(F.col("_first").isNull(), "duplicate").when(~F.col("_known"), "no_station").when(F.col("_len") < n, "short").otherwise("used")
    return splits.ledger(flagged.withColumn("status", status))


def detect(samples: DataFrame, recon, key: Sequence[str], n: int, step: int, thr: float, sr: float = 1.0) -> DataFrame:
    """Windows of a signal with error, flag, and start and end seconds.

    ``recon`` is a fitted model, or a model table (pos, recon).
    """
    cut = windows.zscore(windows.collect_windows(samples, key, n, step), flat="keep")
    if isinstance(recon, DataFrame):
        scored = model.error_against_table(cut, recon, [*key, "k"])
    else:
        scored = recon.errors(cut)
    flagged = evaluate.flag(scored, thr)
    return flagged.select(
        *key, "k", "err", "pred", (F.col("k") * step / sr).alias("t_start"), ((F.col("k") * step + n) / sr).alias("t_end")
    )


def refit_if_drift(model_now, ref: DataFrame, recent: DataFrame, val: DataFrame, k: int, tolerance: float = 0.0, x: str = "x"):
    """Compare recent errors with reference errors; on drift refit on recent windows and
    switch only if the average precision on ``val`` does not fall.  Eager.

    Returns the model to use and a record of the decision.
    """
    test = ks_two_sample(model_now.errors(ref.select(x), x), model_now.errors(recent.select(x), x)).first()
    record = {"d": test["d"], "p": test["p"], "drift": bool(test["drift"]), "switched": False}
    if not test["drift"]:
        return model_now, record

    def quality(m):
        c = evaluate.curve(m.errors(val.select(x, "label"), x), [], "err")
        return evaluate.average_precision(c).first()["ap"]

    candidate = model.fit_pca(recent, k, x)
    record["ap_before"], record["ap_after"] = quality(model_now), quality(candidate)
    if record["ap_after"] >= record["ap_before"] - tolerance:
        record["switched"] = True
        return candidate, record
    return model_now, record


def result_record(metodo: str, params: Mapping[str, float], metrics: DataFrame, versao: str = "1.0") -> DataFrame:
    """One result record from a one-row metrics frame."""
    given = F.create_map(*[F.lit(v) if isinstance(v, str) else F.lit(float(v)) for kv in params.items() for v in kv])
    return metrics.select(F.lit(metodo).alias("metodo"), F.lit(versao).alias("versao"), given.alias("parametros"), *metrics.columns)
