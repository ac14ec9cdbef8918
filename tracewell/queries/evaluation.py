from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import evaluate as E
from tracewell.operators import model as M
from tracewell.operators.drift import ks_two_sample
from tracewell.operators.intervals import match_detections
from tracewell.operators.ordered import add_index
from tracewell.operators.trigger import sta_lta, to_seconds, trigger
from tracewell.operators.windows import collect_windows, zscore
from tracewell.plans import jobs
from tracewell.queries.joins import DETECTIONS
from tracewell.queries.registry import TYPE_SAMPLES, USER_SAMPLES, event_samples, query, r6, rounded, table
from tracewell.queries.statistics import ERRORS, embedding_errors

U = ["user_id"]
SCORES = "sc AS (SELECT n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id))"
CURVE = f"""{SCORES}, ag AS (SELECT score AS thr, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1),
c AS (SELECT thr, p, n, sum(p) OVER (ORDER BY thr DESC) AS tp, sum(n - p) OVER (ORDER BY thr DESC) AS fp, sum(p) OVER () AS pos, sum(n - p) OVER () AS neg FROM ag)"""


def scores(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(F.col("n_chars").alias("score"), F.col("toxic").alias("label"))


@query("E17_cumulative_confusion", f"WITH {CURVE} SELECT thr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def e17(spark, d):
    return E.curve(scores(spark, d)).select("thr", "tp", "fp")


@query("G08_reconstruction_error", f"WITH {ERRORS} SELECT vec_id, label, round(err, 8) AS err FROM err")
def g08(spark, d):
    return embedding_errors(spark, d).withColumn("err", F.round("err", 8))


@query("G12_threshold_rules", f"""WITH {ERRORS}, t AS (SELECT err FROM err WHERE label = 0)
SELECT '3sigma' AS rule, round(avg(err) + 3 * stddev_pop(err), 8) AS thr FROM t UNION ALL SELECT 'p95', round(quantile_cont(err, 0.95), 8) FROM t
UNION ALL SELECT 'p99', round(quantile_cont(err, 0.99), 8) FROM t
UNION ALL SELECT 'best_f1', round(thr, 8) FROM (SELECT thr, 2 * tp / (tp + fp + pos) AS f1 FROM (
  SELECT thr, sum(p) OVER (ORDER BY thr DESC) AS tp, sum(n - p) OVER (ORDER BY thr DESC) AS fp, sum(p) OVER () AS pos FROM (
    SELECT err AS thr, sum(label) AS p, count(*) AS n FROM (SELECT round(err, 9) AS err, label FROM err) GROUP BY 1)) ORDER BY round(f1, 12) DESC, thr DESC LIMIT 1)""")
def g12(spark, d):
    err = embedding_errors(spark, d)
    normal = err.where("label = 0")
    out = None
    for rule in ("3sigma", "p95", "p99"):
        t = E.threshold(normal, rule, split=None).select(F.lit(rule).alias("rule"), r6("thr", 8).alias("thr"))
        out = t if out is None else out.unionByName(t)
    best = E.threshold(err.withColumn("err", F.round("err", 9)), "best_f1", split=None)
    return out.unionByName(best.select(F.lit("best_f1").alias("rule"), r6("thr", 8).alias("thr")))


@query("G13_flag_anomalies", """
SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS pred_inclusive FROM documents""")
def g13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("err"))
    return E.flag(E.flag(docs, 1500), 1500, inclusive=True, name="pred_inclusive").drop("err")


@query("G14_confusion_matrix", f"""WITH {SCORES}
SELECT count(*) FILTER (score <= 1500 AND label = 0) AS tn, count(*) FILTER (score > 1500 AND label = 0) AS fp,
  count(*) FILTER (score <= 1500 AND label = 1) AS fn, count(*) FILTER (score > 1500 AND label = 1) AS tp FROM sc""")
def g14(spark, d):
    return E.confusion(E.flag(scores(spark, d), 1500, "score"))


@query("G15_precision_recall_f1", f"""WITH {SCORES}, c AS (SELECT count(*) FILTER (score > 1500 AND label = 0) AS fp,
  count(*) FILTER (score <= 1500 AND label = 1) AS fn, count(*) FILTER (score > 1500 AND label = 1) AS tp FROM sc)
SELECT round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""")
def g15(spark, d):
    out = E.prf(E.confusion(E.flag(scores(spark, d), 1500, "score")))
    return rounded(out.select("precision", "recall", "f1"), "precision", "recall", "f1", digits=8)


@query("G15_trigger_quality", f"""WITH {DETECTIONS}, t AS (SELECT user_id, i AS t FROM s WHERE event_type = 'error'),
h AS (SELECT EXISTS (SELECT 1 FROM t WHERE t.user_id = det.user_id AND (abs(on_i - t.t) <= 2 OR (on_i <= t.t AND t.t <= off_i))) AS hit FROM det),
f AS (SELECT EXISTS (SELECT 1 FROM det WHERE t.user_id = det.user_id AND (abs(on_i - t.t) <= 2 OR (on_i <= t.t AND t.t <= off_i))) AS found FROM t),
c AS (SELECT (SELECT count(*) FROM h) AS n_alarms, (SELECT count(*) FILTER (hit) FROM h) AS n_hits, (SELECT count(*) FROM f) AS n_truth, (SELECT count(*) FILTER (found) FROM f) AS n_found)
SELECT n_alarms, n_hits, n_truth, n_found, round(n_hits / n_alarms, 8) AS precision, round(n_found / n_truth, 8) AS recall,
  round(2 * (n_hits / n_alarms) * (n_found / n_truth) / (n_hits / n_alarms + n_found / n_truth), 8) AS f1,
  round(2 * (n_found / n_truth) / (1 + n_found / n_truth), 8) AS f1_no_false_alarms FROM c""")
def g15_trigger(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    det = to_seconds(trigger(sta_lta(s, U, 3, 10, keep_chunk=True), U, 1.8, 0.8, 2), 1.0)
    truth = s.where("event_type = 'error'").select("user_id", F.col("i").alias("t"))
    out = E.trigger_quality(*match_detections(det, truth, U, 2.0))
    return rounded(out, "precision", "recall", "f1", "f1_no_false_alarms", digits=8)


@query("G16_roc_curve", f"""WITH {CURVE} SELECT CAST(thr AS DOUBLE) AS thr, round(fp / neg, 8) AS fpr, round(tp / pos, 8) AS tpr FROM c
UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0""")
def g16(spark, d):
    out = E.roc(E.curve(scores(spark, d).withColumn("score", F.col("score").cast("double"))))
    return rounded(out, "fpr", "tpr", digits=8)


@query("G17_best_f1_threshold", f"""WITH {CURVE} SELECT thr, round(f1, 8) AS f1 FROM (SELECT thr, 2 * tp / (tp + fp + pos) AS f1 FROM c) ORDER BY f1 DESC, thr DESC LIMIT 1""")
def g17(spark, d):
    return E.best_f1(E.curve(scores(spark, d))).withColumn("f1", F.round("f1", 8))


@query("G18_roc_auc", f"""WITH {SCORES}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc)
SELECT round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 8) AS auc FROM r""")
def g18(spark, d):
    return E.auc(E.curve(scores(spark, d))).withColumn("auc", F.round("auc", 8))


@query("G19_pr_curve", f"WITH {CURVE} SELECT thr, round(tp / (tp + fp), 8) AS precision, round(tp / pos, 8) AS recall FROM c")
def g19(spark, d):
    return rounded(E.pr(E.curve(scores(spark, d))), "precision", "recall", digits=8)


@query("G19_average_precision", f"WITH {CURVE} SELECT round(sum(p * tp / (tp + fp)) / max(pos), 8) AS ap FROM c")
def g19_ap(spark, d):
    return E.average_precision(E.curve(scores(spark, d))).withColumn("ap", F.round("ap", 8))


def first_errors(s):
    """One truth per trace: its first error after the warm-up."""
    late = (F.col("event_type") == "error") & (F.col("i") >= 10)
    return s.where(late).groupBy("user_id").agg((F.min("i") / 2.0).alias("t"))


TRIGGER_SCORES = f"""{USER_SAMPLES},
cf AS (SELECT user_id, i, event_type, CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END AS cf FROM (
  SELECT user_id, i, event_type, sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) / 3 AS sta,
    sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) / 10 AS lta FROM s)),
t AS (SELECT user_id, min(i) / 2.0 AS t FROM s WHERE event_type = 'error' AND i >= 10 GROUP BY 1),
z AS (SELECT user_id, t, greatest(0, trunc((t - 4) * 2)) AS i0, least(len, trunc((t + 4) * 2)) AS i1, len, p95 FROM t JOIN (
  SELECT user_id, max(i) + 1 AS len, quantile_cont(cf, 0.95) AS p95 FROM cf GROUP BY 1) USING (user_id)),
b AS (SELECT user_id, coalesce(max(CASE WHEN i >= i0 AND i < i1 THEN cf / (p95 + 1e-10) END), 0) AS ev,
  coalesce(max(CASE WHEN NOT (i >= greatest(0, i0 - 5) AND i < least(len, i1 + 5)) THEN cf / (p95 + 1e-10) END), 0) AS no FROM cf JOIN z USING (user_id) GROUP BY 1),
ts AS (SELECT user_id, 1 AS label, ev AS score FROM b UNION ALL SELECT user_id, 0, no FROM b)"""


@query("G20_trigger_scores", f"WITH {TRIGGER_SCORES} SELECT user_id, label, round(score, 6) AS score FROM ts")
def g20(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    out = E.score_trigger(sta_lta(s, U, 3, 10, keep_chunk=True), first_errors(s), U, 2.0, tol=4.0, guard=5)
    return out.withColumn("score", F.round("score", 6))


SWEEP = [(3, 8, 1.5), (3, 10, 1.5), (3, 15, 1.5), (2, 10, 1.5), (5, 10, 1.5), (3, 10, 1.2), (3, 10, 2.0)]


def _sweep_cf(settings=SWEEP):
    parts = [f"SELECT {j} AS setting, user_id, i, {on} AS th, sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS {a - 1} PRECEDING) / {a} AS sta, "
             f"sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS {b - 1} PRECEDING) / {b} AS lta FROM s" for j, (a, b, on) in enumerate(settings)]
    return " UNION ALL ".join(parts)


def _sweep_sql(settings, tol):
    """Detections of every setting and how they meet the truth: cf, t (truth) and q (setting, n_alarms, n_hits, n_truth, n_found)."""
    meets = f"(abs(t_on - t) <= {tol} OR (t_on <= t AND t <= t_off))"
    return f"""a AS ({_sweep_cf(settings)}),
cf AS (SELECT setting, user_id, i, th, CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END AS cf FROM a),
st AS (SELECT setting, user_id, i, coalesce(last_value(CASE WHEN cf > th THEN 1 WHEN cf < th / 2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY setting, user_id ORDER BY i), 0) AS on_ FROM cf),
ed AS (SELECT *, CASE WHEN on_ <> lag(on_, 1, 0) OVER (PARTITION BY setting, user_id ORDER BY i) THEN 1 ELSE 0 END AS e FROM st),
rn AS (SELECT *, sum(e) OVER (PARTITION BY setting, user_id ORDER BY i) AS r FROM ed),
det AS (SELECT setting, user_id, min(i) / 2.0 AS t_on, (max(i) + 1) / 2.0 AS t_off FROM rn WHERE on_ = 1 GROUP BY setting, user_id, r HAVING max(i) + 1 - min(i) >= 2),
t AS (SELECT g.setting, user_id, t FROM (SELECT user_id, min(i) / 2.0 AS t FROM s WHERE event_type = 'error' AND i >= 10 GROUP BY 1), (SELECT DISTINCT setting FROM a) g),
f AS (SELECT setting, EXISTS (SELECT 1 FROM det WHERE det.setting = t.setting AND det.user_id = t.user_id AND {meets}) AS found FROM t),
h AS (SELECT setting, EXISTS (SELECT 1 FROM t WHERE det.setting = t.setting AND det.user_id = t.user_id AND {meets}) AS hit FROM det),
q AS (SELECT setting, coalesce(n_alarms, 0) AS n_alarms, coalesce(n_hits, 0) AS n_hits, n_truth, n_found
  FROM (SELECT setting, count(*) AS n_truth, count(*) FILTER (found) AS n_found FROM f GROUP BY 1)
  LEFT JOIN (SELECT setting, count(*) AS n_alarms, count(*) FILTER (hit) AS n_hits FROM h GROUP BY 1) USING (setting))"""


@query("G21_parameter_sweep", f"""WITH {USER_SAMPLES}, {_sweep_sql(SWEEP, 2)}
SELECT setting, n_alarms, n_hits, n_truth, n_found, round(2 * (n_found / n_truth) / (1 + n_found / n_truth), 8) AS f1_no_false_alarms FROM q""")
def g21(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    settings = [{"setting": j, "axis": "all", "varied": float(j), "n_sta": a, "n_lta": b, "on": float(on)} for j, (a, b, on) in enumerate(SWEEP)]
    out = E.sweep(s, first_errors(s), U, 2.0, settings, min_dur=1.0, tol=2.0, with_auc=False)
    return out.select("setting", "n_alarms", "n_hits", "n_truth", "n_found", r6("f1_no_false_alarms", 8).alias("f1_no_false_alarms"))


# AUC of the scores of each setting: how often an event scores above a noise, ties counting half
AUC_SQL = """n AS (SELECT user_id, max(i) + 1 AS len FROM s GROUP BY 1),
z AS (SELECT setting, t.user_id, len, greatest(0, trunc((t - 4) * 2)) AS i0, least(len, trunc((t + 4) * 2)) AS i1 FROM t JOIN n USING (user_id)),
p AS (SELECT setting, user_id, quantile_cont(cf, 0.95) + 1e-10 AS p95 FROM cf GROUP BY 1, 2),
sc AS (SELECT z.setting, z.user_id, coalesce(max(cf / p95) FILTER (i >= i0 AND i < i1), 0) AS event,
    coalesce(max(cf / p95) FILTER (NOT (i >= greatest(0, i0 - 20) AND i < least(len, i1 + 20))), 0) AS noise
  FROM z JOIN cf USING (setting, user_id) JOIN p USING (setting, user_id) GROUP BY 1, 2),
u AS (SELECT x.setting, avg(CASE WHEN x.event > y.noise THEN 1 WHEN x.event = y.noise THEN 0.5 ELSE 0 END) AS auc FROM sc x JOIN sc y USING (setting) GROUP BY 1)"""


AUC_SWEEP = E.sweep_settings(2.0)


@query("G21_sweep_with_auc", f"""WITH {USER_SAMPLES}, {_sweep_sql([(s["n_sta"], s["n_lta"], s["on"]) for s in AUC_SWEEP], 4)},
{AUC_SQL},
g AS (SELECT * FROM (VALUES {", ".join(f"({s['setting']}, '{s['axis']}', {s['varied']}::DOUBLE)" for s in AUC_SWEEP)}) v(setting, axis, varied))
SELECT setting, axis, varied, n_alarms, n_hits, n_truth, n_found, round(2 * (n_found / n_truth) / (1 + n_found / n_truth), 8) AS f1_no_false_alarms, round(auc, 8) AS auc
FROM g JOIN q USING (setting) JOIN u USING (setting)""")
def g21_auc(spark, d):
    """The full one-at-a-time sweep of 17 settings with ROC-AUC per setting."""
    s = event_samples(spark, d, extra=("event_type",))
    out = E.sweep(s, first_errors(s), U, 2.0, AUC_SWEEP, tol=4.0)
    return out.select("setting", "axis", "varied", "n_alarms", "n_hits", "n_truth", "n_found", r6("f1_no_false_alarms", 8).alias("f1_no_false_alarms"), r6("auc", 8).alias("auc"))


@query("G21_grid", f"""WITH {USER_SAMPLES}, {_sweep_sql([(a, b, c) for a in (1, 2, 3, 4, 6) for b in (8, 10, 15, 20, 30) for c in (1.21, 1.53, 1.79, 2.03, 2.47, 3.1, 4.1)], 2)}
SELECT setting, n_alarms, n_hits, n_truth, n_found FROM q""")
def g21_grid(spark, d):
    """All 175 settings of a grid in one pass over the samples."""
    grid = [(a, b, c) for a in (1, 2, 3, 4, 6) for b in (8, 10, 15, 20, 30) for c in (1.21, 1.53, 1.79, 2.03, 2.47, 3.1, 4.1)]
    settings = [{"setting": j, "axis": "all", "varied": float(j), "n_sta": a, "n_lta": b, "on": c} for j, (a, b, c) in enumerate(grid)]
    s = event_samples(spark, d, extra=("event_type",))
    out = E.sweep(s, first_errors(s), U, 2.0, settings, min_dur=1.0, tol=2.0, with_auc=False)
    return out.select("setting", "n_alarms", "n_hits", "n_truth", "n_found")


@query("G22_method_comparison", f"""WITH {SCORES}, c AS (SELECT count(*) FILTER (score > 1500 AND label = 0) AS fp, count(*) FILTER (score <= 1500 AND label = 1) AS fn,
  count(*) FILTER (score > 1500 AND label = 1) AS tp FROM sc),
c2 AS (SELECT thr, p, sum(p) OVER (ORDER BY thr DESC) AS tp, sum(n - p) OVER (ORDER BY thr DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT score AS thr, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1))
SELECT 'fixed' AS metodo, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, NULL AS ap FROM c
UNION ALL SELECT 'ranked', NULL, round(sum(p * tp / (tp + fp)) / max(pos), 8) FROM c2""")
def g22(spark, d):
    sc = scores(spark, d)
    fixed = E.prf(E.confusion(E.flag(sc, 1500, "score"))).select(F.lit("fixed").alias("metodo"), r6("f1", 8).alias("f1"))
    ranked = E.average_precision(E.curve(sc)).select(F.lit("ranked").alias("metodo"), r6("ap", 8).alias("ap"))
    return E.compare([fixed, ranked])


@query("G23_learning_curve", """
WITH ep AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) / 1e6 AS loss, stddev_pop(o_totalprice) / 1e5 AS val_loss FROM orders GROUP BY 1),
e AS (SELECT row_number() OVER (ORDER BY m) AS epoch, loss, val_loss FROM ep)
SELECT round(arg_max(loss, epoch), 8) AS train_loss, round(arg_max(val_loss, epoch), 8) AS val_loss, arg_min(epoch, (round(val_loss, 10), epoch)) AS best_epoch,
  round(min(val_loss), 8) AS best_val_loss, round(arg_max(val_loss, epoch) - arg_max(loss, epoch), 8) AS gap,
  CASE WHEN arg_max(val_loss, epoch) - arg_max(loss, epoch) > 0.5 * arg_max(loss, epoch) THEN 'overfit' WHEN arg_max(loss, epoch) > 0.5 THEN 'underfit' ELSE 'ok' END AS verdict FROM e""")
def g23(spark, d):
    ep = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(
        (F.avg("o_totalprice") / 1e6).alias("loss"), (F.stddev_pop("o_totalprice") / 1e5).alias("val_loss"))
    epochs = add_index(ep, [], ["m"], "epoch").withColumn("epoch", F.col("epoch") + 1)
    return rounded(E.learning_curve(epochs), "train_loss", "val_loss", "best_val_loss", "gap", digits=8)


@query("G24_detector_job", f"""WITH {TYPE_SAMPLES}, n AS (SELECT event_type, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT event_type, unnest(generate_series(0, (len - 40) // 20)) AS k FROM n WHERE len >= 40),
x AS (SELECT k.event_type, k.k, s.i - k.k * 20 AS pos, s.v FROM k JOIN s ON s.event_type = k.event_type AND s.i >= k.k * 20 AND s.i < k.k * 20 + 40),
z AS (SELECT *, (v - avg(v) OVER q) / stddev_pop(v) OVER q AS z FROM x WINDOW q AS (PARTITION BY event_type, k)),
m AS (SELECT pos, avg(z) AS recon FROM z WHERE event_type <> 'error' GROUP BY 1),
e AS (SELECT event_type, k, avg((z - recon) * (z - recon)) AS err FROM z JOIN m USING (pos) GROUP BY 1, 2)
SELECT event_type, k, round(err, 6) AS err, CASE WHEN err > 1.0 THEN 1 ELSE 0 END AS pred, k * 20 / 40.0 AS t_start, (k * 20 + 40) / 40.0 AS t_end FROM e""")
def g24(spark, d):
    s = event_samples(spark, d, "event_type")
    normal = zscore(collect_windows(s.where("event_type <> 'error'"), ["event_type"], 40, 20))
    out = jobs.detect(s, M.mean_waveform(normal), ["event_type"], 40, 20, 1.0, 40.0)
    return out.withColumn("err", F.round("err", 6))


@query("G25_ks_drift", """
WITH a AS (SELECT value AS v, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS r FROM events),
g AS (SELECT v, sum(r) AS r, sum(1 - r) AS c FROM a GROUP BY 1),
f AS (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS fr, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS fc, sum(r) OVER () AS n, sum(c) OVER () AS m FROM g),
d AS (SELECT max(abs(fr - fc)) AS d, CAST(max(n) AS BIGINT) AS n_ref, CAST(max(m) AS BIGINT) AS n_cur FROM f),
p AS (SELECT *, d * sqrt(n_ref * n_cur / (n_ref + n_cur)) AS x FROM d),
q AS (SELECT d, n_ref, n_cur, CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x)) FROM (SELECT unnest(generate_series(1, 100)) AS j)))) END AS p FROM p)
SELECT round(d, 8) AS d, n_ref, n_cur, round(p, 8) AS p, p < 0.05 AS drift FROM q""")
def g25(spark, d):
    e = table(spark, d, "events").select("ts", F.col("value").alias("err"))
    out = ks_two_sample(e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'"))
    return rounded(out, "d", "p", digits=8)


def model_windows(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") == 9, 1).otherwise(0).alias("label"))


def fixed_model() -> M.DenseModel:
    """A network of 64, 4 and 64 values whose weights follow a rule, so that SQL can compute it."""
    i, j = np.arange(1, 65)[:, None], np.arange(1, 5)[None, :]
    return M.DenseModel([np.sin(0.37 * i * j) / 4, np.cos(0.11 * i * j).T / 4], [0.01 * np.arange(4), 0.001 * np.arange(64)])


# the errors of fixed_model
FIXED_ERRORS = """x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
h AS (SELECT vec_id, j, greatest(0, sum(v * sin(0.37 * i * j) / 4) + 0.01 * (j - 1)) AS a FROM x, (SELECT unnest(range(1, 5)) AS j) GROUP BY 1, 2),
r AS (SELECT vec_id, i, any_value(v) AS v, sum(a * cos(0.11 * i * j) / 4) + 0.001 * (i - 1) AS y FROM x JOIN h USING (vec_id) GROUP BY 1, 2),
err AS (SELECT vec_id, avg((y - v) ** 2) AS err FROM r GROUP BY 1)"""


@query("G10_reconstruct_fixed", f"WITH {FIXED_ERRORS} SELECT vec_id, i - 1 AS pos, round(y, 6) AS y FROM r")
def g10_reconstruct(spark, d):
    rows = fixed_model().reconstruct(model_windows(spark, d))
    return rows.select("vec_id", F.posexplode("recon").alias("pos", "y")).withColumn("y", r6("y"))


@query("G10_encode_fixed", f"WITH {FIXED_ERRORS} SELECT vec_id, j - 1 AS pos, round(a, 6) AS code FROM h")
def g10_encode(spark, d):
    """The values of the narrowest layer."""
    return fixed_model().encode(model_windows(spark, d)).select("vec_id", F.posexplode("code").alias("pos", "code")).withColumn("code", r6("code"))


@query("G09_pca_model")
def g09(spark, d):
    w = model_windows(spark, d)
    out = M.fit_pca(w.where("label = 0"), 8).errors(w)
    return out.select("vec_id", "label", r6("err").alias("err"))


@query("G09_latent_codes")
def g09_codes(spark, d):
    w = model_windows(spark, d)
    return M.fit_pca(w.where("label = 0"), 4).encode(w).select("vec_id", F.transform("code", F.abs).alias("code"))


@query("G10_dense_autoencoder")
def g10(spark, d):
    w = model_windows(spark, d)
    u = (F.col("vec_id") * 7919 + 42) % 10
    normal = w.where("label = 0").withColumn("u", u)
    fitted = M.fit_dense_ae(normal.where("u < 8"), normal.where("u >= 8"), (64, 32, 8), epochs=4, lr=5e-3, batch=512)
    return fitted.errors(w).select("vec_id", "label", r6("err").alias("err"))


@query("G11_search")
def g11(spark, d):
    w = model_windows(spark, d).withColumn("u", (F.col("vec_id") * 7919 + 42) % 10)
    return M.search(w.where("u < 7"), w.where("u >= 7"), [2, 8, 16], [90.0, 95.0, 99.0], ids=["vec_id"])


SEARCH = [{"layers": (n, 16, k), "lr": lr} for n, k, lr in ((64, 4, 1e-3), (64, 4, 1e-2), (64, 8, 1e-3), (64, 8, 1e-2), (64, 2, 3e-3), (64, 8, 3e-3), (64, 16, 3e-3), (63, 8, 1e-2))]


@query("G11_search_pruned", f"""WITH RECURSIVE w AS (SELECT max(len(embedding)) AS w FROM embeddings),
o AS (SELECT * FROM (VALUES {", ".join(f"({k}, {o['layers'][0]})" for k, o in enumerate(SEARCH))}) t(trial, layer)),
r AS (SELECT 0 AS rung, 0 AS epoch, count(*) AS live FROM o JOIN w ON layer = w
  UNION ALL SELECT rung + 1, CAST(2 ** rung AS INTEGER), CAST(ceil(live / 2.0) AS BIGINT) FROM r WHERE rung < 3),
p AS (SELECT epoch, lag(live) OVER (ORDER BY rung) - live AS n, live, rung FROM r)
SELECT 'pruned' AS status, epoch AS epochs, n FROM p WHERE n > 0
UNION ALL SELECT 'done', 6, live FROM p WHERE rung = 3
UNION ALL SELECT 'failed', 0, count(*) FROM o JOIN w ON layer <> w""")
def g11_pruned(spark, d):
    """Eight networks, one of the wrong width; after 1, 2 and 4 epochs half of the live ones go on.  SQL knows the schedule."""
    w = model_windows(spark, d).withColumn("u", (F.col("vec_id") * 7919 + 42) % 10).where("label = 0")
    rows, _ = M.search_dense(w.where("u < 7").select("vec_id", "x"), w.where("u >= 7").select("x"), SEARCH, epochs=6, rungs=(1, 2, 4), steps=2)
    return rows.groupBy("status", "epochs").agg(F.count(F.lit(1)).alias("n"))


@query("G26_refit_on_drift")
def g26(spark, d):
    w = model_windows(spark, d).withColumn("half", F.col("vec_id") % 2)
    now = M.fit_pca(w.where("label = 0 AND half = 0"), 8)
    used, record = jobs.refit_if_drift(now, w.where("label = 0 AND half = 0"), w.where("label = 1"), w, 8)
    return used.errors(w).select("vec_id", "label", r6("err").alias("err"), F.lit(record["drift"]).alias("drift"))


@query("J03_trigger_report", f"""WITH {USER_SAMPLES}, r AS (SELECT user_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM s GROUP BY 1),
dt AS (SELECT user_id, i, event_type, v - (a + b * i) AS v FROM s JOIN r USING (user_id)),
cf AS (SELECT user_id, i, CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END AS cf FROM (
  SELECT user_id, i, sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) / 3 AS sta,
    sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) / 10 AS lta FROM dt)),
{DETECTIONS[DETECTIONS.index('st AS'):]},
t AS (SELECT user_id, i AS t FROM s WHERE event_type = 'error')
SELECT user_id, on_i, off_i, EXISTS (SELECT 1 FROM t WHERE t.user_id = det.user_id
  AND (abs(on_i - t.t) <= 2 OR (on_i <= t.t AND t.t <= off_i))) AS hit FROM det""")
def j03(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    truth = s.where("event_type = 'error'").select("user_id", F.col("i").alias("t"))
    return jobs.trigger_report(s.select("user_id", "i", "v"), truth, U, 3, 10, 1.8, 0.8, 2, 2.0)


@query("C09_parameter_grid", f"""WITH {USER_SAMPLES}, a AS ({_sweep_cf()})
SELECT setting, user_id, count(*) AS n, round(max(CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END), 6) AS peak FROM a GROUP BY 1, 2""")
def c09(spark, d):
    settings = [{"setting": j, "axis": "all", "varied": float(j), "n_sta": a, "n_lta": b, "on": float(on)} for j, (a, b, on) in enumerate(SWEEP)]
    grid = E.cf_grid(event_samples(spark, d), U, settings)
    return grid.groupBy("setting", "user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("cf")).alias("peak"))
