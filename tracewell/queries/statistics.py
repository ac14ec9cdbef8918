from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import stats as S
from tracewell.operators.select import classify
from tracewell.operators.model import error_against_table, mean_waveform
from tracewell.operators.windows import noise_window_estimate
from tracewell.queries.registry import query, r6, rounded, table
from tracewell.queries.signal import EMB


@query("D01_trace_statistics", """
SELECT user_id, count(*) AS n, count(*) / 40.0 AS duration_s, round(var_pop(value), 6) AS var, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def d01(spark, d):
    return rounded(S.trace_stats(table(spark, d, "events"), ["user_id"], 40.0, "value"), "var", "mean", "std")


@query("D02_signal_energy", """
SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, max(abs(value)) AS max_abs, round(sum(value * value), 4) AS energy FROM events GROUP BY 1""")
def d02(spark, d):
    out = rounded(S.energy(table(spark, d, "events"), ["user_id"], "value"), "rms")
    return out.withColumn("energy", F.round("energy", 4))


@query("D03_window_stats_by_class", f"""WITH l AS (SELECT vec_id, label, unnest(x) AS v FROM ({EMB})),
w AS (SELECT vec_id, label, stddev_pop(v) AS sd, max(abs(v)) AS mx, kurtosis_pop(v) + 3 AS ku FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM w)
SELECT label, count(*) AS n_windows, round(avg(sd), 6) AS mean_std, round(avg(mx), 6) AS mean_max_abs,
  round(avg(ku) FILTER (rn <= 100), 6) AS mean_kurtosis FROM r GROUP BY 1""")
def d03(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))
    return rounded(S.window_stats(e, ["vec_id"], ["label"]), "mean_std", "mean_max_abs", "mean_kurtosis")


@query("D04_mean_abs_waveform", f"""
SELECT label, pos, round(avg(abs(v)), 6) AS mean_abs FROM (SELECT label, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS pos FROM ({EMB})) GROUP BY 1, 2""")
def d04(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("x"))
    return rounded(S.mean_abs_waveform(e, ["label"]), "mean_abs")


@query("D05_counts_by_class_split", """
SELECT l_linestatus AS split, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)""")
def d05(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("label"))
    return S.counts_with_totals(li, ["split", "label"])


@query("D06_counts_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, count(*) AS n FROM orders GROUP BY 1")
def d06(spark, d):
    return S.counts(table(spark, d, "orders").select(F.year("o_orderdate").alias("ano")), ["ano"])


@query("D07_distinct", """
SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type, count(DISTINCT props) AS n_props FROM events""")
def d07(spark, d):
    return S.distinct_counts(table(spark, d, "events"), ["user_id", "event_type", "props"])


@query("D08_file_size_profile", """
SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, CAST(sum(n_chars) AS BIGINT) AS total,
  CAST(max(CASE WHEN rn = c // 2 + 1 THEN n_chars END) AS DOUBLE) AS median FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM documents) GROUP BY 1""")
def d08(spark, d):
    return S.size_profile(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"])


ERRORS = f"""e AS (SELECT vec_id, label, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS pos FROM ({EMB})),
m AS (SELECT pos, avg(v) AS recon FROM e WHERE label <> 9 GROUP BY 1),
err AS (SELECT vec_id, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label, avg((v - recon) * (v - recon)) AS err FROM e JOIN m USING (pos) GROUP BY 1, 2)"""


def embedding_errors(spark, d):
    """Windows scored against the mean waveform of the normal ones (label 9 is the anomaly)."""
    w = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    err = error_against_table(w, mean_waveform(w.where("label <> 9")), ["vec_id"])
    return err.select("vec_id", F.when(F.col("label") == 9, 1).otherwise(0).alias("label"), "err")


@query("D09_error_statistics", f"""WITH {ERRORS}
SELECT label, count(*) AS n, round(avg(err), 8) AS mean, round(stddev_pop(err), 8) AS std, round(quantile_cont(err, 0.5), 8) AS median,
  round(quantile_cont(err, 0.95), 8) AS p95, round(quantile_cont(err, 0.99), 8) AS p99 FROM err GROUP BY 1""")
def d09(spark, d):
    return rounded(S.error_stats(embedding_errors(spark, d), ["label"]), "mean", "std", "median", "p95", "p99", digits=8)


@query("D09_error_ratio", f"""WITH {ERRORS}
SELECT round(avg(err) FILTER (label = 1), 8) AS event_mean, round(avg(err) FILTER (label = 0), 8) AS noise_mean,
  round(avg(err) FILTER (label = 1) / avg(err) FILTER (label = 0), 6) AS ratio FROM err""")
def d09_ratio(spark, d):
    out = S.class_ratio(embedding_errors(spark, d))
    return out.select(r6("event_mean", 8).alias("event_mean"), r6("noise_mean", 8).alias("noise_mean"), r6("ratio").alias("ratio"))


@query("D10_density_histogram", """
WITH l AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 30 AS w, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT e.event_type, lo, w, n, least(CAST(floor((value - lo) / w) AS INTEGER), 29) AS bin FROM events e JOIN l USING (event_type))
SELECT event_type, bin, round(lo + bin * w, 6) AS "left", round(w, 6) AS width, count(*) AS count, round(count(*) / (n * w), 9) AS density
FROM b GROUP BY event_type, bin, lo, w, n""")
def d10(spark, d):
    out = S.histogram(table(spark, d, "events"), "value", 30, ["event_type"])
    return rounded(out, "left", "width").withColumn("density", F.round("density", 9))


@query("D11_box_plot", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low, max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
  CAST(sum(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outside
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""")
def d11(spark, d):
    return rounded(S.box_stats(table(spark, d, "events"), "value", ["event_type"]), "q1", "median", "q3")


@query("D12_time_span", """
SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_s FROM events GROUP BY 1""")
def d12(spark, d):
    out = S.span(table(spark, d, "events"), "ts", "ts", ["event_type"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("event_type", text("first").alias("first"), text("last").alias("last"), r6("span_s").alias("span_s"))


@query("D13_noise_window_estimate", """
SELECT o_orderkey, greatest(0, CAST(trunc((greatest(0.0, o_totalprice / 10000 - 3) * 40 - 400) / 200) AS BIGINT) + 1) AS n FROM orders""")
def d13(spark, d):
    n = noise_window_estimate(F.col("o_totalprice") / 10000, 3.0, 40.0, 400, 200)
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"))


@query("D14_readiness", """
SELECT *, n_files >= 20 AS enough_files, n_with_metadata >= 15 AS enough_metadata, n_clear >= 10 AS enough_events FROM (
  SELECT count(*) AS n_files, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_with_metadata,
    CAST(sum(CASE WHEN o_totalprice / 30000 > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_clear FROM orders)""")
def d14(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("xml_disponivel"), (F.col("o_totalprice") / 30000).alias("r"))
    return S.readiness(classify(o, "r"))


@query("D14_window_supply", """
SELECT label, count(*) AS n, CASE WHEN count(*) < 50 THEN 'too_few' WHEN count(*) < 200 THEN 'few' ELSE 'enough' END AS supply FROM embeddings GROUP BY 1""")
def d14_supply(spark, d):
    return S.window_supply(table(spark, d, "embeddings").select("label"))


@query("G28_overview", """
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderstatus) AS n_o_orderstatus,
  min(o_totalprice) AS min_o_totalprice, round(avg(o_totalprice), 4) AS mean_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders""")
def g28(spark, d):
    out = S.overview(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice"])
    return out.withColumn("mean_o_totalprice", F.round("mean_o_totalprice", 4))


@query("G27_throughput", """
SELECT o_orderpriority, round(sum(ms) / sum(npts / sr), 6) AS ms_per_s, round(avg(ms), 6) AS mean_ms, round(stddev_pop(ms), 6) AS std_ms,
  min(ms) AS min_ms, max(ms) AS max_ms, avg(ms) < 5000 AS real_time
FROM (SELECT o_orderpriority, o_totalprice / 64 AS ms, 400 + o_custkey AS npts, 40.0 AS sr FROM orders) GROUP BY 1""")
def g27(spark, d):
    runs = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 64).alias("ms"), (400 + F.col("o_custkey")).alias("npts"), F.lit(40.0).alias("sr"))
    return rounded(S.throughput(runs, ["o_orderpriority"]), "ms_per_s", "mean_ms", "std_ms")
