from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import model as M
from tracewell.queries.evaluation import FIXED_ERRORS, fixed_model, model_windows
from tracewell.queries.joins import DETECTIONS
from tracewell.queries.registry import query, r6, table
from tracewell.queries.sources import scratch
from tracewell.streaming import features
from tracewell.streaming.trigger import stream_trigger

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_events(spark, d):
    raw = features.stream_table(spark, d, "events", EVENTS)
    return raw.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# a window is emitted once the watermark (latest event time - 10 minutes) has reached its end
CLOSED = "w1 <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@query("H01_stream_sliding_windows", f"""
WITH x AS (SELECT event_type, value AS v, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS w0 FROM events),
g AS (SELECT event_type, w0, w0 + INTERVAL 1 HOUR AS w1, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, max(abs(v)) AS max_abs FROM x GROUP BY 1, 2)
SELECT event_type, strftime(w0, {STAMP}) AS w0, strftime(w1, {STAMP}) AS w1, n, mean, var, max_abs FROM g WHERE {CLOSED}""")
def h01(spark, d):
    out = features.run_to_table(features.stream_windows(live_events(spark, d), ["event_type"], "1 hour", "15 minutes", "10 minutes"))
    return out.select("event_type", text("w0"), text("w1"), "n", r6("mean").alias("mean"), r6("var").alias("var"), "max_abs")


@query("H02_stream_tumbling_rms", f"""
WITH g AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w0, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w1, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1, 2)
SELECT event_type, strftime(w0, {STAMP}) AS w0, strftime(w1, {STAMP}) AS w1, n, rms FROM g WHERE {CLOSED}""")
def h02(spark, d):
    out = features.run_to_table(features.stream_energy(live_events(spark, d), ["event_type"], "1 hour", "10 minutes"))
    return out.select("event_type", text("w0"), text("w1"), "n", r6("rms").alias("rms"))


# four batches: rows to 15 January, to 20 January, then those of the 5th (behind the watermark of the first) with those to 25 January, then the rest
PART = """CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN 2 WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 0
  WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 1 WHEN CAST(ts AS DATE) < DATE '2024-01-25' THEN 2 ELSE 3 END"""


@query("H06_stream_late_rows", f"""
WITH g AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w0, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w1, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms
  FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-05' GROUP BY 1, 2)
SELECT event_type, strftime(w0, {STAMP}) AS w0, strftime(w1, {STAMP}) AS w1, n, rms FROM g WHERE {CLOSED}""")
def h06(spark, d):
    """Rows that come when the watermark has passed their windows are dropped, and only those."""
    path = scratch(spark, "late")
    rows = table(spark, d, "events").withColumn("_part", F.expr(PART))
    for part in range(4):
        # one file for each micro-batch, in this order
        rows.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    live = raw.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    out = features.run_to_table(features.stream_energy(live, ["event_type"], "1 hour", "10 minutes"))
    return out.select("event_type", text("w0"), text("w1"), "n", r6("rms").alias("rms"))


@query("H04_stream_sessions", f"""
WITH l AS (SELECT event_type, ts, value AS v, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WHERE value > 40),
r AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l),
g AS (SELECT event_type, min(ts) AS w0, max(ts) + INTERVAL 30 MINUTE AS w1, count(*) AS n, max(v) AS peak FROM r GROUP BY event_type, g)
SELECT event_type, strftime(w0, {STAMP}) AS t_on, strftime(w1, {STAMP}) AS t_off, n, peak FROM g
WHERE w1 <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE value > 40)""")
def h04(spark, d):
    out = features.run_to_table(features.stream_sessions(live_events(spark, d), ["event_type"], 40.0, "30 minutes", "10 minutes", value="v"))
    return out.select("event_type", text("t_on"), text("t_off"), "n", "peak")


# rows of buckets that the watermark has passed; an event ends at a row below, or before 12 silent hours
LIVE = DETECTIONS.replace("st AS (", f"""w AS (SELECT time_bucket(INTERVAL 1 MINUTE, max(ts) - INTERVAL 10 MINUTE) AS until FROM events),
q AS (SELECT user_id, i, ts, sum(CASE WHEN gap >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS part FROM (
  SELECT user_id, i, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM s WHERE ts < (SELECT until FROM w))),
cp AS (SELECT cf.user_id, cf.i, cf.cf, q.part FROM cf JOIN q ON cf.user_id = q.user_id AND cf.i = q.i),
st AS (""").replace("SELECT user_id, i, coalesce(last_value", "SELECT user_id, part, i, coalesce(last_value").replace(
    "OVER (PARTITION BY user_id ORDER BY i), 0) AS on_ FROM cf)", "OVER (PARTITION BY user_id, part ORDER BY i), 0) AS on_ FROM cp)"
).replace("lag(on_, 1, 0) OVER (PARTITION BY user_id ORDER BY i)", "lag(on_, 1, 0) OVER (PARTITION BY user_id, part ORDER BY i)").replace(
    "sum(e) OVER (PARTITION BY user_id ORDER BY i) AS r", "sum(e) OVER (PARTITION BY user_id, part ORDER BY i) AS r"
).replace("det AS (SELECT user_id, min(i)", "det AS (SELECT user_id, part, min(i)").replace("GROUP BY user_id, r HAVING", "GROUP BY user_id, part, r HAVING")


@query("H03_stream_trigger", f"""WITH {LIVE},
e AS (SELECT user_id, part, max(i) + 1 AS n, max(ts) AS last_ts FROM q GROUP BY user_id, part),
f AS (SELECT user_id, max(part) AS part FROM q GROUP BY user_id)
SELECT user_id, on_i, off_i, CASE WHEN off_i < n THEN 'below' ELSE 'silence' END AS closed_by FROM det JOIN e USING (user_id, part)
WHERE off_i < n OR part < (SELECT part FROM f WHERE f.user_id = det.user_id) OR last_ts + INTERVAL 12 HOUR < (SELECT until FROM w)""")
def h03(spark, d):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        live = stream_trigger(live_events(spark, d), ["user_id"], 3, 10, 1.8, 0.8, 2, "10 minutes", 12 * 3_600_000)
        out = features.run_to_table(live)
        return out.select("user_id", "on_i", "off_i", "closed_by")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


@query("H05_stream_scoring")
def h05(spark, d):
    w = model_windows(spark, d)
    fitted = M.fit_pca(w.where("label = 0"), 8)
    live = features.stream_table(spark, d, "embeddings", "vec_id bigint, embedding array<float>, label int")
    live = live.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return features.run_to_table(features.stream_detect(live, fitted, 0.01)).select("vec_id", r6("err").alias("err"), "pred")


@query("H05_stream_scoring_fixed", f"WITH {FIXED_ERRORS} SELECT vec_id, round(err, 6) AS err, CASE WHEN err > 0.02 THEN 1 ELSE 0 END AS pred FROM err")
def h05_fixed(spark, d):
    """The stream scored by a network whose weights follow a rule."""
    live = features.stream_table(spark, d, "embeddings", "vec_id bigint, embedding array<float>, label int")
    live = live.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return features.run_to_table(features.stream_detect(live, fixed_model(), 0.02)).select("vec_id", r6("err").alias("err"), "pred")
