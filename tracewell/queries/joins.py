from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import joins, select
from tracewell.operators.intervals import detections_hit, label_overlap, truths_found
from tracewell.operators.trigger import sta_lta, to_seconds, trigger
from tracewell.queries.registry import USER_SAMPLES, event_samples, query, table


@query("C01_attach_station", """
SELECT l_suppkey, s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2""")
def c01(spark, d):
    # the trace side is reduced to one row per trace before it meets the metadata
    traces = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
    stations = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.attach_station(traces, stations, ["l_suppkey"])


@query("C02_name_contains_code", """
SELECT doc_id, min(code) AS code FROM (
  SELECT doc_id, source || '_' || lang || '_' || doc_id || '.ms' AS name, lang FROM documents) n
LEFT JOIN (SELECT DISTINCT source AS code, lang AS net FROM documents) st
  ON contains(n.name, st.code) AND contains(n.name, st.net) GROUP BY doc_id""")
def c02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    names = docs.select("doc_id", F.concat_ws("", "source", F.lit("_"), "lang", F.lit("_"), "doc_id", F.lit(".ms")).alias("name"))
    stations = docs.select(F.col("source").alias("code"), F.col("lang").alias("net")).distinct()
    return joins.attach_contains(names, stations, "name", "code", also="net", order=["code", "net"]).select("doc_id", "code")


@query("C03_pattern_priority", """
WITH st AS (SELECT s_suppkey, 'N' || s_nationkey AS net, 'S' || s_suppkey AS sta FROM supplier),
f AS (SELECT DISTINCT CASE WHEN c_mktsegment LIKE 'A%' THEN 'N' || c_nationkey || '_S' || c_custkey || '.xml'
   WHEN c_mktsegment LIKE 'B%' THEN 'N' || c_nationkey || '.S' || c_custkey || '.xml' ELSE 'S' || c_custkey || '.xml' END AS name FROM customer),
o AS (SELECT s_suppkey, 0 AS priority, net || '_' || sta || '.xml' AS name FROM st
  UNION ALL SELECT s_suppkey, 1, net || '.' || sta || '.xml' FROM st UNION ALL SELECT s_suppkey, 2, sta || '.xml' FROM st)
SELECT s_suppkey, min(priority) AS priority, arg_min(name, priority) AS name FROM o JOIN f USING (name) GROUP BY 1""")
def c03(spark, d):
    st = table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("net"), F.concat(F.lit("S"), "s_suppkey").alias("sta"))
    net, sta, seg = F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("S"), "c_custkey"), F.col("c_mktsegment")
    name = F.when(seg.startswith("A"), F.concat(net, F.lit("_"), sta, F.lit(".xml"))).when(
        seg.startswith("B"), F.concat(net, F.lit("."), sta, F.lit(".xml"))).otherwise(F.concat(sta, F.lit(".xml")))
    files = table(spark, d, "customer").select(name.alias("name"))
    xml = F.lit(".xml")
    patterns = [F.concat("net", F.lit("_"), "sta", xml), F.concat("net", F.lit("."), "sta", xml), F.concat("sta", xml)]
    return joins.pattern_lookup(st, files, patterns).select("s_suppkey", "priority", "name")


@query("C04_index_left_join", """
SELECT p_partkey, arg_max(path, ord) AS path FROM part LEFT JOIN (
  SELECT l_partkey, l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS path,
    (l_shipdate, l_orderkey || '/' || l_linenumber || '/' || l_suppkey) AS ord FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey GROUP BY 1""")
def c04(spark, d):
    index = table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_partkey").alias("p_partkey"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey").alias("path"), "l_shipdate")
    return joins.attach_index(table(spark, d, "part").select("p_partkey"), index, "p_partkey", "path", "l_shipdate")


@query("C05_exists_flag", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS xml_disponivel FROM customer""")
def c05(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return select.exists_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "xml_disponivel")


@query("C06_anti_join", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def c06(spark, d):
    return joins.without_station(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("C07_window_overlaps_truth", f"""WITH {USER_SAMPLES},
w AS (SELECT user_id, k, k * 4 AS w0, k * 4 + 8 AS w1 FROM (SELECT DISTINCT user_id, i // 4 AS k FROM s)),
t AS (SELECT user_id, i AS e0, i + 3 AS e1 FROM s WHERE event_type = 'error')
SELECT user_id, k, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.user_id = w.user_id AND w.w0 < t.e1 AND w.w1 > t.e0) THEN 1 ELSE 0 END AS label
FROM w""")
def c07(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    w = s.select("user_id", F.floor(F.col("i") / 4).alias("k")).distinct().withColumns({"w0": F.col("k") * 4, "w1": F.col("k") * 4 + 8})
    t = s.where("event_type = 'error'").select("user_id", F.col("i").alias("e0"), (F.col("i") + 3).alias("e1"))
    return label_overlap(w, t, ["user_id"]).select("user_id", "k", "label")


DETECTIONS = f"""{USER_SAMPLES},
cf AS (SELECT user_id, i, CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END AS cf FROM (
  SELECT user_id, i, sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) / 3 AS sta,
    sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) / 10 AS lta FROM s)),
st AS (SELECT user_id, i, coalesce(last_value(CASE WHEN cf > 1.8 THEN 1 WHEN cf < 0.8 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY i), 0) AS on_ FROM cf),
ed AS (SELECT *, CASE WHEN on_ <> lag(on_, 1, 0) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS e FROM st),
rn AS (SELECT *, sum(e) OVER (PARTITION BY user_id ORDER BY i) AS r FROM ed),
det AS (SELECT user_id, min(i) AS on_i, max(i) + 1 AS off_i FROM rn WHERE on_ = 1 GROUP BY user_id, r HAVING max(i) + 1 - min(i) >= 2)"""


@query("C08_match_detections", f"""WITH {DETECTIONS},
t AS (SELECT user_id, i AS t FROM s WHERE event_type = 'error')
SELECT user_id, on_i, off_i, EXISTS (SELECT 1 FROM t WHERE t.user_id = det.user_id
  AND (abs(on_i - t.t) <= 2 OR (on_i <= t.t AND t.t <= off_i))) AS hit FROM det""")
def c08(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    det = to_seconds(trigger(sta_lta(s, ["user_id"], 3, 10, keep_chunk=True), ["user_id"], 1.8, 0.8, 2), 1.0)
    truth = s.where("event_type = 'error'").select("user_id", F.col("i").alias("t"))
    return detections_hit(det, truth, ["user_id"], 2.0).select("user_id", "on_i", "off_i", "hit")


@query("C08_truth_found", f"""WITH {DETECTIONS},
t AS (SELECT user_id, i AS t FROM s WHERE event_type = 'error')
SELECT user_id, t, EXISTS (SELECT 1 FROM det WHERE t.user_id = det.user_id
  AND (abs(on_i - t.t) <= 2 OR (on_i <= t.t AND t.t <= off_i))) AS found FROM t""")
def c08_found(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    det = to_seconds(trigger(sta_lta(s, ["user_id"], 3, 10, keep_chunk=True), ["user_id"], 1.8, 0.8, 2), 1.0)
    truth = s.where("event_type = 'error'").select("user_id", F.col("i").alias("t"))
    return truths_found(det, truth, ["user_id"], 2.0).select("user_id", "t", "found")


@query("C10_coverage_gaps", """
SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u,
  (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) d
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND CAST(e.ts AS DATE) = d.day)""")
def c10(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return joins.coverage_gaps(e, e, ["user_id"], "day", "2024-01-01", "2024-01-30")


@query("C11_epoch_join", """
WITH ep AS (SELECT l_suppkey, date_trunc('quarter', l_shipdate) AS start, count(*) AS sens FROM lineitem
  WHERE l_linestatus = 'O' GROUP BY 1, 2),
e2 AS (SELECT *, CASE WHEN month(start) = 10 THEN NULL ELSE start + INTERVAL 45 DAY END AS stop FROM ep WHERE sens % 2 = 0)
SELECT l.l_suppkey, count(*) AS n, CAST(sum(e2.sens) AS BIGINT) AS sens
FROM (SELECT l_suppkey, date_trunc('month', l_shipdate) AS t0 FROM lineitem GROUP BY 1, 2) l
JOIN e2 ON l.l_suppkey = e2.l_suppkey AND l.t0 >= e2.start AND (e2.stop IS NULL OR l.t0 < e2.stop) GROUP BY 1""")
def c11(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_linestatus")
    ep = li.where("l_linestatus = 'O'").groupBy("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("start")).agg(
        F.count(F.lit(1)).alias("sens")).where("sens % 2 = 0")
    ep = ep.withColumn("end", F.when(F.month("start") != 10, F.expr("start + INTERVAL 45 DAYS")))
    traces = li.select("l_suppkey", F.date_trunc("month", "l_shipdate").alias("t0")).distinct()
    return joins.attach_epoch(traces, ep, ["l_suppkey"]).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sens").alias("sens"))


@query("C12_vector_magnitude", """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, round(sum(value), 2) AS v FROM events GROUP BY 1, 2, 3)
SELECT a.user_id, a.day, round(sqrt(a.v * a.v + b.v * b.v + c2.v * c2.v), 4) AS magnitude FROM c a
JOIN c b USING (user_id, day) JOIN c c2 USING (user_id, day)
WHERE a.event_type = 'click' AND b.event_type = 'view' AND c2.event_type = 'error'""")
def c12(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day"), "event_type").agg(
        F.round(F.sum("value"), 2).alias("v"))
    out = joins.vector_magnitude(e, ["user_id", "day"], "event_type", ["click", "view", "error"])
    return out.select("user_id", "day", F.round("magnitude", 4).alias("magnitude"))
