from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import select
from tracewell.operators.ordered import add_index
from tracewell.operators.splits import ranked_fraction
from tracewell.queries.registry import TYPE_SAMPLES, USER_SAMPLES, event_samples, query, r6, table
from tracewell.sources.files import base_name, net_sta, rebase_path, stem


@query("B01_channel_filter", """
SELECT event_id, user_id, event_type FROM events
WHERE event_type LIKE '%r' AND user_id IN (1, 2, 3, 5, 8, 13, 21) OR event_type IN ('view')""")
def b01(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    by_suffix = select.channels(e.where(F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21)), suffix="r", channel="event_type")
    return by_suffix.unionByName(select.channels(e, codes=["view"], channel="event_type"))


@query("B02_first_match_or_first", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY CASE WHEN event_type LIKE '%up' THEN 0 ELSE 1 END, ts, event_id) AS rn FROM events) WHERE rn = 1""")
def b02(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return select.first_match(e, ["user_id"], ["ts", "event_id"], F.col("event_type").endswith("up")).drop("ts")


@query("B03_usable_files", """
SELECT o_orderkey AS arquivo, o_totalprice / 10000 AS razao_var FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice / 10000 > 10""")
def b03(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("arquivo"), (F.col("o_totalprice") / 10000).alias("razao_var"),
        (F.col("o_orderstatus") == "F").alias("xml_disponivel"))
    return select.usable(o).drop("xml_disponivel")


@query("B04_event_filter", """
SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate)
    ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders WHERE o_totalprice BETWEEN 100000 AND 450000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
WHERE rn <= 60""")
def b04(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    kept = select.events_between(o, "o_totalprice", 100000, 450000, "o_orderdate", "1996-01-01", "1999-01-01")
    months = kept.withColumn("m", F.date_trunc("month", "o_orderdate"))
    return select.top_k_per(months, ["m"], "o_totalprice", 60, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("B05_time_slice", """
SELECT event_id, user_id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def b05(spark, d):
    e = select.time_slice(table(spark, d, "events"), "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return e.select("event_id", "user_id", "value")


@query("B06_head_of_trace", f"WITH {USER_SAMPLES} SELECT user_id, i, v FROM s WHERE i < 5")
def b06(spark, d):
    return select.head(event_samples(spark, d), 5).select("user_id", "i", "v")


@query("B07_reject_unusable", """
SELECT user_id, event_type, count(*) AS n, round(stddev_pop(value), 6) AS std,
  CASE WHEN count(*) < 8 THEN 'short' WHEN stddev_pop(value) < 20 THEN 'flat' ELSE 'ok' END AS status
FROM events GROUP BY 1, 2""")
def b07(spark, d):
    out = select.reject_flat(table(spark, d, "events"), ["user_id", "event_type"], eps=20.0, min_rows=8, value="value")
    return out.select("user_id", "event_type", "n", r6("std").alias("std"), "status")


@query("B07_bad_arrays", """
SELECT vec_id, (embedding IS NULL OR len(embedding) <> 64 OR len([x for x in embedding if x IS NULL OR isnan(x)]) > 0) AS bad
FROM embeddings""")
def b07_arrays(spark, d):
    return table(spark, d, "embeddings").select("vec_id", select.bad_array("embedding", 64).alias("bad"))


@query("B08_classify", """
SELECT o_orderkey, CASE WHEN o_totalprice / 30000 < 2 THEN 'ruido' WHEN o_totalprice / 30000 <= 10 THEN 'ambiguo' ELSE 'evento_claro' END AS classificacao
FROM orders""")
def b08(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 30000).alias("razao_var"))
    return select.classify(o, "razao_var").drop("razao_var")


@query("B09_magnitude_buckets", """
SELECT bucket, count(*) AS n FROM (SELECT CASE
  WHEN m >= 2.5 AND m < 3 THEN '[2.5,3)' WHEN m >= 3 AND m < 3.5 THEN '[3,3.5)' WHEN m >= 3.5 AND m < 4 THEN '[3.5,4)'
  WHEN m >= 4 AND m < 5 THEN '[4,5)' WHEN m >= 5 AND m < 10 THEN '[5,10)' END AS bucket
  FROM (SELECT o_totalprice / 50000 AS m FROM orders)) GROUP BY 1""")
def b09(spark, d):
    o = table(spark, d, "orders").select(select.bucket(F.col("o_totalprice") / 50000).alias("bucket"))
    return o.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("B10_null_paths", """
SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey WHERE o_custkey IS NULL""")
def b10(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey").distinct()
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_custkey IS NULL").select("c_custkey")


@query("B11_key_derivation", r"""
SELECT page_id, regexp_extract(url, '([^/\\]+)$', 1) AS base,
  regexp_replace(regexp_extract(url, '([^/\\]+)$', 1), '\.[^.]*$', '') AS stem,
  concat_ws('.', 'N' || (page_id % 7), 'S' || (page_id % 11)) AS net_sta,
  CASE WHEN instr(url, 'example') > 0 THEN '/data/' || substr(url, instr(url, 'example')) ELSE url END AS moved
FROM pages""")
def b11(spark, d):
    p = table(spark, d, "pages").select("page_id", "url").withColumns({
        "net": F.concat(F.lit("N"), F.col("page_id") % 7), "sta": F.concat(F.lit("S"), F.col("page_id") % 11)})
    return p.select("page_id", base_name("url").alias("base"), stem("url").alias("stem"), net_sta("net", "sta").alias("net_sta"),
                    rebase_path("url", "example", "/data").alias("moved"))


@query("K01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def k01(spark, d):
    return select.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("K02_argmax_row", """
SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 1""")
def k02(spark, d):
    return select.argmax_row(table(spark, d, "events").select("event_id", "user_id", "value"), "value", ["event_id"])


@query("K03_sort_limit", "SELECT url FROM pages ORDER BY url, page_id LIMIT 50")
def k03(spark, d):
    return table(spark, d, "pages").orderBy("url", "page_id").limit(50).select("url")


@query("K04_sample_n", """
SELECT event_id FROM events ORDER BY ((event_id * 7919 + 42) % 1000003) / 1000003.0, event_id LIMIT 500""")
def k04(spark, d):
    u = ((F.col("event_id") * 7919 + 42) % 1000003) / F.lit(1000003.0)
    return select.sample_n(table(spark, d, "events").select("event_id"), 500, ["event_id"], fraction=u)


@query("K05_union", """
SELECT 'event' AS tipo, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT value FROM events WHERE event_type = 'error' UNION ALL SELECT value FROM events WHERE event_type <> 'error')""")
def k05(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    both = e.where("event_type = 'error'").unionByName(e.where("event_type <> 'error'"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).withColumn("tipo", F.lit("event"))


@query("K06_set_difference", """
SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07""")
def k06(spark, d):
    busy = table(spark, d, "lineitem").where("l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey").distinct().join(busy.distinct(), "s_suppkey", "left_anti")


@query("K07_key_set", "SELECT DISTINCT source, lang FROM documents")
def k07(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("E13_ranked_fraction", """
SELECT event_id, round((row_number() OVER (ORDER BY ts, event_id) - 1) / count(*) OVER (), 9) AS frac FROM events""")
def e13(spark, d):
    out = ranked_fraction(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"])
    return out.select("event_id", r6("frac", 9).alias("frac"))


@query("E14_best_so_far", f"""WITH {TYPE_SAMPLES}
SELECT event_type, i, min(v) OVER (PARTITION BY event_type ORDER BY i) AS best FROM s""")
def e14(spark, d):
    s = event_samples(spark, d, "event_type")
    return select.best_so_far(s, ["event_type"], "i", "v").select("event_type", "i", "best")


@query("E15_dedupe_first", """
SELECT o_custkey, o_orderstatus, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def e15(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return select.dedupe(o, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("E16_dedupe_largest", """
SELECT source, lang, doc_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def e16(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return select.dedupe(docs, ["source", "lang"], ["doc_id"], keep="largest", size="n_chars")


@query("S05_index_of_trace", f"WITH {USER_SAMPLES} SELECT user_id, event_id, i FROM s")
def index_of_trace(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return add_index(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "i")
