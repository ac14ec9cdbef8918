from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import splits as S
from tracewell.plans import jobs
from tracewell.queries.registry import USER_SAMPLES, event_samples, query, r6, table

# an arithmetic hash, so that SQL can follow the seeded orders
STATION_HASH = "((CAST(substr(source, 4) AS BIGINT) * 7919 + 42) % 1009)"


def station_hash():
    return (F.substring("source", 4, 10).cast("bigint") * 7919 + 42) % 1009


@query("G01_ordered_split", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, CASE WHEN pos < trunc(n * 0.70) THEN 'train' WHEN pos < trunc(n * 0.70) + trunc(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p""")
def g01(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return S.split_ordered(e, ["vec_id"], by=["label"]).select("vec_id", "split")


@query("G02_station_split", f"""
WITH st AS (SELECT source, row_number() OVER (ORDER BY {STATION_HASH}, source) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN pos < trunc(n * 0.70) THEN 'train' WHEN pos < trunc(n * 0.85) THEN 'val' ELSE 'test' END AS split
FROM documents JOIN st USING (source)""")
def g02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return S.split_group(docs, "source", order=station_hash()).select("doc_id", "source", "split")


@query("G03_temporal_split", """
WITH p AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) / count(*) OVER () AS frac FROM events)
SELECT event_id, CASE WHEN frac < 0.70 THEN 'train' WHEN frac < 0.85 THEN 'val' ELSE 'test' END AS split FROM p""")
def g03(spark, d):
    return S.split_temporal(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "split")


@query("G04_random_split", """
SELECT doc_id, CASE WHEN ((doc_id * 7919 + 42) % 1000003) / 1000003.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents""")
def g04(spark, d):
    u = ((F.col("doc_id") * 7919 + 42) % 1000003) / F.lit(1000003.0)
    return S.split_random(table(spark, d, "documents").select("doc_id"), ["doc_id"], fraction=u)


LABELLED = f"""st AS (SELECT source, row_number() OVER (ORDER BY {STATION_HASH}, source) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
w AS (SELECT d.doc_id, d.source, d.lang, l.toxic AS label, CASE WHEN pos < trunc(n * 0.70) THEN 'train' WHEN pos < trunc(n * 0.85) THEN 'val' ELSE 'test' END AS split
FROM documents d JOIN labels l USING (doc_id) JOIN st USING (source))"""


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    marked = S.split_group(docs, "source", order=station_hash())
    return marked.join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@query("G05_dataset_info", f"""WITH {LABELLED}
SELECT count(*) AS n_total, round(avg(label), 8) AS prevalence,
  string_agg(c, ',' ORDER BY c) AS counts, (SELECT string_agg(split || '=' || k, ',' ORDER BY split) FROM (SELECT split, count(DISTINCT source) AS k FROM w GROUP BY 1)) AS stations
FROM (SELECT label, split || '_label' || label || '=' || count(*) OVER (PARTITION BY split, label) AS c0,
  CASE WHEN row_number() OVER (PARTITION BY split, label) = 1 THEN split || '_label' || label || '=' || count(*) OVER (PARTITION BY split, label) END AS c FROM w)""")
def g05(spark, d):
    info = S.dataset_info(labelled(spark, d), {"versao": "1.0"}, station="source")
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return info.select("n_total", r6("prevalence", 8).alias("prevalence"), text(F.col("counts")).alias("counts"), text(F.col("stations")).alias("stations"))


@query("G06_yield_by_file", f"""WITH {LABELLED}
SELECT source AS file, count(DISTINCT lang) AS n_stations, count(*) FILTER (label = 0) AS n_noise, count(*) FILTER (label = 1) AS n_event FROM w GROUP BY 1""")
def g06(spark, d):
    return S.yield_by_file(labelled(spark, d).withColumnRenamed("source", "file"), station="lang")


@query("G07_rejection_ledger", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_metadata' WHEN n_chars < 200 THEN 'short' WHEN quality = 0 THEN 'bad' ELSE 'ok' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def g07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "no_metadata").when(F.col("n_chars") < 200, "short").when(F.col("quality") == 0, "bad").otherwise("ok")
    return S.ledger(docs.withColumn("status", status))


@query("J01_dataset_build", f"""WITH {USER_SAMPLES}, kn AS (SELECT s.* FROM s WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)),
m AS (SELECT user_id, max(CASE WHEN v > 300 THEN 1 ELSE 0 END) AS label, max(i) + 1 AS len FROM kn GROUP BY 1),
r AS (SELECT user_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, max(i) + 1 AS n FROM kn GROUP BY 1),
c AS (SELECT user_id, i, (v - (a + b * i)) * CASE WHEN least(i, n - 1 - i) < trunc(n * 0.05) THEN 0.5 * (1 - cos(pi() * least(i, n - 1 - i) / trunc(n * 0.05))) ELSE 1 END AS v FROM kn JOIN r USING (user_id)),
w AS (SELECT user_id, label, 0 AS k, len // 2 - 10 AS s0 FROM m WHERE label = 1 AND len >= 20
  UNION ALL SELECT user_id, label, k, k * 10 FROM (SELECT user_id, label, unnest(generate_series(0, (len - 20) // 10)) AS k FROM m WHERE label = 0 AND len >= 20)),
st AS (SELECT user_id, row_number() OVER (ORDER BY (user_id * 7919 + 42) % 1009, user_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM w)),
tp AS (SELECT user_id, k, (row_number() OVER (ORDER BY t0, user_id, k) - 1) / count(*) OVER () AS frac FROM w JOIN (SELECT user_id, min(ts) AS t0 FROM kn GROUP BY 1) USING (user_id)),
x AS (SELECT w.user_id, w.label, w.k, c.i - w.s0 AS pos, c.v FROM w JOIN c ON c.user_id = w.user_id AND c.i >= w.s0 AND c.i < w.s0 + 20)
SELECT x.user_id, x.label, x.k, x.pos, round((v - avg(v) OVER q) / stddev_pop(v) OVER q, 5) AS v,
  CASE WHEN st.pos < trunc(n * 0.70) THEN 'train' WHEN st.pos < trunc(n * 0.85) THEN 'val' ELSE 'test' END AS split_estacao,
  CASE WHEN tp.frac < 0.70 THEN 'train' WHEN tp.frac < 0.85 THEN 'val' ELSE 'test' END AS split_temporal
FROM x JOIN st USING (user_id) JOIN tp ON tp.user_id = x.user_id AND tp.k = x.k WINDOW q AS (PARTITION BY x.user_id, x.k)""")
def j01(spark, d):
    s = event_samples(spark, d).withColumn("station", F.col("user_id"))
    stations = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("station"))
    out = jobs.build_dataset(s, stations, ["user_id"], "station", 40.0, 20, 10, F.col("v") > 300, "ts",
                             group_order=(F.col("net_sta") * 7919 + 42) % 1009)
    return out.select("user_id", "label", "k", "split_estacao", "split_temporal", F.posexplode("x").alias("pos", "v")).withColumn("v", F.round("v", 5))


@query("J04_dataset_ledger", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rn > 1 THEN 'duplicate' WHEN station NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'no_station'
  WHEN len < 20 THEN 'short' ELSE 'used' END AS reason
FROM (SELECT user_id, station, len, row_number() OVER (PARTITION BY station ORDER BY t0, user_id) AS rn
  FROM (SELECT user_id, user_id // 2 * 2 AS station, count(*) AS len, min(ts) AS t0 FROM events GROUP BY 1))) GROUP BY 1""")
def j04(spark, d):
    """Two users share a station; the first one to start counts."""
    s = table(spark, d, "events").select("user_id", "ts", (F.floor(F.col("user_id") / 2) * 2).alias("station"))
    stations = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("station"))
    return jobs.dataset_ledger(s, stations, ["user_id"], "station", 20, "ts", one_of=["station"])


@query("J02_file_inventory", f"""WITH {USER_SAMPLES}, n AS (SELECT user_id, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT user_id, unnest(generate_series(0, (len - 11) // 5)) AS k FROM n WHERE len > 10),
va AS (SELECT k.user_id, k.k, var_pop(s.v) AS var FROM k JOIN s ON s.user_id = k.user_id AND s.i >= k.k * 5 AND s.i < k.k * 5 + 10 GROUP BY 1, 2),
e AS (SELECT user_id, round(min(var), 2) AS var_min, round(max(var), 2) AS var_max, round(max(var) / (min(var) + 1e-10), 1) AS razao_var,
  round(arg_min(k, (-round(var, 6), k)) * 0.5, 1) AS t_evento_est FROM va GROUP BY 1),
b AS (SELECT user_id, count(*) AS n_amostras, count(*) / 10.0 AS duracao_s, round(var_pop(v), 2) AS var_global FROM s GROUP BY 1)
SELECT user_id, n_amostras, duracao_s, var_global, var_min, var_max, razao_var, t_evento_est,
  user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS xml_disponivel,
  CASE WHEN var_max IS NULL THEN 'short' ELSE 'ok' END AS status,
  CASE WHEN razao_var < 2 THEN 'ruido' WHEN razao_var <= 10 THEN 'ambiguo' ELSE 'evento_claro' END AS classificacao
FROM b LEFT JOIN e USING (user_id)""")
def j02(spark, d):
    s = event_samples(spark, d).withColumns({"net": F.lit("U"), "sta": F.col("user_id").cast("string"), "cha": F.lit("BHZ")})
    # every second file holds another channel too, which doesn't count
    other = s.where("user_id % 2 = 0").withColumns({"cha": F.lit("BHE"), "v": F.col("v") * 3 + 1})
    s = s.unionByName(other)
    st = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("U").alias("net"), F.col("c_custkey").cast("string").alias("sta"))
    return jobs.file_inventory(s, "user_id", 10.0, st, prefer=F.col("cha").endswith("Z")).select(
        "user_id", "n_amostras", "duracao_s", "var_global", "var_min", "var_max", "razao_var", "t_evento_est", "xml_disponivel", "status", "classificacao")
