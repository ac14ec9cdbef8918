from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import trigger as T
from tracewell.operators.ordered import add_index
from tracewell.operators.variance import event_estimate, moving_variance
from tracewell.queries.joins import DETECTIONS
from tracewell.queries.registry import (
    SUPPLIER_SAMPLES,
    TYPE_SAMPLES,
    USER_SAMPLES,
    event_samples,
    query,
    r6,
    supplier_samples,
)

U = ["user_id"]


def _cf(spark, d, mode, ns=3, nl=10, **kw):
    return T.sta_lta(event_samples(spark, d), U, ns, nl, mode, **kw).select("user_id", "i", r6("cf").alias("cf"))


def _over(lo, hi):
    a = f"{-lo} PRECEDING"
    b = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING" if hi < 0 else f"{hi} FOLLOWING"
    return f"coalesce(sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {a} AND {b}), 0)"


@query("E01_moving_variance", f"""WITH {TYPE_SAMPLES},
n AS (SELECT event_type, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT event_type, len, unnest(generate_series(0, (len - 41) // 20)) AS k FROM n WHERE len > 40)
SELECT k.event_type, k.k, k.k * 20 + 20 AS i_mid, round(var_pop(s.v), 6) AS var
FROM k JOIN s ON s.event_type = k.event_type AND s.i >= k.k * 20 AND s.i < k.k * 20 + 40 GROUP BY 1, 2""")
def e01(spark, d):
    mv = moving_variance(event_samples(spark, d, "event_type"), ["event_type"], 40)
    return mv.select("event_type", "k", "i_mid", r6("var").alias("var"))


@query("E02_event_time_estimate", f"""WITH {USER_SAMPLES},
n AS (SELECT user_id, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT user_id, unnest(generate_series(0, (len - 11) // 5)) AS k FROM n WHERE len > 10),
va AS (SELECT k.user_id, k.k, var_pop(s.v) AS var FROM k JOIN s ON s.user_id = k.user_id AND s.i >= k.k * 5 AND s.i < k.k * 5 + 10 GROUP BY 1, 2)
SELECT user_id, round(min(var), 4) AS var_min, round(max(var), 4) AS var_max, round(max(var) / (min(var) + 1e-10), 4) AS razao_var,
  round(arg_min(k, (-round(var, 6), k)) * 0.5, 1) AS t_evento_est FROM va GROUP BY 1""")
def e02(spark, d):
    est = event_estimate(moving_variance(event_samples(spark, d), U, 10), U)
    return est.select("user_id", *[F.round(c, 4).alias(c) for c in ("var_min", "var_max", "razao_var")], "t_evento_est")


@query("E03_sta_lta_causal", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END, 6) AS cf FROM (
  SELECT user_id, i, {_over(-2, 0)} / 3 AS sta, {_over(-9, 0)} / 10 AS lta FROM s)""")
def e03(spark, d):
    return _cf(spark, d, "causal")


@query("E03_sta_lta_long_window", f"""WITH {SUPPLIER_SAMPLES}
SELECT l_suppkey, i, round(CASE WHEN lta > 1e-20 THEN sta / lta ELSE 0 END, 6) AS cf FROM (
  SELECT l_suppkey, i, sum(v * v) OVER (PARTITION BY l_suppkey ORDER BY i ROWS 19 PRECEDING) / 20 AS sta,
    sum(v * v) OVER (PARTITION BY l_suppkey ORDER BY i ROWS 399 PRECEDING) / 400 AS lta FROM s)""")
def e03_long(spark, d):
    cf = T.sta_lta(supplier_samples(spark, d), ["l_suppkey"], 20, 400)
    return cf.select("l_suppkey", "i", r6("cf").alias("cf"))


@query("E04_sta_lta_manual", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN i >= 10 AND lta > 0 THEN sta / lta ELSE 0 END, 6) AS cf FROM (
  SELECT user_id, i, {_over(-3, -1)} / 3 AS sta, {_over(-10, -1)} / 10 AS lta FROM s)""")
def e04(spark, d):
    return _cf(spark, d, "manual")


@query("E05_sta_lta_centred", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN i < 10 THEN 0 ELSE sta / (lta + 1e-10) END, 6) AS cf FROM (
  SELECT user_id, i, {_over(-1, 1)} / 3 AS sta, {_over(-5, 4)} / 10 AS lta FROM s)
WHERE user_id IN (SELECT user_id FROM s GROUP BY 1 HAVING count(*) >= 10)""")
def e05(spark, d):
    return _cf(spark, d, "centred")


@query("E06_sta_lta_classic", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN i >= 19 AND lta > 0 THEN sta / lta ELSE 0 END, 6) AS cf FROM (
  SELECT user_id, i, {_over(-4, 0)} / 5 AS sta, {_over(-19, 0)} / 20 AS lta FROM s)""")
def e06(spark, d):
    return _cf(spark, d, "classic", 5, 20)


@query("E07_sta_lta_recursive", f"""WITH RECURSIVE {USER_SAMPLES},
r AS (SELECT user_id, i, v * v / 3 AS sta, v * v / 10 AS lta FROM s WHERE i = 0
  UNION ALL SELECT s.user_id, s.i, s.v * s.v / 3 + r.sta * (1 - 1 / 3.0), s.v * s.v / 10 + r.lta * (1 - 1 / 10.0)
  FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, i, round(CASE WHEN i >= 10 AND lta > 0 THEN sta / lta ELSE 0 END, 6) AS cf FROM r""")
def e07(spark, d):
    return _cf(spark, d, "recursive")


@query("E07_sta_lta_recursive_long", f"""WITH RECURSIVE {TYPE_SAMPLES},
r AS (SELECT event_type, i, v * v / 20 AS sta, v * v / 500 AS lta FROM s WHERE i = 0
  UNION ALL SELECT s.event_type, s.i, s.v * s.v / 20 + r.sta * (1 - 1 / 20.0), s.v * s.v / 500 + r.lta * (1 - 1 / 500.0)
  FROM r JOIN s ON s.event_type = r.event_type AND s.i = r.i + 1)
SELECT event_type, i, round(CASE WHEN i >= 500 AND lta > 0 THEN sta / lta ELSE 0 END, 6) AS cf FROM r""")
def e07_long(spark, d):
    """Traces of thousands of rows in chunks of 256: the state goes through many of them."""
    out = T.sta_lta(event_samples(spark, d, "event_type"), ["event_type"], 20, 500, "recursive", chunk=256)
    return out.select("event_type", "i", r6("cf").alias("cf"))


@query("E08_sta_lta_delayed", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN i >= 12 AND lta > 0 THEN sta / lta ELSE 0 END, 6) AS cf FROM (
  SELECT user_id, i, {_over(-2, 0)} / 3 AS sta, {_over(-12, -3)} / 10 AS lta FROM s)""")
def e08(spark, d):
    return _cf(spark, d, "delayed")


@query("E09_z_detector", f"""WITH {USER_SAMPLES},
a AS (SELECT user_id, i, {_over(-2, 0)} / 3 AS sta FROM s)
SELECT user_id, i, round(CASE WHEN stddev_pop(sta) OVER w > 0 THEN (sta - avg(sta) OVER w) / stddev_pop(sta) OVER w ELSE 0 END, 6) AS cf
FROM a WINDOW w AS (PARTITION BY user_id)""")
def e09(spark, d):
    return _cf(spark, d, "zdetect")


@query("E10_carl_trigger", f"""WITH {USER_SAMPLES},
m AS (SELECT user_id, i, v, sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) / 3 AS sta,
  sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) / 10 AS lta FROM s),
x AS (SELECT *, sum(abs(v - lta)) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) / 3 AS star,
  sum(abs(v - lta)) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING) / 10 AS ltar FROM m)
SELECT user_id, i, round(CASE WHEN i < 10 THEN -1 ELSE star - 0.8 * ltar - abs(sta - lta) - 0.8 END, 6) AS cf FROM x""")
def e10(spark, d):
    return _cf(spark, d, "carl")


@query("E11_hysteresis_trigger", f"WITH {DETECTIONS} SELECT user_id, on_i, off_i FROM det")
def e11(spark, d):
    cf = T.sta_lta(event_samples(spark, d), U, 3, 10, keep_chunk=True)
    return T.trigger(cf, U, 1.8, 0.8, 2).select("user_id", "on_i", "off_i")


@query("E11_drop_open_events", f"""WITH {DETECTIONS}
SELECT user_id, on_i, off_i FROM det WHERE off_i < (SELECT max(i) + 1 FROM s WHERE s.user_id = det.user_id)""")
def e11_drop(spark, d):
    cf = T.sta_lta(event_samples(spark, d), U, 3, 10, keep_chunk=True)
    return T.trigger(cf, U, 1.8, 0.8, 2, close_open=False).select("user_id", "on_i", "off_i")


INCLUSIVE = (DETECTIONS.replace("cf > 1.8", "cf >= 2.0").replace("cf < 0.8", "cf <= 1.0").replace(" >= 2)", " >= 0)"))


@query("E12_hysteresis_inclusive", f"WITH {INCLUSIVE} SELECT user_id, on_i, off_i FROM det")
def e12(spark, d):
    cf = T.sta_lta(event_samples(spark, d), U, 3, 10, keep_chunk=True)
    return T.trigger(cf, U, 2.0, 1.0, 0, inclusive=True).select("user_id", "on_i", "off_i")


CHANNEL_DETECTIONS = """s AS (SELECT user_id, event_type, value AS v,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i FROM events),
st AS (SELECT user_id, event_type, i, coalesce(last_value(CASE WHEN v > 60 THEN 1 WHEN v < 30 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY user_id, event_type ORDER BY i), 0) AS on_ FROM s),
ed AS (SELECT *, CASE WHEN on_ <> lag(on_, 1, 0) OVER (PARTITION BY user_id, event_type ORDER BY i) THEN 1 ELSE 0 END AS e FROM st),
rn AS (SELECT *, sum(e) OVER (PARTITION BY user_id, event_type ORDER BY i) AS r FROM ed),
det AS (SELECT user_id, event_type, min(i) AS on_i, max(i) + 1 AS off_i FROM rn WHERE on_ = 1 GROUP BY user_id, event_type, r)"""


@query("E18_channel_coincidence", f"""WITH {CHANNEL_DETECTIONS},
lv AS (SELECT user_id, i, count(*) AS n FROM (SELECT user_id, unnest(generate_series(on_i, off_i - 1)) AS i FROM det) GROUP BY 1, 2 HAVING count(*) >= 2),
isl AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM lv)
SELECT user_id, min(i) AS on_i, max(i) + 1 AS off_i FROM isl GROUP BY user_id, g""")
def e18(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "ts", "event_id", F.col("value").alias("cf"))
    from tracewell.operators.ordered import add_index

    cf = add_index(e, ["user_id", "event_type"], ["ts", "event_id"])
    det = T.trigger(cf, ["user_id", "event_type"], 60.0, 30.0)
    return T.coincidence(det, U, "event_type", 2).select("user_id", "on_i", "off_i")


@query("E19_pre_post_memory", f"""WITH {DETECTIONS},
x AS (SELECT user_id, greatest(on_i - 2, 0) AS a, off_i + 3 AS b FROM det),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM x),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb < a THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS on_i, max(b) AS off_i FROM g GROUP BY user_id, g""")
def e19(spark, d):
    cf = T.sta_lta(event_samples(spark, d), U, 3, 10, keep_chunk=True)
    return T.extend_merge(T.trigger(cf, U, 1.8, 0.8, 2), U, 2, 3).select("user_id", "on_i", "off_i")


@query("E20_autocorrelation", f"""WITH {TYPE_SAMPLES}, l AS (SELECT 1 AS lag UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 20)
SELECT a.event_type, l.lag, round(corr(a.v, b.v), 6) AS r FROM s a JOIN l ON true
JOIN s b ON b.event_type = a.event_type AND b.i = a.i - l.lag GROUP BY 1, 2""")
def e20(spark, d):
    out = T.autocorrelation(event_samples(spark, d, "event_type"), ["event_type"], [1, 2, 5, 20])
    return out.select("event_type", "lag", r6("r").alias("r"))
