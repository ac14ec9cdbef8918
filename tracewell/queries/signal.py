from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import conditioning as C
from tracewell.operators import fourier
from tracewell.operators import spectra as S
from tracewell.operators import windows as W
from tracewell.operators.recurrence import butterworth_sections
from tracewell.queries.registry import SUPPLIER_SAMPLES, TYPE_SAMPLES, USER_SAMPLES, event_samples, query, r6, supplier_samples, table

EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def traces(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("data"))


def flat(df, *ids, x="x"):
    """Arrays as rows, so that both sides compare plain numbers."""
    return df.select(*ids, F.posexplode(x).alias("pos", "v")).withColumn("v", r6("v"))


@query("F01_make_windows", f"""WITH e AS ({EMB}), k AS (SELECT vec_id, x, unnest(generate_series(0, (len(x) - 16) // 8)) AS k FROM e WHERE len(x) >= 16)
SELECT vec_id, k, pos, round(x[k * 8 + pos + 1], 6) AS v FROM (SELECT *, unnest(generate_series(0, 15)) AS pos FROM k)""")
def f01(spark, d):
    return flat(W.make_windows(traces(spark, d), 16, 8), "vec_id", "k")


@query("F01_windows_from_samples", f"""WITH {TYPE_SAMPLES}, n AS (SELECT event_type, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT event_type, unnest(generate_series(0, (len - 40) // 20)) AS k FROM n WHERE len >= 40)
SELECT k.event_type, k.k, s.i - k.k * 20 AS pos, round(s.v, 6) AS v FROM k JOIN s ON s.event_type = k.event_type AND s.i >= k.k * 20 AND s.i < k.k * 20 + 40""")
def f01_long(spark, d):
    return flat(W.collect_windows(event_samples(spark, d, "event_type"), ["event_type"], 40, 20), "event_type", "k")


@query("F02_window_assignment", f"""WITH {USER_SAMPLES}
SELECT user_id, k, count(*) AS n, round(sum(v), 6) AS total FROM (
  SELECT user_id, i, v, unnest(generate_series(greatest(CAST(ceil((i - 9) / 4.0) AS BIGINT), 0), i // 4)) AS k FROM s) GROUP BY 1, 2""")
def f02(spark, d):
    rows = W.assign_windows(event_samples(spark, d), 10, 4)
    return rows.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total"))


@query("F03_zscore_window", f"""WITH e AS ({EMB}), l AS (SELECT vec_id, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS pos FROM e)
SELECT vec_id, pos, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM l WINDOW w AS (PARTITION BY vec_id)""")
def f03(spark, d):
    return flat(W.zscore(traces(spark, d).withColumnRenamed("data", "x")), "vec_id")


@query("F04_zscore_trace", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(CASE WHEN stddev_pop(v) OVER w < 1e-6 THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 6) AS z
FROM s WINDOW w AS (PARTITION BY user_id)""")
def f04(spark, d):
    return W.zscore_trace(event_samples(spark, d), ["user_id"]).select("user_id", "i", r6("z").alias("z"))


@query("F05_central_window", f"""WITH e AS ({EMB})
SELECT vec_id, pos, round(x[len(x) // 2 - 20 // 2 + 1 + pos], 6) AS v FROM (SELECT *, unnest(generate_series(0, 19)) AS pos FROM e)""")
def f05(spark, d):
    return flat(W.central_window(traces(spark, d), 20), "vec_id")


@query("F05_central_samples", f"""WITH {USER_SAMPLES}, n AS (SELECT user_id, max(i) + 1 AS len FROM s GROUP BY 1)
SELECT user_id, i - (len // 2 - 10) AS pos, v FROM s JOIN n USING (user_id) WHERE len >= 20 AND i - (len // 2 - 10) BETWEEN 0 AND 19""")
def f05_long(spark, d):
    return W.central_samples(event_samples(spark, d), ["user_id"], 20).select("user_id", "pos", "v")


@query("F06_pad_crop", f"""WITH e AS ({EMB})
SELECT vec_id, pos, round(CASE WHEN pos < len(x) THEN x[pos + 1] ELSE 0 END, 6) AS v FROM (SELECT *, unnest(generate_series(0, 79)) AS pos FROM e)""")
def f06(spark, d):
    return flat(W.pad_crop(traces(spark, d), 80), "vec_id")


@query("F07_split_noise_event", f"""WITH {USER_SAMPLES}, n AS (SELECT user_id, max(i) + 1 AS len, min(CASE WHEN event_type = 'error' AND i >= 20 THEN i END) / 2.0 AS t FROM s GROUP BY 1),
k AS (SELECT *, unnest(generate_series(0, (len - 8) // 4)) AS k FROM n WHERE len >= 8)
SELECT user_id, k, CASE WHEN k * 4 + 8 <= trunc((t - 3) * 2) THEN 'noise' ELSE 'event' END AS tipo FROM k
WHERE k * 4 + 8 <= trunc((t - 3) * 2) OR k * 4 >= trunc((t - 2) * 2)""")
def f07(spark, d):
    s = event_samples(spark, d, extra=("event_type",))
    t = s.groupBy("user_id").agg((F.min(F.when((F.col("event_type") == "error") & (F.col("i") >= 20), F.col("i"))) / 2.0).alias("t"))
    w = W.assign_windows(s, 8, 4).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n")).where("n = 8").join(t, "user_id")
    return W.split_noise_event(w, "t", 2.0, 8, 4).select("user_id", "k", "tipo")


@query("F08_file_label", """SELECT event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, count(*) AS n FROM events GROUP BY 1, 2""")
def f08(spark, d):
    e = table(spark, d, "events").select("event_type")
    both = W.label_source(e.where("event_type = 'error'"), 1).unionByName(W.label_source(e.where("event_type <> 'error'"), 0))
    return both.groupBy("event_type", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


TREND = "r AS (SELECT user_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, max(i) + 1 AS n FROM s GROUP BY 1)"
TAPER = "CASE WHEN least(i, n - 1 - i) < trunc(n * 0.05) THEN 0.5 * (1 - cos(pi() * least(i, n - 1 - i) / trunc(n * 0.05))) ELSE 1 END"


@query("F09_detrend", f"WITH {USER_SAMPLES}, {TREND} SELECT user_id, i, round(v - (a + b * i), 6) AS v FROM s JOIN r USING (user_id)")
def f09(spark, d):
    return C.detrend(event_samples(spark, d), ["user_id"]).select("user_id", "i", r6("v").alias("v"))


@query("F10_taper", f"WITH {USER_SAMPLES}, {TREND} SELECT user_id, i, round(v * {TAPER}, 6) AS v FROM s JOIN r USING (user_id)")
def f10(spark, d):
    return C.taper(event_samples(spark, d), ["user_id"]).select("user_id", "i", r6("v").alias("v"))


TAPS = C.sinc_taps(0.5, 15.0, 40.0, 10)
TAP_ROWS = ", ".join(f"({m - 10}, {float(h)!r})" for m, h in enumerate(TAPS))


@query("F11_bandpass_fir", f"""WITH {USER_SAMPLES}, h AS (SELECT * FROM (VALUES {TAP_ROWS}) t(m, h))
SELECT a.user_id, a.i, round(sum(CAST(h.h AS DOUBLE) * b.v), 6) AS v FROM s a JOIN h ON true JOIN s b ON b.user_id = a.user_id AND b.i = a.i - h.m GROUP BY 1, 2""")
def f11(spark, d):
    return C.bandpass_fir(event_samples(spark, d), ["user_id"], TAPS).select("user_id", "i", r6("v").alias("v"))


def filter_sql(name: str, source: str, key: str, sections, reverse: bool = False) -> str:
    """One recursive query: the rows of ``source`` (key, i, v) through second-order sections, from either end."""
    at, step = ("n.last", "- 1") if reverse else ("0", "+ 1")
    n = len(sections)
    first, later = [], []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections.tolist()):
        # in the recursive part other names, as its columns would hide them
        for out, z1, z2, y in ((first, "0.0", "0.0", "y"), (later, f"r.p{k}", f"r.q{k}", "w")):
            x = "s.v" if k == 0 else f"{y}{k - 1}"
            out += [f"{b0!r}::DOUBLE * {x} + {z1}::DOUBLE AS {y}{k}", f"{b1!r}::DOUBLE * {x} - {a1!r}::DOUBLE * {y}{k} + {z2}::DOUBLE AS p{k}",
                    f"{b2!r}::DOUBLE * {x} - {a2!r}::DOUBLE * {y}{k} AS q{k}"]
    # kept, as each step of the recursion reads it again
    ends = f"{name}_s AS MATERIALIZED (SELECT {key}, i, v FROM {source}),\n{name}_n AS (SELECT {key}, max(i) AS last FROM {name}_s GROUP BY 1)"
    source = f"{name}_s"
    start = f"SELECT s.{key}, s.i, {', '.join(first)} FROM {source} s JOIN {name}_n n ON n.{key} = s.{key} AND s.i = {at}"
    after = f"SELECT s.{key}, s.i, {', '.join(later)} FROM {name}_r r JOIN {source} s ON s.{key} = r.{key} AND s.i = r.i {step}"
    return f"{ends},\n{name}_r AS ({start}\n  UNION ALL {after}),\n{name} AS (SELECT {key}, i, y{n - 1} AS v FROM {name}_r)"


SECTIONS = butterworth_sections(0.5, 15.0, 40.0, 4)


@query("F11_bandpass_butterworth", f"""WITH RECURSIVE {SUPPLIER_SAMPLES},
{filter_sql("f", "s", "l_suppkey", SECTIONS)},
{filter_sql("b", "f", "l_suppkey", SECTIONS, reverse=True)}
SELECT l_suppkey, i, round(v, 6) AS v FROM b""")
def f11_butter(spark, d):
    return C.bandpass(supplier_samples(spark, d), ["l_suppkey"], 40.0).withColumn("v", r6("v"))


@query("F11_bandpass_causal", f"""WITH RECURSIVE {TYPE_SAMPLES},
{filter_sql("f", "s", "event_type", SECTIONS)}
SELECT event_type, i, round(v, 6) AS v FROM f""")
def f11_causal(spark, d):
    return C.bandpass(event_samples(spark, d, "event_type"), ["event_type"], 40.0, zero_phase=False, chunk=256).withColumn("v", r6("v"))


@query("F12_resample_mean", f"""WITH {USER_SAMPLES}
SELECT user_id, i // 4 AS i, round(avg(v), 6) AS v FROM s GROUP BY 1, i // 4 HAVING count(*) = 4""")
def f12(spark, d):
    return C.resample_mean(event_samples(spark, d), ["user_id"], 4).select("user_id", "i", r6("v").alias("v"))


# 100 Hz to 40 Hz by the local kernel
RESAMPLED = """n AS (SELECT l_suppkey, CAST(floor((max(i) + 1) * CAST(0.4 AS DOUBLE)) AS BIGINT) AS n FROM s GROUP BY 1),
j AS (SELECT l_suppkey, j, j / CAST(0.4 AS DOUBLE) AS at FROM (SELECT l_suppkey, unnest(generate_series(0, n - 1)) AS j FROM n)),
d AS (SELECT j.l_suppkey, j.j, (j.at - s.i) * CAST(0.4 AS DOUBLE) AS d, s.v FROM j JOIN s ON s.l_suppkey = j.l_suppkey AND s.i > j.at - 81 AND s.i < j.at + 81),
x AS (SELECT l_suppkey, j AS i, sum(v * 0.4 * (CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END) * (0.5 + 0.5 * cos(pi() * d / 32))) AS v
  FROM d WHERE abs(d) < 32 GROUP BY 1, 2)"""


@query("F12_resample_general", f"""WITH {SUPPLIER_SAMPLES},
{RESAMPLED}
SELECT l_suppkey, i, round(v, 6) AS v FROM x""")
def f12_general(spark, d):
    return C.resample(supplier_samples(spark, d), ["l_suppkey"], 100.0, 40.0).withColumn("v", r6("v"))


@query("F12_resample_fourier", f"""WITH {USER_SAMPLES},
n AS (SELECT user_id, n, CAST(floor(n * CAST(40 AS DOUBLE) / 100) AS BIGINT) AS num FROM (SELECT user_id, count(*) AS n FROM s GROUP BY 1)),
k AS (SELECT *, unnest(generate_series(0, num // 2)) AS k FROM n WHERE num > 0),
x AS (SELECT k.user_id, k.n, k.num, k.k, sum(v * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((k * i) % n) / n)) AS im
  FROM k JOIN s USING (user_id) GROUP BY ALL),
j AS (SELECT user_id, unnest(generate_series(0, num - 1)) AS i FROM n WHERE num > 0)
SELECT user_id, i, round(sum((CASE WHEN k = 0 THEN 1 ELSE 2 END) * (re * cos(2 * pi() * ((k * i) % num) / num) - im * sin(2 * pi() * ((k * i) % num) / num)) / n), 6) AS v
FROM x JOIN j USING (user_id) GROUP BY 1, 2""")
def f12_fourier(spark, d):
    """Blocks of 16 numbers, so that every trace takes the way of a long one."""
    return fourier.fourier_resample(event_samples(spark, d), ["user_id"], 100.0, 40.0, chunk=32, cells=16).withColumn("v", r6("v"))


@query("F13_sensitivity", f"""WITH {USER_SAMPLES}
SELECT user_id, i, round(v / (1 + c_acctbal * c_acctbal), 9) AS v FROM s JOIN customer ON user_id = c_custkey""")
def f13(spark, d):
    channels = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (1 + F.col("c_acctbal") * F.col("c_acctbal")).alias("sensitivity"))
    return C.scale_sensitivity(event_samples(spark, d), channels, ["user_id"]).select("user_id", "i", r6("v", 9).alias("v"))


def sensor_channels(spark, d):
    """A 1 Hz geophone per supplier whose sensitivity comes from the table."""
    w0, damping = 2 * np.pi * 1.0, 0.7
    pole_re, pole_im = -w0 * damping, w0 * np.sqrt(1 - damping**2)
    number = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.lit(1.0).alias("norm_factor"), (1000 + F.abs("s_acctbal")).alias("sensitivity"),
        number(0, 0).alias("zeros_re"), number(0, 0).alias("zeros_im"), number(pole_re, pole_re).alias("poles_re"),
        number(pole_im, -pole_im).alias("poles_im"))


def response_sql(name: str, source: str) -> str:
    """The rows of ``source`` (l_suppkey, i, v at 40 Hz) divided by the response of ``sensor_channels``, by sums of sines.

    The pre-filter is zero at both ends of the spectrum, so every place counts twice.
    """
    f1, f2, f3, f4 = C.PRE_FILTER
    w0, damping = 2 * np.pi, 0.7
    a, b = float(w0 * w0), float(2 * w0 * damping)
    return f"""{name}_n AS (SELECT l_suppkey, CAST(2 ** ceil(log2(2 * count(*))) AS BIGINT) AS m, 1000 + abs(s_acctbal) AS sens
  FROM {source} JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_acctbal),
{name}_k AS (SELECT *, 2 * pi() * 40 * k / m AS w, 40.0 * k / m AS f FROM (SELECT *, unnest(generate_series(0, m // 2)) AS k FROM {name}_n)),
{name}_h AS (SELECT *, max(size) OVER (PARTITION BY l_suppkey) * 1e-3 AS floor FROM (SELECT *, sens * w * w / sqrt(({a!r} - w * w) ** 2 + ({b!r} * w) ** 2) AS size FROM {name}_k)),
{name}_g AS (SELECT l_suppkey, m, k, gain * ({a!r} - w * w) / (-sens * w * w) * least(1, size / floor) AS re, gain * {b!r} * w / (-sens * w * w) * least(1, size / floor) AS im
  FROM (SELECT *, 0.5 * (1 - cos(pi() * greatest(0, least(1, (f - {f1}) / ({f2} - {f1}))))) * 0.5 * (1 + cos(pi() * greatest(0, least(1, (f - {f3}) / ({f4} - {f3}))))) AS gain
    FROM {name}_h WHERE k > 0) WHERE gain > 0),
{name}_a AS (SELECT l_suppkey, m, k, re, im, v, 2 * pi() * ((k * i) % m) / m AS angle FROM {name}_g JOIN {source} USING (l_suppkey)),
{name}_x AS MATERIALIZED (SELECT l_suppkey, m, k, any_value(re) AS re, any_value(im) AS im, sum(v * cos(angle)) AS c, sum(v * sin(angle)) AS s FROM {name}_a GROUP BY 1, 2, 3),
{name}_b AS (SELECT l_suppkey, m, i, re * c + im * s AS re, im * c - re * s AS im, 2 * pi() * ((k * i) % m) / m AS angle FROM {name}_x JOIN {source} USING (l_suppkey)),
{name} AS (SELECT l_suppkey, i, sum(re * cos(angle) - im * sin(angle)) * 2 / any_value(m) AS v FROM {name}_b GROUP BY 1, 2)"""


@query("F13_response_removal", f"""WITH {SUPPLIER_SAMPLES},
{response_sql("y", "s")}
SELECT l_suppkey, i, round(v, 9) AS v FROM y""")
def f13_full(spark, d):
    out = C.remove_response(supplier_samples(spark, d), sensor_channels(spark, d), ["l_suppkey"], ["l_suppkey"], 40.0)
    return out.withColumn("v", r6("v", 9))


@query("F13_response_status", f"""WITH {SUPPLIER_SAMPLES}, c AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL WHEN s_nationkey % 5 = 1 THEN 0 ELSE 1 END AS factor FROM supplier WHERE s_nationkey % 5 < 4)
SELECT l_suppkey, max(i) + 1 AS length, CASE WHEN max(i) + 1 < 600 THEN 'too_short' WHEN min(v) = max(v) THEN 'flat' WHEN any_value(s_suppkey) IS NULL THEN 'no_response'
  WHEN coalesce(any_value(factor), 0) = 0 THEN 'bad_response' ELSE 'ok' END AS status FROM s LEFT JOIN c ON l_suppkey = s_suppkey GROUP BY 1""")
def f13_status(spark, d):
    """Channels of one nation are missing, of another without a factor, of a third with a factor of zero."""
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("k"))
    factor = F.when(F.col("k") == 0, F.lit(None).cast("double")).when(F.col("k") == 1, 0.0).otherwise(1.0)
    channels = sensor_channels(spark, d).join(nation, "l_suppkey").where("k < 4").withColumn("norm_factor", factor)
    out = C.response_status(supplier_samples(spark, d), channels, ["l_suppkey"], ["l_suppkey"], least=600)
    return out.withColumnRenamed("_len", "length")


@query("F14_condition_sql", f"WITH {USER_SAMPLES}, {TREND} SELECT user_id, i, round((v - (a + b * i)) * {TAPER}, 6) AS v FROM s JOIN r USING (user_id)")
def f14(spark, d):
    out = C.condition(event_samples(spark, d), ["user_id"], 40.0, 40.0, band=None)
    return out.select("user_id", "i", r6("v").alias("v"))


@query("F14_condition_full", f"""WITH RECURSIVE {SUPPLIER_SAMPLES},
{RESAMPLED},
r AS (SELECT l_suppkey, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, max(i) + 1 AS n FROM x GROUP BY 1),
z AS (SELECT l_suppkey, i, (v - (a + b * i)) * {TAPER} AS v FROM x JOIN r USING (l_suppkey)),
{response_sql("y", "z")},
{filter_sql("f", "y", "l_suppkey", SECTIONS)},
{filter_sql("g", "f", "l_suppkey", SECTIONS, reverse=True)}
SELECT l_suppkey, i, round(v, 9) AS v FROM g""")
def f14_full(spark, d):
    """Resample, detrend, taper, remove the response, band-pass from both ends."""
    return C.condition(supplier_samples(spark, d), ["l_suppkey"], 100.0, 40.0, sensor_channels(spark, d)).withColumn("v", r6("v", 9))


DFT = """b AS (SELECT j, p, cos(2 * pi() * j * p / {n}) AS c, sin(2 * pi() * j * p / {n}) AS s FROM
  (SELECT unnest(generate_series(0, {h})) AS j), (SELECT unnest(generate_series(0, {m})) AS p))"""
TYPE_FRAMES = f"""{TYPE_SAMPLES}, n AS (SELECT event_type, max(i) + 1 AS len FROM s GROUP BY 1),
k AS (SELECT event_type, unnest(generate_series(0, (len - 32) // 16)) AS k FROM n WHERE len >= 32),
x AS (SELECT k.event_type, k.k, s.i - k.k * 16 AS p, s.v FROM k JOIN s ON s.event_type = k.event_type AND s.i >= k.k * 16 AND s.i < k.k * 16 + 32),
{DFT.format(n=32, h=16, m=31)},
sp AS (SELECT x.event_type, x.k, b.j, sum(x.v * b.c) ** 2 + sum(x.v * b.s) ** 2 AS power FROM x JOIN b ON b.p = x.p GROUP BY 1, 2, 3)"""


def amplitude(df):
    """Amplitude instead of power: the squares of values with two decimals round ambiguously."""
    return df.withColumn("amplitude", F.round(F.sqrt("power"), 5)).drop("power")


@query("F15_power_spectrum", f"""WITH e AS (SELECT vec_id, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS p FROM ({EMB})), {DFT.format(n=64, h=32, m=63)}
SELECT vec_id, j, round(sum(v * c) ** 2 + sum(v * s) ** 2, 6) AS power FROM e JOIN b USING (p) GROUP BY 1, 2""")
def f15(spark, d):
    sp = S.power_spectrum(traces(spark, d), "data")
    return sp.select("vec_id", F.posexplode("power").alias("j", "power")).withColumn("power", r6("power"))


@query("F15_spectrogram", f"""WITH {TYPE_FRAMES}
SELECT event_type, k, j, (k * 16 + 16) / 40.0 AS t_mid, j * 40 / 32.0 AS freq, round(sqrt(power), 5) AS amplitude FROM sp""")
def f15_gram(spark, d):
    return amplitude(S.spectrogram(event_samples(spark, d, "event_type"), ["event_type"], 32, 16, 40.0))


@query("F16_welch", f"WITH {TYPE_FRAMES} SELECT event_type, j, j * 40 / 32.0 AS freq, round(sqrt(avg(power)), 5) AS amplitude FROM sp GROUP BY 1, 2")
def f16(spark, d):
    return amplitude(S.welch(event_samples(spark, d, "event_type"), ["event_type"], 32, 16, 40.0))


@query("F17_dominant_frequency", f"""WITH {TYPE_FRAMES},
q AS (SELECT *, abs((k * 16 + 16) / 40.0 - 12.5) AS far FROM sp)
SELECT event_type, k, freq, amplitude FROM (SELECT event_type, k, j * 40 / 32.0 AS freq, round(sqrt(power), 5) AS amplitude,
  row_number() OVER (PARTITION BY event_type ORDER BY far, k, power DESC, j) AS rn FROM q) WHERE rn = 1""")
def f17(spark, d):
    sp = S.spectrogram(event_samples(spark, d, "event_type"), ["event_type"], 32, 16, 40.0)
    return amplitude(S.dominant_freq(sp, ["event_type"], F.lit(12.5)))


@query("F18_compare_window_lengths", f"""WITH {USER_SAMPLES}, n AS (SELECT user_id, max(i) + 1 AS n FROM s GROUP BY 1),
g AS (SELECT * FROM (VALUES (10, 5), (30, 15), (60, 30)) t(win, step))
SELECT user_id, n, win, step, CASE WHEN n >= win THEN (n - win) // step + 1 ELSE 0 END AS n_windows FROM n, g""")
def f18(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return W.count_by_length(n, [(10, 5), (30, 15), (60, 30)])
