from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import functions as fn
from tracewell.queries.registry import query, r6, table


@query("S01_text_functions", """
SELECT doc_id, lower(source) AS low, source LIKE '%1' AS ends, contains(text, 'the') AS has, trim('  ' || lang || ' ') AS trimmed,
  starts_with(text, '#') AS comment, replace(source, 'src', 'S') AS replaced, len(string_split(lang || '_' || source, '_')) AS n_parts,
  concat_ws('.', lang, source) AS key FROM documents""")
def s01(spark, d):
    c = F.col
    return table(spark, d, "documents").select(
        "doc_id", F.lower("source").alias("low"), c("source").endswith("1").alias("ends"), F.contains("text", F.lit("the")).alias("has"),
        F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("trimmed"), c("text").startswith("#").alias("comment"),
        F.replace(c("source"), F.lit("src"), F.lit("S")).alias("replaced"),
        F.size(F.split(F.concat_ws("_", "lang", "source"), "_")).cast("bigint").alias("n_parts"), F.concat_ws(".", "lang", "source").alias("key"))


@query("S02_time_functions", """
SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second,
  epoch_us(ts) % 1000000 AS microsecond, dayofyear(ts) AS julday, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS since,
  strftime(ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS later,
  strftime(strptime(strftime(ts, '%Y/%m/%d %H:%M:%S'), '%Y/%m/%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def s02(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", *[c.cast("bigint").alias(n) for n, c in fn.parts(ts).items()], fn.iso(ts).alias("iso"),
        r6(fn.seconds_between(ts, F.lit("2024-01-01").cast("timestamp"))).alias("since"),
        F.date_format(fn.add_seconds(ts, F.col("value")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("later"),
        F.date_format(fn.parse_slashed(F.date_format(ts, "yyyy/MM/dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("S03_math_functions", """
SELECT event_id, round(value, 1) AS r1, abs(value - 100) AS a, round(sqrt(value), 6) AS sq, round(sin(value), 6) AS si, round(exp(-value / 100), 6) AS ex,
  round(10 * log10(value * value + 1e-12), 6) AS db, CAST(trunc(value - 50) AS BIGINT) AS tr, greatest(20, least(80, value)) AS cl,
  round(CASE WHEN value - 50 > 0 THEN value / (value - 50) ELSE 0 END, 6) AS gr FROM events""")
def s03(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(v, 1).alias("r1"), F.abs(v - 100).alias("a"), r6(F.sqrt(v)).alias("sq"), r6(F.sin(v)).alias("si"),
        r6(F.exp(-v / 100)).alias("ex"), r6(fn.decibel(v * v)).alias("db"), fn.truncate(v - 50).alias("tr"), fn.clamp(v, 20.0, 80.0).alias("cl"),
        r6(fn.guarded_ratio(v, v - 50)).alias("gr"))


@query("S04_array_functions", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 6) AS std, round(list_max(x), 6) AS max, round(list_min(x), 6) AS min,
  round(list_max([abs(a) for a in x]), 6) AS max_abs, list_position(x, list_max(x)) - 1 AS amax,
  array_to_string(list_grade_up(x)[1:5], ',') AS lowest, round(list_aggregate(x, 'quantile_cont', 0.95), 6) AS p95, len([a for a in x if a > 0]) AS n_pos,
  round(list_sum([a * 2 for a in x[3:12]]), 6) AS cut, round(list_sum([greatest(-0.1, least(0.1, a)) for a in x]), 6) AS clipped
FROM (SELECT *, vec_id AS q FROM e)""")
def s04(spark, d):
    x = F.col("x")
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    positive = fn.mask_by(x, F.transform(x, lambda v: v > 0))
    return e.select(
        "vec_id", *[r6(c).alias(n) for n, c in fn.moments(x).items()], r6(fn.max_abs(x)).alias("max_abs"), fn.argmax(x).alias("amax"),
        F.array_join(F.transform(F.slice(fn.argsort(x), 1, 5), lambda j: (j + 1).cast("string")), ",").alias("lowest"),
        r6(fn.percentile_of(x, 0.95)).alias("p95"), F.size(positive).cast("bigint").alias("n_pos"),
        r6(total(F.transform(F.slice(x, 3, 10), lambda v: v * 2))).alias("cut"), r6(total(fn.clip_to(x, -0.1, 0.1))).alias("clipped"))


@query("S06_records_and_predicates", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(to_json(struct_pack(u := user_id, t := event_type)), '$.t') AS t,
  len([x for x in [value, value / 2, 5.0] if x > 100]) > 0 AS any_loud, value IS NOT NULL AS present FROM events""")
def s06(spark, d):
    packed = F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")))
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object(packed, "$.t").alias("t"),
        F.exists(F.array("value", F.col("value") / 2, F.lit(5.0)), lambda x: x > 100).alias("any_loud"), F.col("value").isNotNull().alias("present"))
