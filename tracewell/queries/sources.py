from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.operators import evaluate as E
from tracewell.operators import model as M
from tracewell.operators import select
from tracewell.operators.splits import split_ordered
from tracewell.plans.jobs import result_record
from tracewell.queries.evaluation import FIXED_ERRORS, fixed_model, model_windows, scores
from tracewell.queries.registry import query, r6, table
from tracewell.schemas import INVENTORY
from tracewell.session import ensure_checkpoint_dir
from tracewell.sources import catalog, stations, tables


def scratch(spark, name):
    """A new folder for one run next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("A03_read_samples", "SELECT user_id, event_id, value FROM events WHERE event_type LIKE '%or'")
def a03(spark, d):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    return tables.read_samples(spark, f"{d}/events.parquet", schema, suffix="or", channel="event_type").select("user_id", "event_id", "value")


@query("A04_read_station_metadata", """
SELECT 'N' || s_nationkey AS net, 'S' || s_suppkey AS sta, 'BHZ' AS cha, s_acctbal AS sensitivity, CAST(2 AS INTEGER) AS n_stages,
  CAST(-5.0 AS DOUBLE) AS pole_re, CAST(1 + s_nationkey AS DOUBLE) AS norm_factor FROM supplier""")
def a04(spark, d):
    """Station XML documents written from the suppliers, then read back."""
    named = lambda **fields: F.struct(*[v.alias(f"fsx:{k}") for k, v in fields.items()])
    pole = named(Real=F.lit(-5.0), Imaginary=F.lit(3.0))
    sensor = F.struct(F.lit(1).alias("_number"), named(NormalizationFactor=(1 + F.col("s_nationkey")).cast("double"), Pole=F.array(pole)).alias("fsx:PolesZeros"),
                      named(Value=F.lit(100.0)).alias("fsx:StageGain"))
    logger = F.struct(F.lit(2).alias("_number"), F.lit(None).cast("struct<`fsx:NormalizationFactor`:double,`fsx:Pole`:array<struct<`fsx:Real`:double,`fsx:Imaginary`:double>>>").alias("fsx:PolesZeros"), named(Value=F.lit(2.0)).alias("fsx:StageGain"))
    response = named(InstrumentSensitivity=named(Value=F.col("s_acctbal")), Stage=F.array(sensor, logger))
    channel = F.struct(F.lit("BHZ").alias("_code"), F.lit("").alias("_locationCode"), F.lit("2000-01-01T00:00:00Z").alias("_startDate"),
                       F.lit(40.0).alias("fsx:SampleRate"), response.alias("fsx:Response"))
    station = F.struct(F.concat(F.lit("S"), "s_suppkey").alias("_code"), F.lit(1.5).alias("fsx:Latitude"), F.array(channel).alias("fsx:Channel"))
    path = scratch(spark, "stations")
    networks = table(spark, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("_code"), F.array(station).alias("fsx:Station"))
    root = 'fsx:FDSNStationXML xmlns:fsx="http://www.fdsn.org/xml/station/1"'
    networks.write.format("xml").option("rootTag", root).option("rowTag", "fsx:Network").option("validateName", False).save(path)
    _, channels, stages = stations.read_stations(spark, path)
    responses = stations.sensor_responses(stages).select("net", "sta", "cha", F.get("poles_re", F.lit(0)).alias("pole_re"), "norm_factor")
    return channels.select("net", "sta", "cha", "sensitivity", "n_stages").join(responses, ["net", "sta", "cha"])


@query("A05_read_catalog", """
SELECT o_orderkey AS line_no, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'few_tokens' WHEN o_orderkey % 83 = 0 THEN 'bad_number'
  WHEN o_custkey % 500 < 250 THEN 'low_magnitude' WHEN o_orderkey % 89 = 0 THEN 'bad_date' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 89 <> 0 THEN dayofyear(o_orderdate) END AS doy, CASE WHEN o_orderkey % 83 <> 0 THEN o_custkey % 500 / 100.0 END AS mag
FROM orders WHERE o_orderkey % 97 <> 0""")
def a05(spark, d):
    """Catalogue lines written from the orders, some of them broken on purpose, then parsed."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy/MM/dd")
    broken = F.date_format("o_orderdate", "dd/'31'/yyyy")
    line = F.concat(
        F.when(k % 97 == 0, "# ").otherwise(""), F.when(k % 89 == 0, broken).otherwise(day), F.lit(" 01:02:03.45 le l "),
        F.when(k % 83 == 0, "x").otherwise((F.col("o_custkey") % 500 / 100).cast("string")), F.lit(" l  33.5 -117.25 "),
        (F.col("o_custkey") % 40).cast("string"), F.lit(".0"),
        F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "").otherwise(F.concat(F.lit(" A "), k, F.lit(" 10 20"))))
    path = scratch(spark, "catalog")
    table(spark, d, "orders").select(F.concat(line, F.lit(" \u00a7"), k).alias("value")).write.text(path)
    parsed = catalog.parse_catalog(spark.read.text(path))
    # the order number at the end of each line identifies it
    number = F.regexp_extract("line", "\u00a7(\\d+)$", 1).cast("bigint")
    return parsed.select(number.alias("line_no"), "status", F.col("doy").cast("bigint").alias("doy"), "mag")


@query("A06_inventory_csv_roundtrip", """
SELECT CAST(o_orderkey AS VARCHAR) AS arquivo, round(o_totalprice / 1000, 3) AS razao_var, o_orderstatus = 'F' AS xml_disponivel, o_custkey AS n_amostras FROM orders""")
def a06(spark, d):
    given = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("arquivo"), F.round(F.col("o_totalprice") / 1000, 3).alias("razao_var"),
        (F.col("o_orderstatus") == "F").alias("xml_disponivel"), F.col("o_custkey").alias("n_amostras"))
    full = given.select(*[F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INVENTORY.fields])
    path = scratch(spark, "inventory")
    tables.write_csv(full, path)
    return tables.read_inventory(spark, path).select(*given.columns)


@query("A07_read_windows_split", """
WITH p AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM p
WHERE pos >= trunc(n * 0.70) AND pos < trunc(n * 0.70) + trunc(n * 0.15)""")
def a07(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    path = scratch(spark, "windows")
    tables.write_windows(split_ordered(e, ["vec_id"]), path)
    back = tables.read_windows(spark, path, "val")
    return back.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query("A09_write_windows", """
WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
SELECT CASE WHEN pos < trunc(n * 0.70) THEN 'train' WHEN pos < trunc(n * 0.70) + trunc(n * 0.15) THEN 'val' ELSE 'test' END AS split,
  CAST(64 AS INTEGER) AS length, count(*) AS n FROM p GROUP BY 1""")
def a09(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return tables.write_windows(split_ordered(e, ["vec_id"]), scratch(spark, "windows"))


@query("A10_record_json_roundtrip", """
SELECT 'STA/LTA' AS metodo, 3.0 AS threshold_used, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, CAST(NULL AS DOUBLE) AS tamanho_kb FROM (
  SELECT count(*) FILTER (n_chars > 1500 AND toxic = 0) AS fp, count(*) FILTER (n_chars <= 1500 AND toxic = 1) AS fn,
  count(*) FILTER (n_chars > 1500 AND toxic = 1) AS tp FROM documents JOIN labels USING (doc_id))""")
def a10(spark, d):
    metrics = E.prf(E.confusion(E.flag(scores(spark, d), 1500, "score"))).select("f1", F.lit(None).cast("double").alias("tamanho_kb"))
    path = scratch(spark, "record")
    tables.write_json(result_record("STA/LTA", {"threshold": 3.0}, metrics), path)
    back = tables.read_records(spark, path)
    return back.select("metodo", F.col("parametros")["threshold"].alias("threshold_used"), r6("f1", 8).alias("f1"), "tamanho_kb")


@query("A11_write_scores", """
SELECT doc_id, n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id)""")
def a11(spark, d):
    sc = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")).join(
        table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    path = scratch(spark, "scores")
    tables.write_scores(sc, E.confusion(E.flag(sc, 1500, "score")), path)
    return spark.read.parquet(f"{path}/scores")


@query("A12_save_load_model")
def a12(spark, d):
    w = model_windows(spark, d)
    path = scratch(spark, "model")
    M.fit_pca(w.where("label = 0"), 8).save(spark, path)
    return M.LinearModel.load(spark, path).errors(w).select("vec_id", "label", r6("err").alias("err"))


@query("A12_save_load_fixed", f"WITH {FIXED_ERRORS} SELECT vec_id, round(err, 6) AS err FROM err")
def a12_fixed(spark, d):
    """Weights that follow a rule, written, read back and used."""
    path = scratch(spark, "model")
    fixed_model().save(spark, path)
    return M.DenseModel.load(spark, path).errors(model_windows(spark, d)).select("vec_id", r6("err").alias("err"))


@query("A13_incremental_ingest", """
WITH f AS (SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS total_bytes FROM f)
SELECT * FROM r WHERE total_bytes <= 200000""")
def a13(spark, d):
    listing = table(spark, d, "documents").select("doc_id", "n_chars")
    return select.new_files(listing, table(spark, d, "labels"), "doc_id", "n_chars", ["doc_id"], 200000)
