import pytest
from pyspark.sql import functions as F

from tracewell.operators import joins, select
from tracewell.operators.stats import readiness
from tracewell.sources import catalog, files, stations, tables

XML = """<?xml version='1.0' encoding='UTF-8'?>
<fsx:FDSNStationXML xmlns:fsx="http://www.fdsn.org/xml/station/1" schemaVersion="1.1">
 <fsx:Network code="XX"><fsx:Description>test</fsx:Description><fsx:TotalNumberStations>2</fsx:TotalNumberStations>
  <fsx:Station code="{sta}" startDate="2000-01-01T00:00:00Z"><fsx:Latitude>1.5</fsx:Latitude><fsx:Longitude>-2.5</fsx:Longitude><fsx:Elevation>10.0</fsx:Elevation>
   <fsx:Site><fsx:Name>Hill</fsx:Name></fsx:Site>
   <fsx:Channel code="BHZ" startDate="2000-01-01T00:00:00Z" endDate="2010-01-01T00:00:00Z" locationCode=""><fsx:SampleRate>4.0E+01</fsx:SampleRate>
    <fsx:Response><fsx:InstrumentSensitivity><fsx:Value>2.0E+03</fsx:Value><fsx:Frequency>1.0</fsx:Frequency><fsx:InputUnits><fsx:Name>m/s</fsx:Name></fsx:InputUnits></fsx:InstrumentSensitivity>
     <fsx:Stage number="1"><fsx:PolesZeros><fsx:PzTransferFunctionType>LAPLACE (RADIANS/SECOND)</fsx:PzTransferFunctionType><fsx:NormalizationFactor>1.5</fsx:NormalizationFactor>
      <fsx:Zero number="0"><fsx:Real>0.0</fsx:Real><fsx:Imaginary>0.0</fsx:Imaginary></fsx:Zero>
      <fsx:Pole number="1"><fsx:Real>-5.0</fsx:Real><fsx:Imaginary>3.0</fsx:Imaginary></fsx:Pole><fsx:Pole number="2"><fsx:Real>-5.0</fsx:Real><fsx:Imaginary>-3.0</fsx:Imaginary></fsx:Pole>
      </fsx:PolesZeros><fsx:StageGain><fsx:Value>100.0</fsx:Value></fsx:StageGain></fsx:Stage>
     <fsx:Stage number="2"><fsx:FIR><fsx:Symmetry>NONE</fsx:Symmetry></fsx:FIR><fsx:Decimation><fsx:InputSampleRate>80.0</fsx:InputSampleRate><fsx:Factor>2</fsx:Factor></fsx:Decimation></fsx:Stage>
    </fsx:Response></fsx:Channel>
   <fsx:Channel code="BHZ" startDate="2010-01-01T00:00:00Z" locationCode=""><fsx:SampleRate>1.0E+02</fsx:SampleRate>
    <fsx:Response><fsx:InstrumentSensitivity><fsx:Value>7.0</fsx:Value></fsx:InstrumentSensitivity></fsx:Response></fsx:Channel>
  </fsx:Station></fsx:Network></fsx:FDSNStationXML>"""


@pytest.fixture(scope="module")
def xml_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("xml")
    (root / "deep").mkdir()
    (root / "XX_AAA.xml").write_text(XML.format(sta="AAA"))
    (root / "deep" / "XX.BBB.xml").write_text(XML.format(sta="BBB"))
    (root / "broken.xml").write_text("<html><body>not a station</body></html>")
    # the default namespace, and a broken file with the name of a good one
    (root / "plain.xml").write_text(XML.format(sta="CCC").replace("xmlns:fsx", "xmlns").replace("fsx:", ""))
    (root / "deep" / "XX_AAA.xml").write_text("<html><body>not a station either</body></html>")
    (root / "a.ms").write_bytes(b"123")
    return str(root)


def test_station_xml(spark, xml_dir):
    st, ch, stages = stations.read_stations(spark, xml_dir)
    assert sorted(r.sta for r in st.collect()) == ["AAA", "BBB", "CCC"]
    assert [(r.sensitivity, r.sr_hz, r.n_stages) for r in ch.where("sta = 'AAA'").orderBy("start").collect()] == [(2000.0, 40.0, 2), (7.0, 100.0, 0)]
    assert [r.kind for r in stages.where("sta = 'AAA'").orderBy("stage").collect()] == ["poles_zeros", "fir"]
    resp = stations.sensor_responses(stages).where("sta = 'BBB'").first()
    assert resp.poles_re == [-5.0, -5.0] and resp.poles_im == [3.0, -3.0] and resp.zeros_re == [0.0] and resp.norm_factor == 1.5
    assert stations.sensor_responses(stages).where("sta = 'CCC'").first().poles_re == [-5.0, -5.0]
    bad = sorted(r.path.removeprefix("file:") for r in stations.unreadable(spark, xml_dir, st).collect())
    assert bad == [f"{xml_dir}/broken.xml", f"{xml_dir}/deep/XX_AAA.xml"]
    traces = spark.createDataFrame([("XX", "AAA", "2005-01-01"), ("XX", "AAA", "2020-01-01"), ("XX", "AAA", "1990-01-01"), ("XX", "DDD", "2005-01-01")], "net string, sta string, d string")
    traces = traces.withColumn("t0", F.to_timestamp("d"))
    epochs = ch.select("net", "sta", "start", "end", "sensitivity")
    assert sorted((r.d, r.sensitivity) for r in joins.attach_epoch(traces, epochs, ["net", "sta"]).collect()) == [("2005-01-01", 2000.0), ("2020-01-01", 7.0)]
    assert joins.without_station(traces, st).count() == 1 and joins.attach_station(traces, st.select("net", "sta", "lat")).count() == 3


def test_scan_files(spark, xml_dir):
    found, missing = files.scan_files(spark, [xml_dir, xml_dir + "-none"], prune_dirs=["deep"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["XX_AAA.xml", "a.ms", "broken.xml", "plain.xml"]
    assert missing == [xml_dir + "-none"]
    assert files.list_objects(spark, xml_dir, 2).count() == 2


def test_catalog(spark, tmp_path):
    good = "2016/01/31 00:12:57.59 le l {mag} l 33.5 -117.25 {depth} A 90000001 {rest}"
    lines = ["# header", "", "  ", good.format(mag="3.0", depth="10.5", rest="10 0.2"), good.format(mag="2.49", depth="1", rest="1 2"),
             good.format(mag="2.50", depth="1", rest=""), good.format(mag="x", depth="1", rest="1"),
             "2016/01/31 00:12:57.59 le l 3.0 l 33.5 -117.25 1 A", good.replace("2016/01/31", "24/13/40").format(mag="3", depth="2", rest="1 2")]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    events, rejects = catalog.read_catalog(spark, str(tmp_path / "c.txt"))
    got = events.orderBy("mag").collect()
    assert [(r.mag, r.evid, r.ano, r.doy, r.depth) for r in got] == [(2.5, "90000001", 2016, 31, 1.0), (3.0, "90000001", 2016, 31, 10.5)]
    assert sorted(r.status for r in rejects.collect()) == ["bad_date", "bad_number", "few_tokens", "low_magnitude"]


def test_inventory_classes(spark):
    rows = [(f"f{j}", 5.0 if j < 2 else 11.0 + j, j % 31 >= 7) for j in range(31)]
    inv = select.classify(spark.createDataFrame(rows, "arquivo string, razao_var double, xml_disponivel boolean"), "razao_var")
    assert {r.classificacao: r["count"] for r in inv.groupBy("classificacao").count().collect()} == {"ambiguo": 2, "evento_claro": 29}
    assert select.usable(inv).count() == 24
    ready = readiness(inv).first()
    assert ready.enough_files and ready.enough_metadata and ready.enough_events
    edge = select.classify(spark.createDataFrame([(1.99,), (2.0,), (10.0,), (10.01,)], "razao_var double"), "razao_var")
    assert [r.classificacao for r in edge.collect()] == ["ruido", "ambiguo", "ambiguo", "evento_claro"]


def test_paths(spark):
    df = spark.createDataFrame([("C:\\x\\data\\archive\\e\\12.ms",), ("/y/z.tar.gz",)], "p string")
    got = df.select(files.base_name("p").alias("b"), files.stem("p").alias("s"), files.rebase_path("p", "archive", "/mnt/").alias("r")).collect()
    assert tuple(got[0]) == ("12.ms", "12", "/mnt/archive/e/12.ms") and tuple(got[1]) == ("z.tar.gz", "z.tar", "/y/z.tar.gz")


def test_windows_fallback_and_pruning(spark, tmp_path):
    w = spark.range(10).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"), F.when(F.col("id") < 7, "train").otherwise("val").alias("split"))
    back = tables.write_windows(w, str(tmp_path / "w"))
    assert {r.split: r.n for r in back.collect()} == {"train": 7, "val": 3}
    one = tables.read_windows(spark, str(tmp_path / "none"), "val", fallback=str(tmp_path / "w"))
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


def test_new_files_budget(spark):
    listing = spark.createDataFrame([(f"f{j:02d}", 10) for j in range(20)], "path string, length long")
    log = spark.createDataFrame([("f00",), ("f03",)], "path string")
    got = select.new_files(listing, log, budget_bytes=55)
    assert sorted((r.path, r.total_bytes) for r in got.collect()) == [("f01", 10), ("f02", 20), ("f04", 30), ("f05", 40), ("f06", 50)]
    assert select.new_files(listing, log).count() == 18


def test_selection_on_a_hot_key(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 9)).withColumn("v", F.col("id") * 7919 % 501)
    pdf = df.toPandas()
    top = select.top_k_per(df, ["k"], "v", 3, ["id"]).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(3)
    assert set(top.id) == set(want.id)
    assert select.sample_n(df, 777, ["id"]).count() == 777
    ids = {r.id for r in select.sample_n(df, 777, ["id"]).collect()}
    assert ids == {r.id for r in select.sample_n(df.repartition(11), 777, ["id"]).collect()}
    assert select.sample_n(df, 99999, ["id"]).count() == 5000
    first = {r.k: r.id for r in select.first_match(df, ["k"], ["id"], F.col("v") > 400).collect()}
    assert first[-1] == pdf[(pdf.k == -1) & (pdf.v > 400)].id.min()


def test_pattern_priority_and_contains(spark):
    st = spark.createDataFrame([("CI", "PAS"), ("CI", "ADL"), ("AZ", "BZN")], "net string, sta string")
    names = spark.createDataFrame([("CI.PAS.xml",), ("PAS.xml",), ("CI_ADL.xml",), ("CI.ADL.xml",)], "name string")
    patterns = [F.concat("net", F.lit("_"), "sta", F.lit(".xml")), F.concat("net", F.lit("."), "sta", F.lit(".xml")), F.concat("sta", F.lit(".xml"))]
    got = {r.sta: (r.priority, r.name) for r in joins.pattern_lookup(st, names, patterns).collect()}
    assert got == {"PAS": (1, "CI.PAS.xml"), "ADL": (0, "CI_ADL.xml")}
    waves = spark.createDataFrame([("CI_PASC_BHZ.ms",), ("AZ_BZN.ms",), ("XX_NONE.ms",)], "name string")
    hit = {r.name: r.sta for r in joins.attach_contains(waves, st, "name", "sta", also="net").collect()}
    assert hit == {"CI_PASC_BHZ.ms": "PAS", "AZ_BZN.ms": "BZN", "XX_NONE.ms": None}
