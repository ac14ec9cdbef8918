"""Station metadata in StationXML: networks, stations, channels and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, A, R = T.StringType(), T.DoubleType(), T.ArrayType, T.StructType


def _f(*pairs) -> T.StructType:
    return R([T.StructField(name, kind, True) for name, kind in pairs])


def network_schema(p: str = "fsx:") -> T.StructType:
    """Schema of a Network element whose tags carry the prefix ``p``."""
    complex_number = _f((f"{p}Real", D), (f"{p}Imaginary", D))
    named = _f((f"{p}Name", S))
    stage = _f(
        ("_number", T.IntegerType()),
        (f"{p}PolesZeros", _f(
            (f"{p}PzTransferFunctionType", S), (f"{p}NormalizationFactor", D), (f"{p}NormalizationFrequency", D),
            (f"{p}Zero", A(complex_number)), (f"{p}Pole", A(complex_number)))),
        (f"{p}Coefficients", _f((f"{p}CfTransferFunctionType", S))),
        (f"{p}FIR", _f((f"{p}Symmetry", S))),
        (f"{p}Decimation", _f((f"{p}InputSampleRate", D), (f"{p}Factor", T.IntegerType()), (f"{p}Offset", T.IntegerType()),
                              (f"{p}Delay", D), (f"{p}Correction", D))),
        (f"{p}StageGain", _f((f"{p}Value", D), (f"{p}Frequency", D))),
    )
    channel = _f(
        ("_code", S), ("_locationCode", S), ("_startDate", S), ("_endDate", S), (f"{p}Latitude", D), (f"{p}Longitude", D),
        (f"{p}Elevation", D), (f"{p}Depth", D), (f"{p}Azimuth", D), (f"{p}Dip", D), (f"{p}SampleRate", D),
        (f"{p}Response", _f(
            (f"{p}InstrumentSensitivity", _f((f"{p}Value", D), (f"{p}Frequency", D), (f"{p}InputUnits", named), (f"{p}OutputUnits", named))),
            (f"{p}Stage", A(stage)))),
    )
    station = _f(
        ("_code", S), ("_startDate", S), ("_endDate", S), (f"{p}Latitude", D), (f"{p}Longitude", D), (f"{p}Elevation", D),
        (f"{p}Site", _f((f"{p}Name", S), (f"{p}Town", S), (f"{p}Region", S), (f"{p}Country", S))), (f"{p}Channel", A(channel)),
    )
    return _f(("_code", S), (f"{p}Description", S), (f"{p}TotalNumberStations", T.IntegerType()), (f"{p}Station", A(station)))


def _time(c):
    return F.try_to_timestamp(c)


PREFIXES = ("fsx:", "")


def read_stations(spark: SparkSession, path: str | Sequence[str], prefixes: Sequence[str] = PREFIXES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stations, channels, stages), one row each per element; files that are no
    StationXML give no rows.  Tags may carry any of ``prefixes``; without one they
    are in the default namespace, as web services answer."""
    parts = [_read(spark, path, p) for p in prefixes]
    out = parts[0]
    for more in parts[1:]:
        out = tuple(a.unionByName(b) for a, b in zip(out, more))
    return out


def _read(spark: SparkSession, path: str | Sequence[str], p: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reader = spark.read.format("xml").option("rowTag", f"{p}Network").schema(network_schema(p)).option("recursiveFileLookup", True)
    paths = path if isinstance(path, str) else ",".join(path)
    nets = reader.load(paths).select(F.col("_code").alias("net"), F.col(f"`{p}Station`").alias("_s"), F.col("_metadata.file_path").alias("file"))
    st = nets.where(F.col("net").isNotNull()).withColumn("_s", F.explode("_s"))
    base = st.select(
        "net", F.col("_s._code").alias("sta"), "file", _time("_s._startDate").alias("start"), _time("_s._endDate").alias("end"),
        F.col(f"_s.`{p}Latitude`").alias("lat"), F.col(f"_s.`{p}Longitude`").alias("lon"), F.col(f"_s.`{p}Elevation`").alias("elevation"),
        F.col(f"_s.`{p}Site`.`{p}Name`").alias("site"), F.col(f"_s.`{p}Channel`").alias("_c"),
    )
    stations = base.select(*[c for c in base.columns if c != "_c"], F.coalesce(F.size("_c"), F.lit(0)).alias("n_channels"))
    ch = base.select("net", "sta", F.explode("_c").alias("c"))
    sens = f"c.`{p}Response`.`{p}InstrumentSensitivity`"
    flat = ch.select(
        "net", "sta", F.coalesce("c._locationCode", F.lit("")).alias("loc"), F.col("c._code").alias("cha"),
        _time("c._startDate").alias("start"), _time("c._endDate").alias("end"), F.col(f"c.`{p}SampleRate`").alias("sr_hz"),
        F.col(f"c.`{p}Depth`").alias("depth"), F.col(f"c.`{p}Azimuth`").alias("azimuth"), F.col(f"c.`{p}Dip`").alias("dip"),
        F.col(f"{sens}.`{p}Value`").alias("sensitivity"), F.col(f"{sens}.`{p}Frequency`").alias("sensitivity_hz"),
        F.col(f"{sens}.`{p}InputUnits`.`{p}Name`").alias("input_units"), F.col(f"{sens}.`{p}OutputUnits`.`{p}Name`").alias("output_units"),
        F.col(f"c.`{p}Response`.`{p}Stage`").alias("_st"),
    )
    channels = flat.select(*[c for c in flat.columns if c != "_st"], F.coalesce(F.size("_st"), F.lit(0)).alias("n_stages"))
    ids = ["net", "sta", "loc", "cha", "start", "end"]
    one = flat.select(*ids, "sensitivity", F.explode("_st").alias("g"))
    pz = f"g.`{p}PolesZeros`"
    part = lambda which, what: F.transform(F.col(f"{pz}.`{p}{which}`"), lambda e: e[f"{p}{what}"])
    stages = one.select(
        *ids, "sensitivity", F.col("g._number").alias("stage"),
        F.when(F.col(pz).isNotNull(), "poles_zeros").when(F.col(f"g.`{p}FIR`").isNotNull(), "fir")
        .when(F.col(f"g.`{p}Coefficients`").isNotNull(), "coefficients").otherwise("gain").alias("kind"),
        F.col(f"{pz}.`{p}PzTransferFunctionType`").alias("transfer"), F.col(f"{pz}.`{p}NormalizationFactor`").alias("norm_factor"),
        F.col(f"{pz}.`{p}NormalizationFrequency`").alias("norm_hz"),
        part("Zero", "Real").alias("zeros_re"), part("Zero", "Imaginary").alias("zeros_im"),
        part("Pole", "Real").alias("poles_re"), part("Pole", "Imaginary").alias("poles_im"),
        F.col(f"g.`{p}Decimation`.`{p}InputSampleRate`").alias("input_hz"), F.col(f"g.`{p}Decimation`.`{p}Factor`").alias("factor"),
        F.col(f"g.`{p}StageGain`.`{p}Value`").alias("gain"),
    )
    return stations, channels, stages


def sensor_responses(stages: DataFrame) -> DataFrame:
    """Per channel epoch the poles and zeros of the sensor stage with the overall sensitivity,
    as ``remove_response`` needs them.  Zeros and poles that are absent become empty lists."""
    pz = stages.where(F.col("kind") == "poles_zeros")
    ids = ["net", "sta", "loc", "cha", "start", "end"]
    fields = ["norm_factor", "sensitivity", "zeros_re", "zeros_im", "poles_re", "poles_im"]
    first = pz.groupBy(*ids).agg(F.min_by(F.struct(*fields), "stage").alias("_b")).select(*ids, *[f"_b.{c}" for c in fields])
    empty = F.array().cast("array<double>")
    return first.withColumns({c: F.coalesce(F.col(c), empty) for c in fields[2:]})


def unreadable(spark: SparkSession, path: str, stations: DataFrame) -> DataFrame:
    """XML files that gave no station: the count of invalid files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    known = stations.select(F.col("file").alias("_n")).distinct()
    named = files.select("path", F.col("_metadata.file_path").alias("_n"))
    return named.join(known, "_n", "left_anti").select("path")
