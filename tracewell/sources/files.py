"""File listings.  Only metadata is read: the content column is never selected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

LISTING = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modificationTime", T.TimestampType()),
])
SUFFIXES = (".ms", ".mseed", ".miniseed", ".xml")


def scan_files(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] = SUFFIXES,
               prune_dirs: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """All files below ``roots`` with one of the suffixes, and the roots that are missing."""
    out, missing = spark.createDataFrame([], LISTING), []
    for root in roots:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        except AnalysisException:
            missing.append(root)
            continue
        out = out.unionByName(found.select("path", "length", "modificationTime"))
    wanted = None
    for s in suffixes:
        test = F.lower("path").endswith(s)
        wanted = test if wanted is None else wanted | test
    out = out.where(wanted)
    for d in prune_dirs:
        out = out.where(~F.contains("path", F.lit(f"/{d}/")))
    return out, missing


def list_objects(spark: SparkSession, prefix: str, limit: int | None = None) -> DataFrame:
    """Keys below a prefix of a bucket or folder, without folder markers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", "length")
    found = found.where(~F.col("path").endswith("/"))
    return found if limit is None else found.orderBy("path").limit(limit)


def base_name(path: str | Column) -> Column:
    """Last part of a path with either kind of slash."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: str | Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def net_sta(net: str, sta: str) -> Column:
    return F.concat_ws(".", net, sta)


def rebase_path(path: str | Column, marker: str, root: str) -> Column:
    """Path below ``marker`` moved under ``root``, with forward slashes; other paths unchanged."""
    path = F.col(path) if isinstance(path, str) else path
    slashed = F.translate(path, "\\", "/")
    at = F.instr(slashed, marker)
    return F.when(at > 0, F.concat(F.lit(root.rstrip("/") + "/"), F.substr(slashed, at, F.length(slashed)))).otherwise(slashed)
