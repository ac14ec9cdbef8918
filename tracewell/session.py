"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Partition counts are left to adaptive execution: it joins small shuffle
    partitions, turns a join into a broadcast when the measured size allows it,
    and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's own setting wins.

    Only a local session without a setting gets a temporary folder; on a cluster
    a machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tracewell-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_FOLDERS: list[str] = []  # open scopes, the innermost last
WATCHERS: list[Callable[[DataFrame], None]] = []  # called with every frame before it is written


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[str]:
    """Tables that ``cut_lineage`` writes inside the ``with`` block are deleted at its end.

    Write or collect the results inside the block; afterwards their inputs are gone.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/tracewell/{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    try:
        yield folder
    finally:
        _FOLDERS.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from its files.

    The rows survive the loss of executors, and later steps read only the columns
    they need.  The write runs at once; inside ``intermediate_tables`` the table
    lives as long as the block.
    """
    spark = df.sparkSession
    for watch in WATCHERS:
        watch(df)
    base = _FOLDERS[-1] if _FOLDERS else f"{ensure_checkpoint_dir(spark)}/tracewell"
    path = f"{base}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
