"""Restartable ingestion: a listing comes in as a stream, every file is taken once, with a log and a byte budget.

The log has one folder for each micro-batch, ``batch_id=<n>``, that is overwritten as a
whole.  A batch reads only the folders before its own, so a batch that is replayed
after a failure makes the same choice again and replaces what was left half done.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracewell.operators.ordered import ranged, running
from tracewell.session import cut_lineage


def read_log(listing: DataFrame, log: str) -> DataFrame:
    """What has been decided: the listing's columns, ``taken`` and ``batch_id``.  ``listing`` gives the schema."""
    fields = ", ".join(f"`{name}` {kind}" for name, kind in listing.dtypes)
    return listing.sparkSession.read.schema(f"{fields}, taken boolean, batch_id long").parquet(log)


def ingest(listing: DataFrame, log: str, checkpoint: str, load: Callable[[DataFrame, int], None] | None = None, name: str = "path",
           size: str = "length", order: Sequence[str] = ("path",), budget_bytes: int | None = None) -> DataStreamWriter:
    """Take each file of a streaming ``listing`` once; start the result with ``.start()``.

    A batch looks at its own files and those that the batch before left waiting, less all
    that were taken.  In ``order``, files are taken until the size of those before reaches
    ``budget_bytes``; so a file above the budget is taken too, but starts no other.  The
    rest waits for the next batch.  A null size counts as 0; rows without a name are left
    out; of rows with the same name the first in order counts.

    ``load(taken, batch_id)`` does the work for the files of a batch before they are
    logged.  It runs again if the batch is replayed, with the same files, and should
    overwrite by ``batch_id``.  ``log`` belongs to ``checkpoint``: batch numbers start
    anew with a new one.
    """
    columns = listing.columns

    def step(batch: DataFrame, batch_id: int) -> None:
        found = batch.where(F.col(name).isNotNull())
        if batch_id:
            before = read_log(batch, log).where(F.col("batch_id") < batch_id)
            waiting = before.where((F.col("batch_id") == batch_id - 1) & ~F.col("taken"))
            found = found.unionByName(waiting.select(*columns)).join(before.where("taken").select(name).distinct(), name, "left_anti").select(*columns)
        # the smallest row of a name by the order, with a partial aggregate
        lowest = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("s")
        fresh = found.groupBy(F.col(name).alias("_name")).agg(lowest).select(*[F.col(f"s.c{i}").alias(c) for i, c in enumerate(columns)])
        decided = fresh.withColumn("taken", F.lit(True))
        if budget_bytes is not None:
            sized = fresh.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
            total = running(ranged(sized, [], [*order, name]).drop("_mid"), [], "_part", [*order, name], {"_total": ("sum", "_size")})
            decided = total.withColumn("taken", F.col("_total") - F.col("_size") < budget_bytes).select(*columns, "taken")
        decided = cut_lineage(decided)
        if load is not None:
            load(decided.where("taken").select(*columns), batch_id)
        decided.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return listing.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
