"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage


def _lowest(edges: DataFrame, by: str) -> DataFrame:
    return edges.groupBy(by).agg(F.min("w").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Rounds: every node hands its larger neighbours to the smallest neighbour
    (large star), then its smaller ones (small star), until the edges are stars
    that no longer change.  Minima are partial aggregates and the joins are on
    the node, so a component of any size is spread; the state of each round is a
    table in the shared folder.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct())
    last = None
    while True:
        both = now.select("v", "w").unionByName(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        low = _lowest(both, "v").withColumn("m", F.least("m", "v"))
        large = both.where("w > v").join(low, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").distinct()
        # small star: among the neighbours below it, a node and the others go to the smallest
        low = _lowest(large, "v")
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("w")), F.struct(F.col("w").alias("v"), F.col("m").alias("w")))).alias("s"))
        now = cut_lineage(small.select("s.v", "s.w").where("v <> w").distinct())
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "w")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return now.select(F.col("v").alias("node"), F.col("w").alias("root")).unionByName(
        now.select(F.col("w").alias("node"), F.col("w").alias("root")).distinct()
    )
